"""Random forests over many rows, grown level by level from counts of bins.

The forests are those of Spark ML's classifier for two classes: a tree holds every
row a Poisson(1) number of times, a node tries a random few of the features, the
best split by weighted Gini impurity lies between two of at most ``BINS`` bins of a
feature, and a split below which all leaves predict the same is taken back. The draws
are others, and bins come from all rows and not from a sample for each seed.

Rows are stored once, one byte per feature. For each level, tasks pass each tree's rows down
from its root and count them by node, bin and class; one task per group of trees adds the
counts up and picks the splits. Counts are whole numbers, and draws depend only on
the seed, the tree and the stored block, so retries and the order of tasks change nothing.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.sources.scratch import materialize

# The Arrow functions travel with their code, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: bins of a feature, as in Spark ML.
BINS = 32
# Points that stand for the values of a feature, when it has more, while bins are
# sought; a rank is off by about one part in so many.
POINTS = 16_384
# Rows whose values are sorted at a time, and rows of a stored block.
SORTED_ROWS = 1 << 17
BLOCK = 1 << 15
# Trees that a task counts at a time, bytes of their counts, and rows after which it
# gives the counts away, which then fit 32 bits.
TREES_AT_ONCE = 25
COUNT_BYTES = 64 << 20
COUNTED_ROWS = 1 << 26
# Tasks that add counts up.
MERGES = 64
# Blocks or trees' counts, each about half a megabyte, that are read and sent to Python at a time.
LARGE_ROWS = 64
_BATCHES = (
    "spark.sql.execution.arrow.maxRecordsPerBatch",
    "spark.sql.parquet.columnarReaderBatchSize",
)

_ROOM = 2 * BINS
_POINT = "fid int, part int, at int, points binary"
# A drawn number reaches the k-th bound if the row is held more than k times.
_HELD = np.array(
    [
        min(2**32 - 1, round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))))
        for k in range(12)
    ],
    np.uint32,
)


@dataclass
class Level:
    """The open nodes of a tree's level, by place.

    ``tried`` has the features of each node. ``feature``, ``bin`` and ``gain`` are of its
    best split, with feature -1 if it has none; ``size`` and ``left`` are rows by class, of
    the node and of its left child. ``child`` has the places of both children in the
    next level, which are beyond its end if they are leaves.
    """

    tried: np.ndarray
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    size: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    child: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))


Tree = list[Level]


def forest_importances(
    table: DataFrame, inputs: Sequence[str], seeds: Sequence[int], trees: int, depth: int
) -> list[list[float]]:
    """For each seed the importance of every input, from ``trees`` trees of that depth.

    ``table`` is stored and has ``_label``, 0 or 1, ``_weight``, the same for all rows
    of a label, and the inputs as doubles without nulls.
    """
    weights = class_weights(table)
    edges = bin_edges(table, inputs, weights)
    blocks = materialize(_blocks(table, inputs, edges), "forest-rows")
    n = len(inputs)
    few = n if trees == 1 else math.ceil(math.sqrt(n))
    cuts = np.array([len(e) for e in edges])
    keys = [(seed, tree) for seed in seeds for tree in range(trees)]
    forest: list[Tree] = [[Level(_tried(key, 0, 1, n, few))] for key in keys]
    for level in range(depth):
        open_trees = [t for t, tree in enumerate(forest) if len(tree) > level and len(tree[level].tried)]
        if not open_trees:
            break
        found = _best_splits(blocks, n, keys, forest, open_trees, cuts, weights)
        for t in open_trees:
            opened = enter_splits(forest[t][-1], found[t], level + 1 < depth)
            forest[t].append(Level(_tried(keys[t], level + 1, opened, n, few)))
    own = [tree_importances(tree, n, weights) for tree in forest]
    return [_shares(np.sum(own[i : i + trees], axis=0)) for i in range(0, len(own), trees)]


def class_weights(table: DataFrame) -> np.ndarray:
    found = {r["_label"]: r.w for r in table.groupBy("_label").agg(F.max("_weight").alias("w")).collect()}
    if not set(found) <= {0.0, 1.0}:
        raise ValueError(f"labels must be 0 or 1, found {sorted(map(str, found))}")
    return np.array([found.get(0.0, 0.0), found.get(1.0, 0.0)])


def _tried(key: tuple[int, int], level: int, nodes: int, n: int, few: int) -> np.ndarray:
    """Features that each node of a level tries, in ascending order."""
    drawn = np.random.default_rng([*key, level, 1]).random((nodes, n))
    return np.sort(np.argsort(drawn, axis=1, kind="stable")[:, :few], axis=1)


# Bins


def bin_edges(table: DataFrame, inputs: Sequence[str], weights: np.ndarray) -> list[np.ndarray]:
    """The greatest value of each bin of each input but the last one, ascending.

    An input with at most ``BINS`` values has a bin for each; others have bins of about
    equal weight. Every row takes part: tasks reduce values to points, exact for up to
    ``POINTS`` values, and points of one input meet in one task.
    """
    points = table.select("_label", *inputs).mapInArrow(_points(len(inputs), weights), _POINT)
    merged = (
        materialize(points, "forest-points")
        .repartitionById(len(inputs), "fid")
        .sortWithinPartitions("fid", "part", "at")
        .mapInArrow(_merged_edges(weights), "fid int, edges array<double>")
    )
    found = {r.fid: r.edges for r in merged.collect()}
    return [np.array(found.get(i, []), float) for i in range(len(inputs))]


def _points(n: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = [np.zeros((0, 3)) for _ in range(n)]
        for rows in _matrices(batches, SORTED_ROWS):
            one = rows[:, 0] == 1
            for i in range(n):
                new = [_distinct(rows[of, i + 1], y) for y, of in enumerate((~one, one))]
                kept[i] = fewer_points(merged_points([kept[i], *new]), POINTS, weights)
        part = TaskContext.get().partitionId()
        for i, own in enumerate(kept):
            if len(own):
                yield _batch(_POINT, [i], [part], [0], [own.tobytes()])

    return run


def _distinct(values: np.ndarray, y: int) -> np.ndarray:
    found, times = np.unique(values, return_counts=True)
    points = np.zeros((len(found), 3))
    points[:, 0], points[:, 1 + y] = found, times
    return points


def merged_points(parts: Sequence[np.ndarray]) -> np.ndarray:
    """``value, rows of class 0, of class 1``, ascending, one row per value."""
    points = np.concatenate(parts)
    points = points[np.argsort(points[:, 0], kind="stable")]
    if not len(points):
        return points
    first = np.flatnonzero(np.concatenate([[True], points[1:, 0] != points[:-1, 0]]))
    return np.column_stack([points[first, 0], np.add.reduceat(points[:, 1:], first)])


def fewer_points(points: np.ndarray, most: int, weights: np.ndarray) -> np.ndarray:
    """At most ``most`` points, each for the values from the one before up to its own."""
    if len(points) <= most:
        return points
    own = points[:, 1:] @ weights
    before = np.cumsum(own) - own
    cell = np.minimum(before / own.sum() * most, most - 1).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    last = np.concatenate([first[1:], [len(points)]]) - 1
    return np.column_stack([points[last, 0], np.add.reduceat(points[:, 1:], first)])


def _merged_edges(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for fid, points in zip(batch["fid"].to_pylist(), batch["points"], strict=True):
                new = np.frombuffer(points.as_buffer()).reshape(-1, 3)
                both = merged_points([kept[fid], new] if fid in kept else [new])
                # several parts meet before points are left out again
                kept[fid] = both if len(both) <= 8 * POINTS else fewer_points(both, 4 * POINTS, weights)
        for fid, points in kept.items():
            edges = pa.array([points_edges(points, weights).tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([fid], pa.int32()), edges], ["fid", "edges"])

    return run


def points_edges(points: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Edges as Spark ML chooses them, but a value itself and not the middle to the next."""
    if len(points) <= bins:
        return points[:-1, 0]
    reached = np.cumsum(points[:, 1:] @ weights)
    stride = reached[-1] / bins
    edges, wanted = [], stride
    for i in range(1, len(points)):
        if abs(reached[i - 1] - wanted) < abs(reached[i] - wanted):
            edges.append(points[i - 1, 0])
            wanted += stride
    return np.array(edges[: bins - 1])


# Rows


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The batches' columns side by side, ``size`` rows at a time."""
    waiting: list[np.ndarray] = []
    n = 0
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        if np.isnan(rows).any():
            raise ValueError("null or NaN among the values of a forest")
        waiting.append(rows)
        n += len(rows)
        if n >= size:
            whole = np.concatenate(waiting)
            for at in range(0, n - size + 1, size):
                yield whole[at : at + size]
            waiting = [whole[n - n % size :].copy()]
            n %= size
    if n:
        yield np.concatenate(waiting)


def _batch(schema: str, *columns: Sequence) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _blocks(table: DataFrame, inputs: Sequence[str], edges: Sequence[np.ndarray]) -> DataFrame:
    """Blocks of rows, told apart by ``part`` and ``at``: twice the bin of every input, and the class."""
    schema = "part int, at int, cells binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for at, rows in enumerate(_matrices(batches, BLOCK)):
            cells = np.empty(rows.shape, np.uint8)
            cells[:, -1] = rows[:, 0]
            for i, own in enumerate(edges):
                cells[:, i] = 2 * np.searchsorted(own, rows[:, i + 1])
            yield _batch(schema, [part], [at], [cells.tobytes()])

    return table.select("_label", *inputs).mapInArrow(run, schema)


def held(seed: int, tree: int, part: int, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that a tree holds, and how many times each."""
    bits = np.random.PCG64(np.random.SeedSequence([seed, tree, part, at, 2]))
    drawn = bits.random_raw((n + 1) // 2).view(np.uint32)[:n]
    rows = np.flatnonzero(drawn >= _HELD[0])
    drawn = drawn[rows]
    times = np.ones(len(rows), np.uint8)
    for bound in _HELD[1:]:
        times += drawn >= bound
    return rows, times.astype(float)


# Counts of a level


def _routes(tree: Tree) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By level and place: the column and greatest cell that go left, and the children.

    The place after the last is of rows in leaves, which stay there.
    """
    routes = []
    for level, after in zip(tree, tree[1:], strict=False):
        end = len(after.tried)
        column = np.append(np.maximum(level.feature, 0), 0)
        most = np.append(2 * np.maximum(level.bin, 0), 0).astype(np.uint8)
        child = np.append(level.child.ravel(), [end, end])
        routes.append((column, most, child))
    return routes


def tree_counts(
    flat: np.ndarray,
    stride: int,
    rows: np.ndarray,
    times: np.ndarray,
    routes: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]],
    tried: np.ndarray,
) -> Iterator[np.ndarray]:
    """For each tried feature the held rows by open node, bin and class."""
    start = rows * stride
    node = np.zeros(len(rows), np.int64)
    for column, most, child in routes:
        right = flat.take(column.take(node) + start) > most.take(node)
        node *= 2
        node += right
        node = child.take(node)
    base = node * _ROOM
    base += flat.take(start + (stride - 1))
    # rows in leaves count for a node beyond the last, with any feature
    padded = np.concatenate([tried, tried[:1]]).T.copy()
    for columns in padded:
        cell = flat.take(columns.take(node) + start)
        yield np.bincount(base + cell, times, len(padded[0]) * _ROOM)


def _counts(n: int, group: Sequence[tuple[int, tuple[int, int], list, np.ndarray]]):
    """Counts of each tree of the group, from all rows of a task, as 32-bit numbers."""
    stride = n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counted = _zeros(group), 0
        for batch in batches:
            for part, at, cells in zip(*[batch[c] for c in ("part", "at", "cells")], strict=True):
                flat = np.frombuffer(cells.as_buffer(), np.uint8)
                size = len(flat) // stride
                if counted + size > COUNTED_ROWS:
                    yield from _given(group, totals)
                    totals, counted = _zeros(group), 0
                counted += size
                for total, (_, key, routes, tried) in zip(totals, group, strict=True):
                    rows, times = held(*key, part.as_py(), at.as_py(), size)
                    for own, found in zip(total, tree_counts(flat, stride, rows, times, routes, tried), strict=True):
                        own += found
        if counted:
            yield from _given(group, totals)

    return run


def _zeros(group: Sequence[tuple]) -> list[np.ndarray]:
    return [np.zeros((tried.shape[1], (len(tried) + 1) * _ROOM)) for *_, tried in group]


def _given(group: Sequence[tuple], totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (t, *_), total in zip(group, totals, strict=True):
        yield _batch("tree int, counts binary", [t], [total[:, :-_ROOM].astype(np.uint32).tobytes()])


def _best_splits(
    blocks: DataFrame,
    n: int,
    keys: Sequence[tuple[int, int]],
    forest: Sequence[Tree],
    open_trees: Sequence[int],
    cuts: np.ndarray,
    weights: np.ndarray,
) -> dict[int, np.ndarray]:
    """By tree, ``place in tried, bin, gain, size by class, left by class`` of every open node."""
    tried = {t: forest[t][-1].tried for t in open_trees}
    largest = max(8 * _ROOM * (len(x) + 1) * x.shape[1] for x in tried.values())
    some = max(1, min(TREES_AT_ONCE, COUNT_BYTES // largest))
    groups = [
        [(t, keys[t], _routes(forest[t]), tried[t]) for t in open_trees[i : i + some]]
        for i in range(0, len(open_trees), some)
    ]
    # the same rows once per group of trees, so that there are more tasks than splits
    parts = [blocks.mapInArrow(_counts(n, group), "tree int, counts binary") for group in groups]
    met = reduce(DataFrame.unionAll, parts).repartitionById(min(MERGES, len(open_trees)), "tree")
    found = met.mapInArrow(_splits(tried, cuts, weights), "tree int, splits binary")
    with few_rows_at_once(blocks.sparkSession):
        return {r.tree: np.frombuffer(r.splits).reshape(-1, 7) for r in found.collect()}


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """At most ``LARGE_ROWS`` rows in a batch; the session's settings are put back at the end."""
    before = {s: spark.conf.get(s) for s in _BATCHES}
    before = {s: was for s, was in before.items() if not 0 < int(was) <= LARGE_ROWS}
    for setting in before:
        spark.conf.set(setting, LARGE_ROWS)
    try:
        yield
    finally:
        for setting, was in before.items():
            spark.conf.set(setting, was)


def _splits(tried: dict[int, np.ndarray], cuts: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, counts in zip(batch["tree"].to_pylist(), batch["counts"], strict=True):
                own = np.frombuffer(counts.as_buffer(), np.uint32)
                if t in totals:
                    totals[t] += own
                else:
                    totals[t] = own.astype(np.int64)
        for t, total in totals.items():
            best = best_splits(total.reshape(tried[t].shape[1], -1, BINS, 2), tried[t], cuts, weights)
            yield _batch("tree int, splits binary", [t], [best.tobytes()])

    return run


def _gini(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Impurity of weighted class counts in the last axis; 0 where there are none."""
    weighted = counts * weights
    whole = weighted.sum(axis=-1, keepdims=True)
    share = np.divide(weighted, whole, out=np.zeros_like(weighted), where=whole > 0)
    return np.where(whole[..., 0] > 0, 1 - (share * share).sum(axis=-1), 0.0)


def best_splits(counts: np.ndarray, tried: np.ndarray, cuts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The best split of each node from counts by tried feature, node, bin and class.

    The gain of a node without any split is 0.
    """
    nodes = counts.shape[1]
    size = counts[0].sum(axis=1)
    left = np.cumsum(counts, axis=2)[:, :, :-1].transpose(1, 0, 2, 3)
    right = size[:, None, None, :] - left
    whole = (size @ weights)[:, None, None]
    shares = [np.divide(x @ weights, whole, out=np.zeros(x.shape[:3]), where=whole > 0) for x in (left, right)]
    gain = _gini(size, weights)[:, None, None] - sum(
        share * _gini(x, weights) for share, x in zip(shares, (left, right), strict=True)
    )
    able = (left.sum(axis=3) > 0) & (right.sum(axis=3) > 0)
    able &= np.arange(BINS - 1) < cuts[tried][:, :, None]
    gain = np.where(able, gain, 0.0).reshape(nodes, -1)
    at = gain.argmax(axis=1)
    k, b = np.divmod(at, BINS - 1)
    each = np.arange(nodes)
    return np.column_stack([k, b, gain[each, at], size, left[each, k, b]]).astype(float)


# Trees


def enter_splits(level: Level, found: np.ndarray, go_on: bool) -> int:
    """Enter what :func:`best_splits` found; how many children are to be split next."""
    each = np.arange(len(found))
    split = found[:, 2] > 0
    level.feature = np.where(split, level.tried[each, found[:, 0].astype(np.int64)], -1)
    level.bin, level.gain = found[:, 1].astype(np.int64), found[:, 2]
    level.size, level.left = found[:, 3:5], found[:, 5:7]
    sides = np.stack([level.left, level.size - level.left], axis=1)
    mixed = split[:, None] & (sides > 0).all(axis=2) & go_on
    opened = int(mixed.sum())
    level.child = np.where(mixed, np.cumsum(mixed).reshape(-1, 2) - 1, opened)
    return opened


def tree_importances(tree: Tree, n: int, weights: np.ndarray) -> np.ndarray:
    """Weighted gains by feature, as shares, without the splits that change no prediction."""
    own = np.zeros(n)
    # of the level below, by place: whether the node stays split, and what it predicts
    below, said = np.zeros(0, bool), np.zeros(0, np.int64)
    for level in reversed([x for x in tree if len(x.feature)]):
        sides = np.stack([level.left, level.size - level.left], axis=1) * weights
        predicted = (sides[:, :, 1] > sides[:, :, 0]).astype(np.int64)
        is_open = level.child < len(below)
        at = np.where(is_open, level.child, 0)
        if len(below):
            predicted = np.where(is_open, said[at], predicted)
        inner = is_open & below[at] if len(below) else np.zeros_like(is_open)
        same = ~inner.any(axis=1) & (predicted[:, 0] == predicted[:, 1])
        below = (level.feature >= 0) & ~same
        whole = level.size * weights
        said = np.where((level.feature >= 0) & same, predicted[:, 0], whole[:, 1] > whole[:, 0])
        np.add.at(own, level.feature[below], (level.gain * whole.sum(axis=1))[below])
    return np.array(_shares(own))


def _shares(values: np.ndarray) -> list[float]:
    whole = values.sum()
    return [float(v) for v in (values / whole if whole else values)]


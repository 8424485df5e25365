"""Pearson and Spearman matrices, strongly correlated pairs, scatter points."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.binning import edge_index
from labelscope.functions.columns import double_sql, quoted, uniform_hash
from labelscope.operators.impute import (
    imputed_long,
    matrix_source,
    medians,
    outlier_limits,
)
from labelscope.operators.longform import SLICE, feature_name, with_per_feature
from labelscope.operators.quantiles import MAX_TARGETS, Known, every_nth, order_statistics
from labelscope.operators.sampling import cap_rows_per_group, hash_step, last_steps
from labelscope.roles import Roles
from labelscope.sources.scratch import materialize

# The Arrow functions travel with their code, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: pairs above this strength are reported.
THRESHOLD = 0.7
# Cut points form a tree: FAN children per node, as deep as ranges of RANGE_ROWS need.
FAN = 12
RANGE_ROWS = 50_000
MOST_LEVELS = 5
# Groups in which the tasks' sums of products meet.
GROUPS = 16
# Features with up to so many values are ranked by lookup, so many of all features.
DICTIONARY_VALUES = 2_000
DICTIONARY_CELLS = 200_000

# Position of a column to its values, ascending, and their ranks.
Dictionaries = dict[int, tuple[np.ndarray, np.ndarray]]


def pearson_matrix(df: DataFrame, roles: Roles, known: Known | None = None) -> DataFrame:
    """``(feat1, feat2, pearson)`` over all ordered pairs of imputed columns."""
    source, features = matrix_source(df, roles)
    known = with_per_feature(
        source, "_m", medians(source, features, known), features, "median"
    )
    # shifting by the median changes no coefficient and keeps the sums small
    centred = []
    for i, c in enumerate(features):
        median = f"_m.median_{i}"
        centred.append(f"coalesce({double_sql(source, c)} - {median}, {median} - {median})")
    cells = ", ".join(centred)
    return _correlate(known.selectExpr(f"array({cells}) AS x"), features, "pearson")


def spearman_matrix(df: DataFrame, roles: Roles, known: Known | None = None) -> DataFrame:
    """``(feat1, feat2, spearman)`` over all ordered pairs of imputed columns.

    Ties get their average rank. Rows need no key: the columns of the matrix
    are stored once with a row number, by which the ranks come together again.
    Features with few distinct values are never shuffled: the ranks of those
    values are sent to the tasks and put in where the products are formed.
    """
    source, features = matrix_source(df, roles)
    if not features:
        return _correlate(source.select(F.array().cast("array<double>").alias("x")), [], "spearman")
    numbered = materialize(
        source.select(
            F.monotonically_increasing_id().alias("_row"),
            *[F.expr(f"{double_sql(source, c)} AS c{i}") for i, c in enumerate(features)],
        ),
        "numbered-rows",
    )
    middle = materialize(medians(source, features, known), "medians")
    columns = [f"c{i}" for i in range(len(features))]
    listed = rank_dictionaries(numbered, columns, middle)
    ranged = [i for i in range(len(features)) if i not in listed]
    place = F.element_at(
        F.create_map(*[F.lit(x) for p in enumerate(ranged) for x in p[::-1]]) if ranged
        else F.lit(None).cast("map<int, int>"),
        F.col("fid"),
    )
    filled = with_per_feature(numbered, "_m", middle, columns, "median")
    raw = {i: f"coalesce(c{i}, _m.median_{i})" for i in listed}
    if not ranged:
        cells = ", ".join(raw[i] for i in range(len(features)))
        return _correlate(filled.selectExpr(f"array({cells}) AS x"), features, "spearman", listed)
    own = middle.where(F.col("fid").isin(*ranged)).withColumn("fid", place)
    ranks = rank_rows(numbered, [columns[i] for i in ranged], "_row", own)
    # one more row with the values that are looked up
    beside = filled.selectExpr("_row", "-1 AS fid", "cast(null as double) AS rank",
                               *[f"{raw[i]} AS v{i}" for i in listed])
    by_row = ranks.unionByName(beside, allowMissingColumns=True).groupBy("_row")
    listed_cells = {i: F.max(f"v{i}").alias(f"v{i}") for i in listed}
    if len(features) <= SLICE:
        found = [F.expr(f"max(if(fid = {k}, rank, null)) AS r{i}") for k, i in enumerate(ranged)]
        gathered = by_row.agg(*found, *listed_cells.values())
        cell = {i: f"r{i}" for i in ranged}
    else:
        # one entry per feature, so the list is as long as the table is wide
        entries = F.collect_list(F.when(F.col("fid") >= 0, F.struct("fid", "rank")))
        gathered = by_row.agg(F.map_from_entries(entries).alias("r"), *listed_cells.values())
        cell = {i: f"try_element_at(r, {k})" for k, i in enumerate(ranged)}
    cell |= {i: f"v{i}" for i in listed}
    cells = ", ".join(cell[i] for i in range(len(features)))
    return _correlate(gathered.selectExpr(f"array({cells}) AS x"), features, "spearman", listed)


def rank_dictionaries(df: DataFrame, columns: Sequence[str], middle: DataFrame) -> Dictionaries:
    """``{position: (values, ranks)}`` of the columns with few distinct imputed values.

    Ranks are averages over ties, shifted to a mean of zero. An estimate says
    which columns to count; those with the fewest values go first, up to
    ``DICTIONARY_CELLS`` values of all columns.
    """
    long = imputed_long(df, columns, middle=middle)
    estimates = long.groupBy("fid").agg(F.approx_count_distinct("value", 0.03).alias("n")).collect()
    taken, room = [], DICTIONARY_CELLS
    for row in sorted(estimates, key=lambda r: (r.n, r.fid)):
        if row.n <= DICTIONARY_VALUES and row.n <= room:
            taken.append(row.fid)
            room -= row.n
    if not taken:
        return {}
    in_order = Window.partitionBy("fid").orderBy("value")
    counted = (
        imputed_long(df, columns, middle=middle)
        .where(F.col("fid").isin(*taken) & F.col("value").isNotNull())
        .groupBy("fid", "value")
        .agg(F.count("*").alias("count"))
        .withColumn("below", F.sum("count").over(in_order) - F.col("count"))
        .withColumn("n", F.sum("count").over(Window.partitionBy("fid")))
        .selectExpr("fid", "value", "below + (count + 1) / 2 - (n + 1) / 2 AS rank")
        # as many rows as the estimates allowed, give or take their error
        .toArrow()
    )
    fids, values, ranks = (np.asarray(counted.column(c)) for c in ("fid", "value", "rank"))
    found = {}
    for fid in sorted(taken):
        own = fids == fid
        order = np.argsort(values[own])
        found[fid] = (values[own][order], ranks[own][order])
    return found


def rank_rows(
    df: DataFrame, features: Sequence[str], row: str, middle: DataFrame
) -> DataFrame:
    """``(row, fid, rank)``: average ranks of the imputed values of each feature,
    shifted to a mean of zero. ``row`` is a unique column of a stored table,
    ``middle`` the stored medians.

    Exact order statistics at equal steps cut the values of a feature into
    ranges of one step, more of them the more rows there are. Every value more
    frequent than a step is itself a cut point, so its rows take their rank
    from a small lookup and are never gathered; the rest are ranked inside
    their range, at most a step of rows. Cut points are small and read several
    times, so they are stored.
    """
    rows, levels = df.count(), 1
    while levels < MOST_LEVELS and rows > RANGE_ROWS * FAN**levels:
        levels += 1
    # the cut points of a slice of features are broadcast
    step = max(1, MAX_TARGETS // FAN**levels)
    parts = [
        _rank_slice(df, features[at : at + step], at, row, levels, middle)
        for at in range(0, len(features), step)
    ]
    return reduce(DataFrame.unionAll, parts)


def _rank_slice(
    df: DataFrame, features: Sequence[str], first: int, row: str, levels: int, middle: DataFrame
) -> DataFrame:
    own = middle.where(F.col("fid").between(first, first + len(features) - 1))
    own = own.withColumn("fid", F.col("fid") - first)
    parts = FAN**levels
    long = imputed_long(df, features, F.col(row), middle=own)
    found = order_statistics(long, every_nth(parts), len(features), parts)
    in_order = Window.partitionBy("fid").orderBy("value")
    cuts = materialize(found.withColumn("cut", F.row_number().over(in_order) - 1), "cuts")

    # walk down the tree: the last cut point at or below each value
    placed = long.withColumn("node", F.lit(0))
    for level in range(levels):
        width = FAN ** (levels - 1 - level)
        place = f"cast(cut div {width} as int)"
        bounds = [F.expr(f"max(if(child = {i}, value, null)) AS b{i}") for i in range(1, FAN)]
        nodes = (
            cuts.where(F.col("cut") % width == 0)
            .selectExpr(
                "fid",
                f"cast({place} div {FAN} as int) AS node",
                f"{place} % {FAN} AS child",
                "value",
            )
            .groupBy("fid", "node")
            .agg(*bounds)
        )
        step = edge_index("value", [f"b{i}" for i in range(1, FAN)], closed="left")
        placed = placed.join(F.broadcast(nodes), ["fid", "node"]).select(
            row, "fid", "value", (F.col("node") * FAN + step).alias("node")
        )
    centre = (F.col("n") + 1) / 2
    points = cuts.select(
        "fid",
        F.col("cut").alias("node"),
        F.col("value").alias("cut_value"),
        (F.col("below") + (F.col("count") + 1) / 2 - centre).alias("rank"),
        (F.col("below") + F.col("count") - centre).alias("base"),
    )
    placed = placed.join(F.broadcast(points), ["fid", "node"])

    on_cut = F.col("value") == F.col("cut_value")
    inside = Window.partitionBy("fid", "node").orderBy("value")
    up_to = F.count("*").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    between = F.col("base") + (F.rank().over(inside) + up_to) / 2
    ranged = placed.where(~on_cut).select(row, "fid", "node", "value", "base")
    ranks = (
        placed.where(on_cut)
        .select(row, "fid", "rank")
        .unionAll(ranged.select(row, "fid", between.alias("rank")))
    )
    return ranks.withColumn("fid", F.col("fid") + first)


def matrix_wide(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """A long matrix as one row per feature with one column per feature."""
    if not features:
        return matrix.select(F.col("feat1").alias("feature")).where(F.lit(False))
    value = matrix.columns[2]
    return (
        matrix.groupBy("feat1")
        .pivot("feat2", list(features))
        .agg(F.first(value))
        .withColumnRenamed("feat1", "feature")
    )


def high_pairs(
    pearson: DataFrame, spearman: DataFrame, features: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    """``(feat1, feat2, pearson, spearman)`` with either coefficient beyond the threshold.

    Each pair appears once, in column order, and needs both coefficients.
    """
    place = F.array(*[F.lit(c) for c in features])
    upper = F.array_position(place, F.col("feat1")) < F.array_position(place, F.col("feat2"))
    strong = (F.abs("pearson") > threshold) | (F.abs("spearman") > threshold)
    return (
        pearson.where(upper & F.col("pearson").isNotNull())
        .join(spearman.where(F.col("spearman").isNotNull()), ["feat1", "feat2"])
        .where(strong)
    )


def scatter_pairs(
    df: DataFrame,
    roles: Roles,
    pairs: Sequence[tuple[str, str]],
    keys: Sequence[str] = (),
    cap: int = 10_000,
    n_std: float = 5,
    seed: int = 42,
    portable: bool = False,
    known: Known | None = None,
) -> DataFrame:
    """Points of the listed pairs: ``(feat1, feat2, keys…, x, y, label)``.

    Rows where either imputed value is an outlier are left out; pairs that
    involve the label are skipped; each pair has min(cap, points) of them.
    ``keys`` are shown beside each point and need not be unique. Without pairs
    there are no points.

    One counting pass, with one row per task and step of the hash, finds how far
    in the order of the hash each pair has to go. Only rows that near are
    repeated for their pairs, about ``cap`` of them a pair however many rows the
    table has, and the exact cap is taken of those.
    """
    pairs = [p for p in pairs if roles.label not in p]
    if not pairs:
        shown = [F.col(quoted(k)) for k in keys]
        nothing = df.select(
            *[F.lit(None).cast("string").alias(c) for c in ("feat1", "feat2")],
            *shown,
            *[F.lit(None).cast("double").alias(c) for c in ("x", "y")],
            F.lit(None).cast("int").alias(roles.label),
        )
        return nothing.where(F.lit(False))
    source, columns = matrix_source(df, roles)
    features = [c for c in columns if any(c in p for p in pairs)]
    limits = outlier_limits(source, features, known)
    known = with_per_feature(source, "_s", limits, features, "median", "mean", "std")
    clean = []
    for i, c in enumerate(features):
        x = f"coalesce({double_sql(source, c)}, _s.median_{i})"
        far = f"abs({x} - _s.mean_{i}) > {n_std} * _s.std_{i}"
        clean.append(f"if({far}, null, {x}) AS x{i}")
    shown = [f"{quoted(k)} AS k{i}" for i, k in enumerate(keys)]
    order = uniform_hash(keys or source.columns, seed, portable)
    rows = known.withColumn("_step", hash_step(order)).selectExpr(
        *shown, "_step AS step", f"cast({quoted(roles.label)} as int) AS label", *clean
    )
    sides = [(features.index(a), features.index(b)) for a, b in pairs]
    last = last_steps(rows, "step", [f"x{a} is not null and x{b} is not null" for a, b in sides], cap)
    points = [
        f"named_struct('pair', {p}, 'last', {last[p]}, 'x', x{a}, 'y', x{b})"
        for p, (a, b) in enumerate(sides)
    ]
    inside = f"filter(array({', '.join(points)}), p -> step <= p.last and p.x is not null and p.y is not null)"
    kept = [f"k{i}" for i in range(len(keys))]
    # rows beyond the last step of every pair are left out before any is repeated
    near = rows.where(F.col("step") <= max(last))
    near = near.selectExpr(*kept, "label", f"inline({inside})").drop("last")
    near = materialize(near, "scatter-points")
    capped = cap_rows_per_group(near, cap, ["pair"], kept or None, seed, portable)
    return capped.select(
        *[
            F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair")).alias(f"feat{side + 1}")
            for side in (0, 1)
        ],
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        "x",
        "y",
        F.col("label").alias(roles.label),
    )


def _ranks(block: np.ndarray, listed: Dictionaries) -> np.ndarray:
    """The block with the values of listed columns replaced by their ranks."""
    block = block.copy()
    for i, (values, ranks) in listed.items():
        if len(values):
            at = np.minimum(np.searchsorted(values, block[:, i]), len(values) - 1)
            block[:, i] = np.where(np.isnan(block[:, i]), np.nan, ranks[at])
    return block


def _products(m: int, groups: int, listed: Dictionaries):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = np.zeros((m + 1, m + 1))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            block = _ranks(flat.reshape(-1, m), listed) if listed else flat.reshape(-1, m)
            # a column of ones adds the sums and the number of rows to the products
            block = np.column_stack([np.ones(len(block)), block])
            state += block.T @ block
        if state[0, 0]:
            group = TaskContext.get().partitionId() % groups
            yield _state_batch(group, state)

    return products


def _state_batch(group: int, state: np.ndarray) -> pa.RecordBatch:
    upper = state[np.triu_indices(len(state))]
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int32()), pa.array([upper.tobytes()], pa.binary())],
        names=["group", "state"],
    )


def _merge(m: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.zeros((m + 1) * (m + 2) // 2)
        for batch in batches:
            for state in batch.column("state"):
                upper += np.frombuffer(state.as_buffer())
        if not upper[0]:
            return
        total = np.zeros((m + 1, m + 1))
        total[np.triu_indices(m + 1)] = upper
        n, sums, total = total[0, 0], total[0, 1:], total[1:, 1:]
        i, j = np.triu_indices(m)
        square = np.diag(total)
        columns = [i, j, total[i, j], sums[i], sums[j], square[i], square[j], np.full(len(i), n)]
        types = [pa.int32()] * 2 + [pa.float64()] * 6
        arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "p", "si", "sj", "qi", "qj", "n"])

    return merge


def _correlate(
    rows: DataFrame, features: Sequence[str], name: str, listed: Dictionaries | None = None
) -> DataFrame:
    """Product-moment correlation of the entries of array x as a long matrix.

    A tree of partial states: each task of the scan reduces its rows to one
    matrix of products, one binary row; the tasks' states meet in ``GROUPS``
    groups, each of which adds them up in one task; and only the groups' sums
    become rows of single pairs. So the scan has as many tasks as splits, and
    what is shuffled as rows are groups times pairs. Values of ``listed``
    columns are replaced by their ranks. Constant columns and columns without
    any value have null coefficients.
    """
    m = len(features)
    if not m:
        schema = f"feat1 string, feat2 string, {name} double"
        return rows.sparkSession.createDataFrame([], schema)
    states = rows.mapInArrow(_products(m, GROUPS, listed or {}), "group int, state binary")
    schema = "i int, j int, p double, si double, sj double, qi double, qj double, n double"
    summed = (
        states.repartitionById(GROUPS, "group")
        .mapInArrow(_merge(m), schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("p", "si", "sj", "qi", "qj", "n")])
    )
    spread = F.expr("sqrt((qi - si * si / n) * (qj - sj * sj / n))")
    value = F.try_divide(F.expr("p - si * sj / n"), spread)
    bounded = F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)))
    both = F.expr("if(i = j, array(struct(i, j)), array(struct(i, j), struct(j AS i, i AS j)))")
    return (
        summed.where("n > 0")
        .withColumn(name, F.when(~F.isnan(value), bounded))
        .select(F.explode(both).alias("pair"), name)
        .select(
            feature_name(features, "pair.i").alias("feat1"),
            feature_name(features, "pair.j").alias("feat2"),
            name,
        )
    )

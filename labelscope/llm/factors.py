"""Quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.tables import stored

from labelscope.llm.text import as_bytes, mix, runs, span_hashes, tidy, word_spans

#: Hashed words share so many weights.
WORD_BITS = 15
#: Steps of each structure statistic and of each metadata column; one more
#: feature of each has its height as value.
STEPS = 24
CELLS = STEPS + 1
#: Length of the vector of every feature.
RANK = 6
#: Labelled documents that the model is fitted on, about.
FIT_ROWS = 20_000
#: Parts of the sample that are fitted side by side, and how often their models
#: are averaged; both are part of the model and don't follow the cluster.
SHARDS = 8
ROUNDS = 4
#: Passes of a shard over its rows in a round, more where they would make few
#: steps, and rows of one step.
PASSES, MOST_PASSES = 3, 40
LEAST_STEPS = 60
STEP_ROWS = 32
RATE = 0.15
#: Pulls weights and vectors to zero.
SHRINK = 1e-5
SEED = 11
#: Score from which a document counts as good.
THRESHOLD = 0.3

#: What is measured of a text beside its words.
STATISTICS = (
    "words",
    "mean_word",
    "upper",
    "digits",
    "punctuation",
    "symbols",
    "wide",
    "distinct_words",
    "top_word",
    "distinct_lines",
    "mean_line",
    "same_neighbours",
    "marked_words",
    "upper_words",
)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(b"0123456789")
_PUNCTUATION = _class(b"!\"'(),-./:;?[]`{}")
_SYMBOL = _class(b"#$%&*+<=>@\\^_|~")
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


@dataclass(frozen=True)
class Machine:
    """An intercept, a weight and a vector for each feature."""

    base: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, which: np.ndarray, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The value of each document from its features ``which`` with ``values``.

        Sums over pairs of features cost as much as sums over features: half the
        square of the sum less the sum of squares, in each dimension.
        """
        if not len(which):
            return np.full(len(firsts) - 1, self.base)
        own = self.vectors[which] * values[:, None]
        total = _sums(own, firsts)
        squares = _sums(np.einsum("ij,ij->i", own, own), firsts)
        linear = _sums(self.weights[which] * values, firsts)
        return self.base + linear + 0.5 * (np.einsum("ij,ij->i", total, total) - squares)


def _sums(rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each document; 0 where it has none."""
    out = np.zeros((len(firsts) - 1, *rows.shape[1:]), np.float64)
    some = firsts[1:] > firsts[:-1]
    if some.any():
        out[some] = np.add.reduceat(rows, firsts[:-1][some], axis=0, dtype=np.float64)
    return out


def probability(logits: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))


def _counts(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[bounds])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _root_step(share: np.ndarray) -> np.ndarray:
    """A step for a share in 0 to 1, finer near 0."""
    return np.minimum(np.sqrt(share) * STEPS, STEPS - 1).astype(np.int64)


def _log_step(size: np.ndarray, per_double: float) -> np.ndarray:
    return np.clip(np.log2(np.maximum(size, 0) + 1) * per_double, 0, STEPS - 1).astype(np.int64)


def _groups(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of times of each different hash of an owner, ascending by owner."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return order[at], np.diff(np.append(at, len(owner)))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows low to high: features of the texts, their values, and where each text's begin.

    Each different word, A-Z lower-cased, is one hashed feature with a value that
    grows with its count and falls with the number of words; the statistics are
    two features each, one named by the step that they lie in, the other with
    the height of the step as value.
    """
    for low, high in runs(column):
        data, bounds = as_bytes(column.slice(low, high - low))
        n = high - low
        starts, ends, firsts = word_spans(data, bounds)
        n_words = np.diff(firsts)
        owner = np.repeat(np.arange(n), n_words)
        hashes = span_hashes(data, starts, ends, fold_case=True)
        at, times = _groups(owner, hashes)
        word_owner = owner[at]
        word = (hashes[at] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        per_doc = np.bincount(word_owner, minlength=n)
        value = (1 + np.log(times)) / np.sqrt(np.maximum(per_doc[word_owner], 1))

        n_chars = _counts((data & 0xC0) != 0x80, bounds)
        n_letters = _counts(_LETTER[data], bounds)
        n_bytes = np.diff(bounds)
        in_words = _sums((ends - starts).astype(np.float64), firsts)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        top = np.zeros(n, np.int64)
        np.maximum.at(top, word_owner, times)
        last = data[ends - 1] if len(ends) else data[:0]
        marked = _SYMBOL[last] | (last == 33)
        capital = _UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, ends - 1)]] & (ends - starts > 1)
        line_ends = np.flatnonzero(data == 10)
        line_owner = np.searchsorted(bounds, line_ends, "right") - 1
        begins = np.zeros(len(data) + 1, bool)
        begins[line_ends + 1] = True
        begins[bounds] = True
        edges = np.flatnonzero(begins)
        lines = span_hashes(data, edges[:-1], edges[1:])
        line_owner = np.searchsorted(bounds, edges[:-1], "right") - 1
        n_lines = np.bincount(line_owner, minlength=n)
        distinct_lines = np.bincount(line_owner[_groups(line_owner, lines)[0]], minlength=n)
        steps = [
            _log_step(n_words, 1.5),
            _log_step(_share(in_words, n_words), 4),
            _root_step(_share(_counts(_UPPER[data], bounds), n_letters)),
            _root_step(_share(_counts(_DIGIT[data], bounds), n_bytes)),
            _root_step(_share(_counts(_PUNCTUATION[data], bounds), n_bytes)),
            _root_step(_share(_counts(_SYMBOL[data], bounds), n_bytes)),
            _root_step(_share(_counts(data >= 128, bounds), n_bytes)),
            _root_step(_share(per_doc, n_words)),
            _root_step(_share(top, n_words)),
            _root_step(_share(distinct_lines, n_lines)),
            _log_step(_share(n_chars, n_lines), 2),
            _root_step(_share(_sums(same.astype(np.float64), firsts), n_words)),
            _root_step(_share(_sums(marked.astype(np.float64), firsts), n_words)),
            _root_step(_share(_sums(capital.astype(np.float64), firsts), n_words)),
        ]
        yield low, high, *_joined(n, (word_owner, word, value), _stepped(steps, 0))


def _stepped(steps: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, feature and value of statistics or metadata that ``before`` others precede."""
    step = np.stack(steps, axis=1)
    base = (1 << WORD_BITS) + CELLS * (before + np.arange(len(steps)))
    which = np.stack([step + base, np.broadcast_to(base + STEPS, step.shape)], axis=2)
    value = np.stack([np.ones(step.shape), 2 * step / STEPS], axis=2) / np.sqrt(len(STATISTICS))
    return np.repeat(np.arange(len(step)), 2 * len(steps)), which.reshape(-1), value.reshape(-1)


def _joined(n: int, *parts: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of several kinds side by side, document by document."""
    owner, which, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    firsts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return which[order], value[order].astype(np.float32), firsts


def n_features(metadata: Sequence[str] = ()) -> int:
    return (1 << WORD_BITS) + CELLS * (len(STATISTICS) + len(metadata))


def _with_metadata(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """:func:`features` of the texts of a batch, and those of its metadata columns."""
    for low, high, which, values, firsts in features(batch.column("text")):
        n = high - low
        if names:
            steps = [_metadata_step(batch.column(name).slice(low, n)) for name in names]
            owner = np.repeat(np.arange(n), np.diff(firsts))
            which, values, firsts = _joined(
                n, (owner, which, values), _stepped(steps, len(STATISTICS))
            )
        yield low, high, which, values, firsts


def _metadata_step(column: pa.Array) -> np.ndarray:
    """Step 0 for null; numbers by their size, anything else by a hash."""
    known = np.asarray(pc.is_valid(column))
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        size = np.nan_to_num(np.asarray(pc.fill_null(column.cast(pa.float64()), 0)))
        step = 1 + np.minimum(_log_step(np.abs(size), 1.2), STEPS - 2)
    else:
        data, bounds = as_bytes(column.cast(pa.string()))
        hashes = span_hashes(data, bounds[:-1], bounds[1:])
        step = 1 + (mix(hashes) % np.uint64(STEPS - 1)).astype(np.int64)
    return np.where(known, step, 0)


def _trained(
    machine: Machine, which: np.ndarray, values: np.ndarray, firsts: np.ndarray, labels: np.ndarray, seed: int
) -> Machine:
    """The machine after some passes over a shard, in steps scaled per feature (AdaGrad)."""
    weights, vectors = machine.weights.astype(np.float64), machine.vectors.astype(np.float64)
    base, base_seen = machine.base, 1.0
    seen_w, seen_v = np.ones_like(weights), np.ones_like(vectors)
    draw = np.random.default_rng(seed)
    steps = max(1, len(labels) // STEP_ROWS)
    for _ in range(min(MOST_PASSES, max(PASSES, -(-LEAST_STEPS // steps)))):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            sizes = firsts[rows + 1] - firsts[rows]
            take = np.repeat(firsts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            take += np.arange(len(take))
            own, x = which[take], values[take].astype(np.float64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            v = vectors[own]
            total = _sums(v * x[:, None], edges)
            logits = Machine(base, weights, vectors).logits(own, x, edges)
            error = (probability(logits) - labels[rows]) / len(rows)
            e = np.repeat(error, sizes) * x
            used, inverse = np.unique(own, return_inverse=True)
            slope_w = np.bincount(inverse, e, len(used)) + SHRINK * weights[used]
            slope = e[:, None] * (np.repeat(total, sizes, axis=0) - v * x[:, None])
            slope_v = np.stack(
                [np.bincount(inverse, slope[:, f], len(used)) for f in range(slope.shape[1])], axis=1
            )
            slope_v += SHRINK * vectors[used]
            seen_w[used] += (STEP_ROWS * slope_w) ** 2
            seen_v[used] += (STEP_ROWS * slope_v) ** 2
            weights[used] -= RATE * STEP_ROWS * slope_w / np.sqrt(seen_w[used])
            vectors[used] -= RATE * STEP_ROWS * slope_v / np.sqrt(seen_v[used])
            slope_b = float(error.sum())
            base_seen += (STEP_ROWS * slope_b) ** 2
            base -= RATE * STEP_ROWS * slope_b / np.sqrt(base_seen)
    return Machine(base, weights, vectors)


def _blank(metadata: Sequence[str], share: float, rank: int) -> Machine:
    n = n_features(metadata)
    vectors = np.random.default_rng(SEED).normal(0, 0.1, (n, rank))
    return Machine(float(np.log(share / (1 - share))), np.zeros(n), vectors)


def _encoder(names: Sequence[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, which, values, firsts in _with_metadata(batch, names):
                rows = batch.slice(low, high - low)
                cut = [slice(a, b) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"),
                        rows.column("label"),
                        pa.array([which[c].astype(np.int32).tobytes() for c in cut], pa.binary()),
                        pa.array([values[c].astype(np.float32).tobytes() for c in cut], pa.binary()),
                    ],
                    names=["id", "label", "which", "values"],
                )

    return encode


def labelled_features(
    docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = (), fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``shard, id, label, which, values`` of a bounded sample of labelled documents, stored.

    ``docs`` has ``id, text`` and the metadata, ``labels`` ``id, label``. About
    ``fit_rows`` of the labelled ids are drawn by a hash. An id with several
    labels has their mean, one with several texts one of these.
    """
    known = labels.where("id is not null and label is not null").groupBy("id")
    known = known.agg(F.avg(F.col("label").cast("double")).alias("label"))
    n = known.count()
    if n > fit_rows:
        place = F.xxhash64("id", F.lit(SEED)).cast("double") / 2.0**64 + 0.5
        known = known.where(place < fit_rows / n)
    # about fit_rows ids, whatever the size of the tables
    rows = docs.join(F.broadcast(known), "id").select("id", "label", "text", *metadata)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, label double, which binary, values binary"
    found = rows.mapInArrow(tidy(_encoder(metadata)), schema)
    one = found.groupBy("id").agg(F.min(F.struct("which", "values", "label")).alias("row"))
    shard = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(SHARDS)).cast("int").alias("shard")
    return stored(one.select(shard, "id", "row.*"), "labelled-features")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    metadata: Sequence[str] = (),
    fit_rows: int = FIT_ROWS,
    rank: int = RANK,
) -> Machine:
    """A machine for the labels, fitted on a bounded sample.

    Every round each shard of the sample goes on from the same machine in a
    task of its own, and the machines are averaged by their rows. What comes to
    the driver is one machine per shard. Without labels, or with those of one
    class only, every score is the share of the good ones (a half without any).
    """
    rows = labelled_features(docs, labels, metadata, fit_rows)
    seen = rows.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    share = seen["good"] / seen["n"] if seen["n"] else 0.5
    machine = _blank(metadata, min(max(share, 1e-3), 1 - 1e-3), rank)
    if not seen["n"] or not 0 < share < 1:
        return Machine(machine.base, machine.weights, np.zeros_like(machine.vectors))
    for turn in range(ROUNDS):
        tune = _tuner(machine, turn)
        schema = "shard int, n bigint, base double, weights binary, vectors binary"
        found = rows.groupBy("shard").applyInArrow(tune, schema).collect()
        found = sorted(found, key=lambda r: r["shard"])
        n = sum(r["n"] for r in found)
        shape = machine.vectors.shape
        machine = Machine(
            sum(r["base"] * r["n"] for r in found) / n,
            sum(np.frombuffer(r["weights"], np.float32) * (r["n"] / n) for r in found),
            sum(np.frombuffer(r["vectors"], np.float32).reshape(shape) * (r["n"] / n) for r in found),
        )
    return machine


def _tuner(machine: Machine, turn: int):
    small = Machine(machine.base, machine.weights.astype(np.float32), machine.vectors.astype(np.float32))

    def tune(rows: pa.Table) -> pa.Table:
        # rows arrive in any order
        rows = rows.sort_by("id")
        shard = rows.column("shard")[0].as_py()
        which = [np.frombuffer(x, np.int32) for x in rows.column("which").to_pylist()]
        values = [np.frombuffer(x, np.float32) for x in rows.column("values").to_pylist()]
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in which])])
        labels = np.asarray(rows.column("label"), np.float64)
        done = _trained(
            small, np.concatenate(which), np.concatenate(values), firsts, labels, SEED + 100 * turn + shard
        )
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "n": pa.array([len(labels)], pa.int64()),
                "base": pa.array([done.base], pa.float64()),
                "weights": pa.array([done.weights.astype(np.float32).tobytes()], pa.binary()),
                "vectors": pa.array([done.vectors.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    return tune


def _scorer(machine: Machine, names: Sequence[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                probability(machine.logits(which, values, firsts))
                for _, _, which, values, firsts in _with_metadata(batch, names)
            ]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"]
            )

    return score


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    metadata: Sequence[str] = ("n_chars",),
    held_out: Column | None = None,
    fit_rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out, score, predicted``.

    The machine learns from labelled rows for which ``held_out``, a condition on
    the column ``id`` of both tables, doesn't hold; then every whole text is
    scored. Neither the id nor the label is a feature, and of other columns only
    those of ``metadata``.

    A null text is empty; empty texts get the score of their statistics and
    metadata. Null metadata is a step of its own. Null ids are scored and never
    learned from. Repeated rows get equal scores. Other columns of ``docs`` may
    have any name. An empty table gives an empty result. Memory is bounded by
    the longest text.
    """
    hidden = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    about = [F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(metadata)]
    names = [f"m{i}" for i in range(len(metadata))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *about)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    machine = fit(rows, known.where(~hidden), names, fit_rows)
    small = Machine(machine.base, machine.weights.astype(np.float32), machine.vectors.astype(np.float32))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(tidy(_scorer(small, names)), f"id {id_type}, score double")
    # small rows, stored so that texts go to Python a few at a time
    found = stored(found, "quality-scores")
    return found.select(
        F.col("id").alias(id_col),
        hidden.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

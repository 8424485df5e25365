"""Bootstrap intervals of means, by replicate weights drawn from a hash of the row."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.columns import as_double, quoted

# The Arrow functions travel with their code, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLICATES = 500
# Rows times replicates that are weighted at a time.
CELLS = 2_000_000
# Groups in which the tasks' sums meet.
MERGES = 16

# Upper ends of the Poisson distribution with mean 1: weight k below the k-th.
_UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def poisson_weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """A Poisson(1) weight of every row (a 64-bit hash) in every replicate."""
    x = keys.astype(np.uint64)[:, None] + (replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(
        0x9E3779B97F4A7C15
    )
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    uniform = (x >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_UPTO, uniform.ravel(), "right").reshape(uniform.shape).astype(np.float64)


_STATE = "merge int, grp string, n bigint, total double, weights binary, sums binary"


def _collapser(replicates: int):
    numbers = np.arange(replicates)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str | None, list] = {}
        step = max(1, CELLS // replicates)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                groups = part.column("grp").dictionary_encode(null_encoding="encode")
                which = np.asarray(groups.indices)
                values = np.asarray(part.column("value"), np.float64)
                weights = poisson_weights(np.asarray(part.column("key")).view(np.uint64), numbers)
                for i, name in enumerate(groups.dictionary.to_pylist()):
                    own = which == i
                    state = states.setdefault(name, [0, 0.0, np.zeros(replicates), np.zeros(replicates)])
                    state[0] += int(own.sum())
                    state[1] += float(values[own].sum())
                    state[2] += weights[own].sum(axis=0)
                    state[3] += values[own] @ weights[own]
        if states:
            yield _batch(TaskContext.get().partitionId() % MERGES, states)

    return collapse


def _batch(merge: int, states: dict) -> pa.RecordBatch:
    rows = list(states.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([merge] * len(rows), pa.int32()),
            pa.array([k for k, _ in rows], pa.string()),
            pa.array([s[0] for _, s in rows], pa.int64()),
            pa.array([s[1] for _, s in rows], pa.float64()),
            pa.array([s[2].tobytes() for _, s in rows], pa.binary()),
            pa.array([s[3].tobytes() for _, s in rows], pa.binary()),
        ],
        names=["merge", "grp", "n", "total", "weights", "sums"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[str | None, list] = {}
    merge = 0
    for batch in batches:
        for row in batch.to_pylist():
            merge = row["merge"]
            own = [row["n"], row["total"], *(np.frombuffer(row[c]) for c in ("weights", "sums"))]
            known = states.get(row["grp"])
            states[row["grp"]] = own if known is None else [a + b for a, b in zip(known, own, strict=True)]
    if states:
        yield _batch(merge, states)


def _finisher(level: float):
    tail = (1 - level) / 2

    def finish(rows: pa.Table) -> pa.Table:
        weights, sums = (
            np.sum([np.frombuffer(x) for x in rows.column(c).to_pylist()], axis=0)
            for c in ("weights", "sums")
        )
        means = sums[weights > 0] / weights[weights > 0]
        low, high = np.quantile(means, [tail, 1 - tail]) if len(means) else (None, None)
        n = pc.sum(rows.column("n")).as_py()
        return pa.table(
            {
                "grp": pa.array([rows.column("grp")[0].as_py()], pa.string()),
                "count": pa.array([n], pa.int64()),
                "mean": pa.array([pc.sum(rows.column("total")).as_py() / n], pa.float64()),
                "mean_low": pa.array([low], pa.float64()),
                "mean_high": pa.array([high], pa.float64()),
            }
        )

    return finish


def bootstrap_means(
    df: DataFrame,
    value: str,
    group: str,
    keys: Sequence[str],
    replicates: int = REPLICATES,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """``(group, count, mean, mean_low, mean_high)`` with a percentile interval of the mean.

    In each replicate a row counts Poisson(1) times, drawn from a hash of its
    ``keys``, the seed and the replicate, which is the bootstrap of a large
    table and needs no second look at it: the same rows have the same weights
    under any partitioning and on any retry. Each task collapses its rows to two
    sums per group and replicate; those are merged in groups of tasks and then
    by group. Rows without a value are left out; rows that share a key have
    common weights, so keys should be unique. A null group is one.
    """
    hashed = df.select(
        F.col(quoted(group)).cast("string").alias("grp"),
        as_double(df, value).alias("value"),
        F.xxhash64(*[F.col(quoted(k)) for k in keys], F.lit(seed)).alias("key"),
    ).where("value is not null")
    states = hashed.mapInArrow(_collapser(replicates), _STATE)
    merged = states.repartitionById(MERGES, "merge").mapInArrow(_merge, _STATE)
    schema = "grp string, count bigint, mean double, mean_low double, mean_high double"
    found = merged.groupBy("grp").applyInArrow(_finisher(level), schema)
    return found.withColumnRenamed("grp", group)

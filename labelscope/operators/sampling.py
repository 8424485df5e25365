"""Samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.columns import quoted, uniform_hash
from labelscope.operators.longform import SLICE

# Rows are counted in this many cells of their hash before any is ordered.
CELLS = 1 << 16
# Steps of a hash for each time that it doubles.
STEPS_PER_DOUBLE = 16


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own sample: cheap, but tied to the partitioning of the input."""
    return df.sample(False, fraction, seed)


def hash_sample(
    df: DataFrame,
    keys: Sequence[str],
    fraction: float,
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Keep a row when the hash of its key falls below the fraction.

    Rows that share a key are kept or left out together.
    """
    return df.where(uniform_hash(keys, seed, portable) < fraction)


def cap_rows(
    df: DataFrame,
    n: int,
    keys: Sequence[str] | None = None,
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """A sample of min(n, rows) rows: those with the lowest hashes of their keys.

    Keys may repeat, and rows with equal keys are ordered by a hash of the
    whole row. Without keys that is the only order, and the sample unbiased.
    """
    return cap_rows_per_group(df, n, [], keys, seed, portable)


def cap_rows_per_group(
    df: DataFrame,
    n: int,
    group: Sequence[str],
    keys: Sequence[str] | None = None,
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """min(n, rows) rows of each group, chosen as in :func:`cap_rows`.

    Rows are counted by cells of the hash first. All rows in the cells below
    the one in which the count reaches n are taken as they are, and only rows
    of that cell are ordered, of which each task passes on n at most. Meant for
    groups the caller has listed, such as feature pairs: one row per group is
    broadcast.
    """
    own = [_free(df, f"cap_{i}") for i in range(len(group) + 5)]
    u, cell, last, room, place = own[: 5]
    names = own[5:]

    def same(row: DataFrame, edge: DataFrame) -> Column:
        # groups may be null
        test = F.lit(True)
        for g, name in zip(group, names, strict=True):
            test = test & row[quoted(g)].eqNullSafe(edge[name])
        return test

    everything = uniform_hash(df.columns, seed, portable)
    order = everything if keys is None else uniform_hash(keys, seed, portable)
    hashed = df.withColumn(u, order)
    hashed = hashed.withColumn(cell, F.floor(F.col(u) * CELLS).cast("int"))
    by = [F.col(quoted(g)).alias(name) for g, name in zip(group, names, strict=True)]
    counts = hashed.groupBy(*by, cell).agg(F.count("*").alias(room))
    running = Window.partitionBy(*names).orderBy(cell)
    upto = F.sum(room).over(running)
    edges = (
        counts.withColumn(place, upto)
        .where((F.col(place) >= n) & (F.col(place) - F.col(room) < n))
        .select(
            *names, F.col(cell).alias(last), (n - F.col(place) + F.col(room)).alias(room)
        )
    )
    if group:
        joined = hashed.join(F.broadcast(edges), same(hashed, edges), "left")
    else:
        edge = edges.select(F.struct(last, room).alias("edge"))
        joined = hashed.withColumn(place, edge.scalar())
        joined = joined.withColumn(last, F.col(f"{place}.{last}")).withColumn(
            room, F.col(f"{place}.{room}")
        )
    sure = joined.where(F.col(last).isNull() | (F.col(cell) < F.col(last)))
    ordered = Window.partitionBy(*[F.col(quoted(g)) for g in group] or [F.lit(0)])
    edge = joined.where(F.col(cell) == F.col(last)).withColumn(
        place, F.row_number().over(ordered.orderBy(u, everything))
    )
    # the constant lets every task pass on n rows of a group at most
    edge = edge.where(F.col(place) <= n).where(F.col(place) <= F.col(room))
    columns = [F.col(quoted(c)) for c in df.columns]
    return sure.select(*columns).unionAll(edge.select(*columns))


def hash_step(u: Column) -> Column:
    """The step of a uniform hash on a scale that is finer towards 0, ascending with it."""
    return F.ceil(F.log2(F.greatest(u, F.lit(2.0**-62))) * STEPS_PER_DOUBLE).cast("int")


def last_steps(rows: DataFrame, step: str, conditions: Sequence[str], n: int) -> list[int]:
    """For each condition the step up to which at least n rows satisfy it, or the last one.

    ``step`` is a column of :func:`hash_step`. The rows are counted by step for
    all conditions at once, without being repeated; what is collected is one row
    per step, whatever the size of the table.
    """
    found = []
    for at in range(0, len(conditions), SLICE):
        part = conditions[at : at + SLICE]
        counts = [F.count_if(F.expr(c)).alias(f"n{i}") for i, c in enumerate(part)]
        counted = sorted(rows.groupBy(F.col(step).alias("step")).agg(*counts).collect())
        for i in range(len(part)):
            total, last = 0, counted[-1][0] if counted else 0
            for row in counted:
                total += row[i + 1]
                if total >= n:
                    last = row[0]
                    break
            found.append(last)
    return found


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name

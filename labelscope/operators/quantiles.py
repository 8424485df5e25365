"""Exact order statistics without sorting or collecting the data.

For a few quantiles a KLL sketch of each feature gives an interval around each
of them, wider than the sketch's error. One more scan counts exactly: inside an
interval value by value, or in equal parts where it holds many rows, and outside
in bulk. Should a wanted rank lie outside, which exact counts tell, it is looked
for there by the passes described next, so the sketch decides how much work
there is and never what the result is.

For many ranks, such as cut points, values are counted on a logarithmic grid whose
cells order like the values.
Running counts show which cells hold the wanted ranks; each of those is cut
from its least to its greatest value into equal parts, which are counted in
turn, a fixed number of times, and what is left is counted value by value.
Each pass is one scan that collapses inside the tasks. Because the parts span
what a cell really holds, values that are close together far from zero, such
as timestamps of a day, are told apart like any others. Counting is exact, so
the result does not depend on partitioning, retries or the number of passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.binning import magnitude_cell
from labelscope.operators.longform import feature_name, numeric_long
from labelscope.sources.scratch import materialize

# Cells of the first grid per factor e, and parts of a cell in each pass after it.
FIRST_GRID = 64
PARTS = 4096
PASSES = 2
# The cells in question are broadcast between passes, one row per wanted rank;
# more features than fit are taken in slices.
MAX_TARGETS = 1_000_000
# Size of the sketches, and half the width of the intervals taken from them: half
# as much again as the rank error that they keep to in 99 cases of 100, but for
# the features with few values, which are one interval.
SKETCH = 1000
MARGIN = 0.007
WHOLE = 10_000
# Intervals that hold about so many rows at most are counted value by value, the
# others in so many parts.
BY_VALUE = 3_000
INTERVAL_PARTS = 1024
# More quantiles than this are found on the grid.
MOST_INTERVALS = 24


def holding_ranks(probabilities: Sequence[float]) -> Column:
    """Whether a run of ``count`` values after ``below`` others, of n in all, holds
    one of the two neighbours of a quantile position."""
    places = [f"{float(p)!r}D * (n - 1)" for p in probabilities]
    ranks = [f"{side}({at})" for at in places for side in ("floor", "ceil")]
    return F.expr(" OR ".join(f"({rank} >= below AND {rank} < below + count)" for rank in ranks))


def every_nth(parts: int) -> Column:
    """Whether such a run holds rank 0, s, 2s, … with at most ``parts`` of them."""
    step = f"((n + {parts - 1}) div {parts})"
    return F.expr(f"(below + {step} - 1) div {step} * {step} < below + count")


def order_statistics(
    values: DataFrame,
    wanted: Column,
    features: int,
    per_feature: int,
    probabilities: Sequence[float] = (),
) -> DataFrame:
    """``(fid, value, count, below, n)`` for each distinct value at a wanted rank.

    ``values`` is a ``(fid, value)`` relation of ``features`` features; nulls
    are skipped. ``count`` is the frequency of the value, ``below`` the number
    of smaller values, ``n`` the number of values of the feature. At most
    ``per_feature`` ranks of a feature are wanted; those of a few quantiles lie
    near the ``probabilities``. What a pass finds is stored, so each pass scans
    the values once.
    """
    step = max(1, MAX_TARGETS // max(1, per_feature))
    if features <= step:
        return _order_statistics(values, wanted, probabilities)
    slices = [
        _order_statistics(
            values.where(F.col("fid").between(at, at + step - 1)), wanted, probabilities
        )
        for at in range(0, features, step)
    ]
    return reduce(DataFrame.unionAll, slices)


def _order_statistics(
    values: DataFrame, wanted: Column, probabilities: Sequence[float] = ()
) -> DataFrame:
    rows = values.select("fid", "value").where(F.col("value").isNotNull())
    path = ["fid"]
    if probabilities:
        rows, at = _interval_cells(rows, probabilities)
    else:
        rows = rows.withColumn("at0", magnitude_cell(F.col("value"), FIRST_GRID))
        at = ["at0"]
    counted = (
        _counted(rows, path, at)
        .withColumn("n", F.sum("count").over(Window.partitionBy("fid")))
        .withColumn("below", F.lit(0).cast("bigint"))
    )
    found = _keep_wanted(counted, path, at, wanted)
    for level in range(PASSES + 1):
        path += at
        found = materialize(found, "cells")
        # cells of a single value, such as those of counts, need no more passes
        if found.where("low < high").isEmpty():
            break
        rows = rows.join(F.broadcast(found.drop("count")), path)
        at = [f"at{level + 2}"]
        place = F.col("value")
        if level < PASSES:
            low, high = F.col("low"), F.col("high")
            part = F.floor((F.col("value") - low) / (high - low) * PARTS)
            place = F.when(low < high, F.least(part, F.lit(PARTS - 1))).otherwise(0).cast("int")
        rows = rows.withColumn(at[0], place)
        kept = [F.max("below").alias("below"), F.max("n").alias("n")]
        counted = _counted(rows, path, at, *kept)
        found = _keep_wanted(counted, path, at, wanted)
        rows = rows.drop("low", "high", "below", "n")
    return found.select("fid", F.col("low").alias("value"), "count", "below", "n")


def _interval_cells(
    rows: DataFrame, probabilities: Sequence[float]
) -> tuple[DataFrame, list[str]]:
    """The rows with two more columns that order like their values, and these columns' names.

    ``at0`` counts the interval bounds that a value has passed, so it names a
    stretch between two of them; ``at1`` is the value itself or its part of the
    stretch inside an interval, and 0 outside of all.
    """
    probabilities = sorted(set(map(float, probabilities)))
    sides = {
        "lows": [max(0.0, p - MARGIN) for p in probabilities],
        "highs": [min(1.0, p + MARGIN) for p in probabilities],
    }
    sketched = rows.groupBy("fid").agg(
        F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"),
        F.count("*").alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    k = len(probabilities)
    bounds = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(ranks)).alias(side)
        for side, ranks in sides.items()
    ]
    # one row per feature, read in every pass
    found = sketched.select("fid", "n", "least", "most", *bounds)
    whole = F.col("n") <= WHOLE
    by_value = whole | (F.col("n") * (2 * MARGIN) <= BY_VALUE)
    found = found.select(
        "fid",
        by_value.alias("by_value"),
        F.when(whole, F.array_repeat("least", k)).otherwise(F.col("lows")).alias("lows"),
        F.when(whole, F.array_repeat("most", k)).otherwise(F.col("highs")).alias("highs"),
    )
    found = materialize(found, "intervals")
    placed = rows.join(F.broadcast(found), "fid")
    passed = [
        F.expr(" + ".join(f"if(value {test} {side}[{i}], 1, 0)" for i in range(k)))
        for side, test in (("lows", ">="), ("highs", ">"))
    ]
    placed = placed.withColumn("a", passed[0]).withColumn("b", passed[1])
    low = F.greatest(F.get("lows", F.col("a") - 1), F.get("highs", F.col("b") - 1))
    high = F.least(F.get("lows", F.col("a")), F.get("highs", F.col("b")))
    part = F.floor((F.col("value") - low) / (high - low) * INTERVAL_PARTS)
    part = F.least(part, F.lit(INTERVAL_PARTS - 1))
    inside = F.col("a") > F.col("b")
    at = (
        F.when(inside & F.col("by_value"), F.col("value"))
        .when(inside & (low < high), part.cast("double"))
        .otherwise(0.0)
    )
    # never null, which a join would check by computing all of it again
    at = F.coalesce(at, F.lit(0.0)).alias("at1")
    return placed.select("fid", "value", (F.col("a") + F.col("b")).alias("at0"), at), ["at0", "at1"]


def _counted(
    rows: DataFrame, path: list[str], at: list[str], *more: Column
) -> DataFrame:
    """Rows, least and greatest value of each part."""
    return rows.groupBy(*path, *at).agg(
        F.count("*").alias("count"), F.min("value").alias("low"), F.max("value").alias("high"), *more
    )


def _keep_wanted(counted: DataFrame, group: list[str], at: list[str], wanted: Column) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn(
        "below", F.col("below") + F.sum("count").over(order) - F.col("count")
    )
    return placed.where(wanted)


def _found(
    values: DataFrame, probabilities: Sequence[float], features: int
) -> DataFrame:
    """``(fid, n, found)``: at most two found values per probability, in a list."""
    ranks = 2 * len(probabilities)
    wanted = holding_ranks(probabilities)
    near = probabilities if len(probabilities) <= MOST_INTERVALS else ()
    stats = order_statistics(values, wanted, features, ranks, near)
    return stats.groupBy("fid").agg(
        F.max("n").alias("n"), F.collect_list(F.struct("value", "below", "count")).alias("found")
    )


def _at(rank: Column) -> Column:
    """The found value that holds a rank, with its counts."""

    def holds(hit: Column) -> Column:
        return (rank >= hit["below"]) & (rank < hit["below"] + hit["count"])

    return F.get(F.filter("found", holds), F.lit(0))


def quantiles(
    values: DataFrame,
    probabilities: Sequence[float],
    features: int,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(fid, n, q0, q1, …)``.

    Features without any value have no row.
    """
    names = names or [f"q{i}" for i in range(len(probabilities))]

    def interpolated(p: Column) -> Column:
        position = p * (F.col("n") - 1)
        low, high = _at(F.floor(position))["value"], _at(F.ceil(position))["value"]
        return low + (high - low) * (position - F.floor(position))

    probs = F.lit([float(p) for p in probabilities])
    cut = _found(values, probabilities, features).select(
        "fid", "n", F.transform(probs, interpolated).alias("q")
    )
    return cut.select("fid", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(names)])


@dataclass(frozen=True)
class Known:
    """Quantiles of many features, stored: ``feature, n, q0, q1, …``."""

    features: tuple[str, ...]
    probabilities: tuple[float, ...]
    table: DataFrame

    def of(
        self, features: Sequence[str], probabilities: Sequence[float], names: Sequence[str]
    ) -> DataFrame | None:
        """What :func:`quantiles` gives for the features, or None if it isn't known."""
        if not set(features) <= set(self.features):
            return None
        if not set(probabilities) <= set(self.probabilities):
            return None
        place = [self.probabilities.index(p) for p in probabilities]
        fid = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
        columns = [F.col(f"q{i}").alias(c) for i, c in zip(place, names, strict=True)]
        return self.table.select(fid.cast("int").alias("fid"), "n", *columns).where("fid >= 0")


def known_quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float]
) -> Known:
    """Exact quantiles of the features, found once for all operators that need some."""
    probabilities = tuple(sorted(set(map(float, probabilities))))
    found = quantiles(numeric_long(df, features), probabilities, len(features))
    named = found.select(feature_name(features).alias("feature"), *found.columns[1:])
    return Known(tuple(features), probabilities, materialize(named, "quantiles"))


def feature_quantiles(
    df: DataFrame,
    features: Sequence[str],
    probabilities: Sequence[float],
    names: Sequence[str],
    known: Known | None = None,
) -> DataFrame:
    """:func:`quantiles` of columns of a table, taken from ``known`` where it has them."""
    found = known.of(features, probabilities, names) if known and features else None
    if found is None:
        found = quantiles(numeric_long(df, features), probabilities, len(features), names)
    return found


def clip_range(values: DataFrame, low: float, high: float, features: int) -> DataFrame:
    """``(fid, first, last, n)``: the smallest and largest value between two
    quantiles, and the number of values from one to the other."""
    first = _at(F.ceil(low * (F.col("n") - 1)))
    last = _at(F.floor(high * (F.col("n") - 1)))
    return (
        _found(values, (low, high), features)
        .select("fid", first.alias("a"), last.alias("b"))
        .selectExpr(
            "fid", "a.value AS first", "b.value AS last", "b.below + b.count - a.below AS n"
        )
    )


def approx_quantiles(
    values: DataFrame, probabilities: Sequence[float], names: Sequence[str], accuracy: int = 10_000
) -> DataFrame:
    """Sketched quantiles in one pass, with a rank error of at most 1 / accuracy.

    One sketch per task and feature is shuffled, and features are merged in
    parallel.
    """
    sketch = F.percentile_approx("value", [float(p) for p in probabilities], accuracy)
    rows = values.groupBy("fid").agg(sketch.alias("q"))
    return rows.select("fid", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])

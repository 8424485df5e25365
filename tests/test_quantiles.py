import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.functions import magnitude_cell
from labelscope.operators import quantiles as quantile_module
from labelscope.operators.longform import numeric_long
from labelscope.operators.quantiles import (
    clip_range,
    every_nth,
    order_statistics,
    quantiles,
)

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def draw(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    return {
        "normal": rng.normal(0, 1, n),
        "lognormal": rng.lognormal(0, 5, n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 1e-9, n)),
        "mostly_zero": np.where(rng.random(n) < 0.96, 0.0, rng.exponential(3, n)),
        "integers": rng.integers(-50, 50, n).astype(float),
        "offset": 1.7e9 + rng.random(n),
        "huge": rng.choice([-1e300, 1e300, 1e-300, -1e-300, 0.0, 5.0], n),
        "constant": np.full(n, 5.0),
    }


@pytest.mark.parametrize(("grid", "parts"), [(64, 4096), (1, 3), (1024, 50)])
def test_quantiles_equal_numpy_on_every_grid(spark, monkeypatch, grid, parts):
    monkeypatch.setattr(quantile_module, "FIRST_GRID", grid)
    monkeypatch.setattr(quantile_module, "PARTS", parts)
    data = draw(1)
    names = list(data)
    rows = [tuple(float(data[c][i]) for c in names) for i in range(3000)]
    df = spark.createDataFrame(rows, names).repartition(5)
    long = numeric_long(df, names)
    found = quantiles(long, PROBS, len(names)).collect()
    assert len(found) == len(names)
    for row in found:
        expected = np.quantile(data[names[row.fid]], PROBS)
        for i, e in enumerate(expected):
            assert math.isclose(row[f"q{i}"], e, rel_tol=1e-12, abs_tol=1e-12), names[row.fid]


def test_nulls_and_nan_are_skipped(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "x double, empty double"
    )
    found = quantiles(numeric_long(df, ["x", "empty"]), [0.5], 2).collect()
    assert [(r.fid, r.n, r.q0) for r in found] == [(0, 2, 2.0)]


def test_order_statistics_report_counts_below(spark):
    values = [1.0] * 3 + [2.0] * 4 + [9.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = order_statistics(numeric_long(df, ["x"]), every_nth(1000), 1, 1000).orderBy("value")
    assert [(r.value, r["count"], r.below, r.n) for r in found.collect()] == [
        (1.0, 3, 0, 8),
        (2.0, 4, 3, 8),
        (9.0, 1, 7, 8),
    ]


def test_every_nth_makes_at_most_the_wanted_parts(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"))
    found = order_statistics(numeric_long(df, ["x"]), every_nth(7), 1, 7).collect()
    assert sorted(r.below for r in found) == [0, 143, 286, 429, 572, 715, 858]


def test_cells_never_decrease(spark):
    random.seed(5)
    values = [random.choice([-1, 1]) * math.exp(random.uniform(-700, 700)) for _ in range(2000)]
    values += [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf]
    values += [float(np.nextafter(v, math.inf)) for v in values[:500]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for grid in (16, 128, 1 << 18):
        cells = df.select("x", magnitude_cell(F.col("x"), grid).alias("c")).orderBy("x").collect()
        assert all(a.c <= b.c for a, b in zip(cells, cells[1:]))


def test_repartitioning_changes_nothing(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.lognormal(0, 2, 2000)], "x double")
    results = [
        quantiles(numeric_long(df.repartition(k), ["x"]), PROBS, 1).collect() for k in (1, 3, 17)
    ]
    assert results[0] == results[1] == results[2]


def test_clip_range_holds_the_values_between_the_quantiles(spark):
    data = draw(6)
    names = list(data)
    rows = [tuple(float(data[c][i]) for c in names) for i in range(3000)]
    long = numeric_long(spark.createDataFrame(rows, names), names)
    for r in clip_range(long, 0.01, 0.99, len(names)).collect():
        values = data[names[r.fid]]
        lower, upper = np.quantile(values, [0.01, 0.99])
        inside = values[(values >= lower) & (values <= upper)]
        assert (r.first, r.last, r.n) == (inside.min(), inside.max(), len(inside)), names[r.fid]


def test_features_are_taken_in_slices(spark, monkeypatch):
    data = draw(4)
    names = list(data)
    rows = [tuple(float(data[c][i]) for c in names) for i in range(500)]
    long = numeric_long(spark.createDataFrame(rows, names), names)
    whole = sorted(quantiles(long, PROBS, len(names)).collect())
    monkeypatch.setattr(quantile_module, "MAX_TARGETS", 3 * 2 * len(PROBS))
    assert sorted(quantiles(long, PROBS, len(names)).collect()) == whole


def test_timestamps_of_a_day_are_no_single_group(spark, monkeypatch):
    """The greatest number of rows that one window sees, in every pass."""
    sizes = []
    keep = quantile_module._keep_wanted

    def counting(counted, group, at, wanted):
        sizes.append(counted.groupBy(*group).count().agg(F.max("count")).first()[0])
        return keep(counted, group, at, wanted)

    monkeypatch.setattr(quantile_module, "_keep_wanted", counting)
    n = 2_000_000
    day = spark.range(n).select(
        F.lit(0).alias("fid"),
        (F.lit(1.7e12) + F.pmod(F.col("id") * 7_919, F.lit(86_400_000))).cast("double").alias("value"),
    )
    probabilities = [0.01, 0.5, 0.99]
    assert quantiles(day, probabilities, 1).count() == 1
    # the first pass is that of the sketch
    assert len(sizes) >= 2
    assert max(sizes) <= 10_000
    # nor on the grid, where many ranks are looked for
    sizes.clear()
    order_statistics(day, quantile_module.holding_ranks(probabilities), 1, 6).count()
    assert len(sizes) >= 3
    assert max(sizes) <= 10_000


@pytest.mark.parametrize(("margin", "by_value", "parts"), [(0.0, 0, 4), (1e-4, 50, 4), (0.007, 0, 1024), (0.3, 0, 16)])
def test_no_sketch_is_too_poor(spark, monkeypatch, margin, by_value, parts):
    """Intervals that miss the wanted ranks, overlap, or are cut coarsely."""
    monkeypatch.setattr(quantile_module, "MARGIN", margin)
    monkeypatch.setattr(quantile_module, "WHOLE", 0)
    monkeypatch.setattr(quantile_module, "BY_VALUE", by_value)
    monkeypatch.setattr(quantile_module, "INTERVAL_PARTS", parts)
    monkeypatch.setattr(quantile_module, "SKETCH", 8)
    data = draw(11)
    data["infinite"] = np.where(np.arange(3000) % 5 == 0, np.inf, data["normal"])
    data["infinite"][::7] = -np.inf
    names = list(data)
    rows = [tuple(float(data[c][i]) for c in names) for i in range(3000)]
    long = numeric_long(spark.createDataFrame(rows, names).repartition(5), names)
    probabilities = [0.0, 0.013, 0.25, 0.26, 0.5, 0.9, 0.999, 1.0]
    for row in quantiles(long, probabilities, len(names)).collect():
        values = np.sort(data[names[row.fid]])
        for i, p in enumerate(probabilities):
            at = p * 2999
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            # infinite neighbours have no value between them
            if np.isfinite(low) and np.isfinite(high):
                expected = low + (high - low) * (at - np.floor(at))
                assert math.isclose(row[f"q{i}"], expected, rel_tol=1e-12, abs_tol=1e-12), names[row.fid]


def test_two_scans_for_a_small_table(spark, monkeypatch):
    """One for the sketches and one that counts: nothing is left to look for."""
    stored = []
    keep = quantile_module.materialize

    def watched(df, name):
        stored.append(name)
        return keep(df, name)

    monkeypatch.setattr(quantile_module, "materialize", watched)
    df = spark.range(100_000).select(F.rand(3).alias("x"), F.randn(4).alias("y"))
    found = quantiles(numeric_long(df, ["x", "y"]), PROBS, 2).collect()
    assert len(found) == 2 and stored == ["intervals", "cells"]


def test_known_quantiles_stand_in_for_a_search(spark, monkeypatch):
    data = draw(5)
    names = list(data)
    rows = [tuple(float(data[c][i]) for c in names) for i in range(400)]
    df = spark.createDataFrame(rows, names)
    known = quantile_module.known_quantiles(df, names, [*PROBS, 0.5])
    wanted = (["offset", "normal"], [0.5, 0.1], ["middle", "low"])
    searched = sorted(quantile_module.feature_quantiles(df, *wanted).collect())
    monkeypatch.setattr(quantile_module, "quantiles", None)
    assert sorted(quantile_module.feature_quantiles(df, *wanted, known).collect()) == searched
    assert known.of(["other"], [0.5], ["q"]) is None
    assert known.of(["normal"], [0.3], ["q"]) is None

"""Bootstrap by hashed Poisson weights, and jobs that run side by side."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.operators import importance
from labelscope.operators.bootstrap import bootstrap_means, poisson_weights
from labelscope.roles import Roles
from labelscope.together import together


def _df(spark, n=6000):
    rng = np.random.default_rng(4)
    rows = [(i, "abc"[i % 3], float(v)) for i, v in enumerate(rng.lognormal(0, 1, n))]
    rows += [(n + i, None, 5.0) for i in range(20)] + [(n + 30, "a", None), (n + 31, "d", 2.5)]
    return spark.createDataFrame(rows, "id bigint, kind string, x double"), rows


def test_weights_are_poisson():
    weights = poisson_weights(np.arange(40_000, dtype=np.uint64) * np.uint64(977), np.arange(12))
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
    counts = np.bincount(weights.astype(int).ravel()) / weights.size
    assert np.allclose(counts[:4], np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.005)
    apart = np.corrcoef(weights.T) - np.eye(12)
    assert np.abs(apart).max() < 0.03


def test_intervals_hold_the_mean_and_follow_the_normal_ones(spark):
    df, rows = _df(spark)
    found = {r.kind: r for r in bootstrap_means(df, "x", "kind", ["id"]).collect()}
    assert set(found) == {"a", "b", "c", "d", None}
    for kind in "abc":
        values = np.array([x for _, k, x in rows if k == kind and x is not None])
        r, half = found[kind], 1.96 * values.std(ddof=1) / np.sqrt(len(values))
        assert r["count"] == len(values) and abs(r.mean - values.mean()) < 1e-9
        assert r.mean_low < r.mean < r.mean_high
        assert abs(r.mean_low - (r.mean - half)) < 0.3 * half
        assert abs(r.mean_high - (r.mean + half)) < 0.3 * half
    assert found[None].mean_low == found[None].mean_high == 5.0
    assert found["d"].mean_low == found["d"].mean_high == 2.5


def test_partitions_change_nothing(spark):
    df, _ = _df(spark, 2000)
    one, two = (
        {r.kind: (r["count"], round(r.mean_low, 9), round(r.mean_high, 9))
         for r in bootstrap_means(df.repartition(n), "x", "kind", ["id"], replicates=50).collect()}
        for n in (1, 9)
    )
    assert one == two
    other = bootstrap_means(df, "x", "kind", ["id"], replicates=50, seed=1).collect()
    assert {r.kind: round(r.mean_low, 9) for r in other} != {k: v[1] for k, v in one.items()}
    assert bootstrap_means(df.limit(0), "x", "kind", ["id"]).collect() == []


def test_items_run_side_by_side_and_in_order(spark):
    running, most = set(), []

    def run(i):
        running.add(i)
        most.append(len(running))
        time.sleep(0.2)
        n = spark.range(100).where(f"id % {i + 2} = 0").count()
        running.discard(i)
        return i, n

    found = together(spark, run, range(5), 3)
    assert found == [(i, -(-100 // (i + 2))) for i in range(5)]
    assert 2 <= max(most) <= 3


def test_one_failure_cancels_the_others(spark):
    started = threading.Event()

    def run(i):
        if i == 0:
            started.wait(30)
            time.sleep(1)
            raise RuntimeError("first")
        started.set()
        slow = spark.range(0, 10**13, 1, 4).selectExpr("max(hash(id))")
        return slow.first()

    begin = time.time()
    with pytest.raises(RuntimeError, match="first"):
        together(spark, run, range(2), 2)
    assert time.time() - begin < 60
    # the session goes on
    assert spark.range(10).count() == 10


def test_seeds_fitted_together_give_what_each_gives_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 5 == 0), float(rng.normal() + (i % 5 == 0)), float(rng.normal())) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, y int, x double, z double").coalesce(2)
    roles = Roles(label="y", ignore=("id",))
    found = []
    for at_once in (1, 5):
        monkeypatch.setattr(importance, "FITS_AT_ONCE", at_once)
        table = importance.rf_importance_by_seed(df, roles, seeds=3, trees=4, depth=3)
        found.append({(r.seed, r.feature): r.importance for r in table.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 6
    for key, value in found[0].items():
        assert abs(found[1][key] - value) < 1e-9
    by_seed = importance.rf_importance_by_seed(df, roles, seeds=2, trees=2, depth=2)
    assert by_seed.groupBy("seed").agg(F.sum("importance").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()

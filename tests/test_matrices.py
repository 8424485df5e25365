"""Plans of the matrices and of scatter points, and their awkward cases."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscope.operators import correlation
from labelscope.operators.correlation import pearson_matrix, scatter_pairs, spearman_matrix
from labelscope.operators.sampling import hash_step, last_steps
from labelscope.roles import Roles

ROLES = Roles(label="y", ignore=("id",))
LINES = "/root/testdata/sf0.001/lineitem.parquet"


def _table(spark, n=4000):
    rng = np.random.default_rng(5)
    few = rng.integers(0, 7, n).astype(float)
    pdf = pd.DataFrame({"id": range(n), "y": rng.integers(0, 2, n), "few": few})
    pdf["halves"] = rng.integers(0, 40, n) / 2
    pdf["wide"] = rng.normal(0, 1, n) + few
    pdf["also"] = rng.lognormal(0, 2, n) + pdf["halves"]
    pdf.loc[::9, "few"] = None
    pdf.loc[::11, "wide"] = None
    df = spark.createDataFrame(pdf).withColumn("few", F.when(~F.isnan("few"), F.col("few")))
    return df.withColumn("wide", F.when(~F.isnan("wide"), F.col("wide"))), pdf.drop(columns="id")


@pytest.mark.parametrize("values", [0, 10, 2_000, 10_000])
def test_listed_and_ranged_columns_give_the_same_matrix(spark, monkeypatch, values):
    """None, some and all columns ranked by lookup; nulls at the median."""
    monkeypatch.setattr(correlation, "DICTIONARY_VALUES", values)
    df, pdf = _table(spark)
    expected = pdf.fillna(pdf.median()).corr(method="spearman")
    rows = spearman_matrix(df.repartition(5), ROLES).collect()
    assert len(rows) == expected.size
    for r in rows:
        assert abs(r.spearman - expected.loc[r.feat1, r.feat2]) < 1e-9


def test_columns_of_few_values_are_not_shuffled(spark):
    lines = spark.read.parquet(LINES)
    few = lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_discount", "l_tax"
    )
    found = spearman_matrix(few, Roles(label="y"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x and "Reused" not in x]
    # the states of the tasks and the sums of the groups; no exchange by row or value
    assert [x for x in exchanges if "_row" in x or "fid" in x] == []
    expected = few.toPandas().astype(float).corr(method="spearman")
    for r in found.collect():
        assert abs(r.spearman - expected.loc[r.feat1, r.feat2]) < 1e-9


def test_as_many_tasks_scan_as_there_are_splits(spark, tmp_path):
    """Every split has its own task, and pairs are shuffled once per group."""
    path = str(tmp_path / "rows")
    df, pdf = _table(spark)
    df.repartition(40).write.parquet(path)
    seen = correlation._products

    def counted(m, groups, listed):
        inner = seen(m, groups, listed)

        def run(batches):
            from pyspark import TaskContext

            for batch in inner(batches):
                (tmp_path / f"task-{TaskContext.get().partitionId()}").touch()
                yield batch

        return run

    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    correlation._products = counted
    try:
        rows = pearson_matrix(spark.read.parquet(path), ROLES).collect()
    finally:
        correlation._products = seen
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list(tmp_path.glob("task-*"))) > 2 * correlation.GROUPS
    expected = pdf.fillna(pdf.median()).corr()
    for r in rows:
        assert abs(r.pearson - expected.loc[r.feat1, r.feat2]) < 1e-9


def test_only_points_near_the_cap_are_repeated(spark, monkeypatch):
    df, _ = _table(spark, 20_000)
    stored = {}
    keep = correlation.materialize

    def watched(rows, name):
        stored[name] = keep(rows, name)
        return stored[name]

    monkeypatch.setattr(correlation, "materialize", watched)
    pairs = [("few", "halves"), ("wide", "also"), ("few", "wide")]
    for cap in (50, 500, 100_000):
        found = scatter_pairs(df, ROLES, pairs, ["id"], cap=cap)
        counts = {(r.feat1, r.feat2): r["count"] for r in found.groupBy("feat1", "feat2").count().collect()}
        every = scatter_pairs(df, ROLES, pairs, ["id"], cap=10**6)
        whole = {(r.feat1, r.feat2): r["count"] for r in every.groupBy("feat1", "feat2").count().collect()}
        assert counts == {p: min(cap, n) for p, n in whole.items()}
        scatter_pairs(df, ROLES, pairs, ["id"], cap=cap)
        assert stored["scatter-points"].count() <= 1.15 * cap * len(pairs) + 100


@pytest.mark.parametrize("keys", [[], ["id"]])
def test_points_of_repeated_keys(spark, keys):
    """All rows share a key, so the hash says nothing: the cap holds anyway."""
    df, _ = _table(spark, 3000)
    same = df.withColumn("id", F.lit(1))
    found = scatter_pairs(same, ROLES, [("few", "wide"), ("y", "few")], keys, cap=100)
    assert found.count() == 100 and set(found.columns) >= {"feat1", "feat2", "x", "y"}


def test_last_steps(spark):
    rows = spark.range(10_000).select("id", ((F.col("id") + 1) / 10_000).alias("u"))
    rows = rows.withColumn("step", hash_step(F.col("u")))
    conditions = ["id % 2 = 0", "id < 30", "id >= 9990", "false"]
    last = last_steps(rows, "step", conditions, 100)
    for condition, step in zip(conditions, last):
        held = rows.where(condition)
        least = min(100, held.count())
        n = held.where(F.col("step") <= step).count() if step is not None else 0
        assert least <= n <= 1.2 * least + 5


def test_arrow_functions_need_no_package_on_the_workers(tmp_path):
    """What is sent to a worker loads where this package can't be imported."""
    from pyspark import cloudpickle

    from labelscope.operators import bootstrap

    sent = [
        correlation._products(3, 4, {0: (np.arange(2.0), np.arange(2.0))}),
        correlation._merge(3),
        bootstrap._collapser(5),
        bootstrap._merge,
        bootstrap._finisher(0.9),
    ]
    file = tmp_path / "functions"
    file.write_bytes(cloudpickle.dumps(sent))
    code = "import pickle, sys; print(len(pickle.load(open(sys.argv[1], 'rb'))), 'labelscope' in sys.modules)"
    run = subprocess.run(
        [sys.executable, "-c", code, str(file)], cwd=tmp_path, capture_output=True, text=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=False,
    )
    assert run.stdout.split() == ["5", "False"], run.stderr

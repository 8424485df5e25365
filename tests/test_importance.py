import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscope.operators import importance
from labelscope.operators.importance import (
    category_codes,
    importance_comparison,
    model_table,
    ordinal_encode,
    rf_importance,
    rf_importance_by_seed,
)
from labelscope.operators.information import information_values
from labelscope.plans.retention import retention_report
from labelscope.roles import Roles

ROLES = Roles(label="y", ignore=("id",))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 1500
    y = (rng.random(n) < 0.2).astype(int)
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "y": y,
            "strong": rng.normal(0, 1, n) + 2 * y,
            "weak": rng.normal(0, 1, n),
            "kind": rng.choice(["a", "b", "c"], n),
        }
    )
    pdf.loc[::7, "kind"] = None
    return spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double"))


def test_codes_are_lexicographic_and_dense(spark):
    values = ["pear", "apple", None, "Zebra", "apple", "fig"]
    df = spark.createDataFrame([(v,) for v in values], "s string").repartition(4)
    codes = {r.value: r.code for r in category_codes(df, ["s"]).collect()}
    assert codes == {v: i for i, v in enumerate(sorted({v or "Missing" for v in values}))}


def test_codes_across_many_ranges(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.pmod("id", F.lit(977))).alias("s"))
    codes = {r.value: r.code for r in category_codes(df, ["s"]).collect()}
    assert codes == {v: i for i, v in enumerate(sorted(f"k{i}" for i in range(977)))}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_encoding_by_broadcast_and_by_split_lookup(spark, monkeypatch, limit):
    monkeypatch.setattr(importance, "BROADCAST_CODES", limit)
    monkeypatch.setattr(importance, "FREQUENT", 0.05)
    rows = [(i, "hot" if i % 3 else f"v{i % 100:03d}", None if i % 5 else "x") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    codes = {v: i for i, v in enumerate(sorted({r[1] for r in rows}))}
    found = ordinal_encode(df, ["s", "t"]).collect()
    assert len(found) == 900
    for r in found:
        assert r.s == codes[rows[r.id][1]]
        assert r.t == (0.0 if rows[r.id][2] is None else 1.0)


def test_model_table_has_no_nulls_and_balanced_weights(table):
    prepared, features = model_table(table, ROLES)
    assert features == ["strong", "weak", "kind"]
    assert prepared.dropna().count() == 1500
    sums = {r._label: r.w for r in prepared.groupBy("_label").agg(F.sum("_weight").alias("w")).collect()}
    assert math.isclose(sums[0.0], 750) and math.isclose(sums[1.0], 750)


def test_forest_importance_and_comparison(table):
    by_seed = rf_importance_by_seed(table, ROLES, seeds=2, trees=10, depth=4)
    sums = by_seed.groupBy("seed").agg(F.sum("importance").alias("s")).collect()
    assert len(sums) == 2 and all(math.isclose(r.s, 1.0, rel_tol=1e-9) for r in sums)
    rf = rf_importance(by_seed)
    assert rf.first().feature == "strong"
    both = importance_comparison(information_values(table, ROLES), rf).collect()
    assert both[0].feature == "strong"
    assert both[0].iv_norm == 1.0 and both[0].rf_norm == 1.0
    assert len(both) == 3
    assert len(importance_comparison(information_values(table, ROLES), rf, top=1).collect()) == 1


def test_retention_keeps_missing_but_predictive_features(spark):
    rates = [("a", 0.9), ("b", 0.9), ("c", 0.1)]
    missing = spark.createDataFrame(rates, "feature string, missing_rate double")
    iv = spark.createDataFrame([("a", 0.2), ("b", 0.01), ("c", 0.5)], "feature string, iv double")
    assert [r.feature for r in retention_report(missing, iv).collect()] == ["a"]


def test_only_large_code_tables_are_shuffled(spark, monkeypatch):
    """One column of many values among small ones costs one shuffle join."""
    monkeypatch.setattr(importance, "BROADCAST_CODES", 100)
    df = spark.range(5000).select(
        "id",
        F.concat(F.lit("value "), "id").alias("many"),
        (F.col("id") % 2).cast("string").alias("flag"),
        (F.col("id") % 7).cast("string").alias("a.b"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        encoded = ordinal_encode(df, ["many", "flag", "a.b"])
        plan = encoded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1
    assert encoded.columns == df.columns
    assert {r["a.b"] for r in encoded.select("`a.b`").distinct().collect()} == set(range(7))


def test_forests_on_stated_rows_and_dotted_names(spark, table):
    dotted = table.withColumnRenamed("strong", "a.strong").drop("empty")
    found = rf_importance_by_seed(dotted, ROLES, seeds=1, trees=5, depth=3, fit_rows=500)
    by_name = {r.feature: r.importance for r in found.collect()}
    assert set(by_name) == {"a.strong", "weak", "kind"}
    assert max(by_name, key=by_name.get) == "a.strong"


def test_large_tables_are_fitted_one_seed_after_the_other(spark, table, monkeypatch):
    """Copies of the fitted rows that don't fit beside each other are not held at once."""
    seen = []

    def watched(spark, run, items, at_once):
        seen.append(at_once)
        return [[0.5, 0.25, 0.25] for _ in items]

    monkeypatch.setattr(importance, "together", watched)
    rf_importance_by_seed(table, ROLES)
    monkeypatch.setattr(importance, "HELD_ROWS", 3500)
    rf_importance_by_seed(table, ROLES)
    monkeypatch.setattr(importance, "HELD_ROWS", 100)
    rf_importance_by_seed(table, ROLES)
    assert seen == [5, 2, 1]

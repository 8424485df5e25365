"""Relations that stand for results which SQL can't give."""

import pytest
from pyspark.sql import functions as F

from labelscope.operators import describe, distribution
from labelscope.roles import Roles
from verification import inputs, relations

ROLES = Roles(label="y", ignore=("id",))


@pytest.fixture(scope="module")
def table(spark):
    value = F.when(F.col("id") % 11 > 0, F.sin(F.col("id").cast("double")) * 100)
    return spark.range(4000).select(
        "id",
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        value.alias("wave"),
        (F.col("id") % 40).alias("few"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(7.0).alias("flat"),
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kernels_are_added_up_inside_the_tasks(table):
    found = relations.curve_error(table, ROLES)
    assert {(r.feature, r.label, r.near) for r in found.collect()} == {
        (f, y, True) for f in ("wave", "few") for y in (0, 1)
    }
    # no row per value and point
    assert "MapInArrow" in _plan(found)


def test_a_wrong_curve_is_told(table, monkeypatch):
    curve = distribution.kde_curve
    monkeypatch.setattr(
        distribution,
        "kde_curve",
        lambda df, roles: curve(df, roles).withColumn(
            "density",
            F.col("density") * F.when((F.col("feature") == "few") & (F.col("label") == 1), 1.01).otherwise(1),
        ),
    )
    found = relations.curve_error(table, ROLES).collect()
    assert {(r.feature, r.label) for r in found if not r.near} == {("few", 1)}


def test_ranks_are_counted_without_ordering_a_feature(table):
    found = relations.sketch_ranks(table, ROLES)
    assert "Window" not in _plan(found)
    rows = found.collect()
    assert {(r.feature, r.percentile) for r in rows} == {
        (f, p) for f in ("y", "wave", "few", "flat") for p in describe.PERCENTILES
    }
    assert all(r.within for r in rows)


@pytest.mark.parametrize("off", [0.3, 15.0])
def test_a_percentile_that_is_no_value_or_far_off_is_told(table, monkeypatch, off):
    percentiles = describe.numeric_percentiles
    monkeypatch.setattr(
        describe,
        "numeric_percentiles",
        lambda *given: percentiles(*given).withColumn(
            "p50", F.when(F.col("feature") == "few", F.col("p50") + off).otherwise(F.col("p50"))
        ),
    )
    found = relations.sketch_ranks(table, ROLES).collect()
    assert {(r.feature, r.percentile) for r in found if not r.within} == {("few", "p50")}


def test_the_application_table_is_derived_from_small_parts(spark, monkeypatch):
    setting = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(setting), []
    monkeypatch.setattr(inputs, "_stored", {})
    monkeypatch.setattr(inputs, "materialize", lambda df, name: seen.append(spark.conf.get(setting)) or df)
    inputs.application_table(spark, "/root/testdata/sf0.001")
    assert seen == [str(32 << 20)] and spark.conf.get(setting) == before
    assert [inputs._smaller(s) for s in ("134217728b", "16m", "1g", "1024")] == [
        str(32 << 20),
        "16m",
        str(32 << 20),
        "1024",
    ]

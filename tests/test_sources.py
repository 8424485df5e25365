import datetime as dt
import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from labelscope.operators.sampling import cap_rows, cap_rows_per_group, hash_sample
from labelscope.plans.applications import ROLES, applications
from labelscope.plans.suite import full_report
from labelscope.roles import Roles
from labelscope.functions import uniform_hash
from labelscope.sources import (
    NULL_MARK,
    ensure_sample,
    materialize,
    read_csv,
    read_report,
    read_table,
    shared_folder,
    temporary_tables,
    write_csv,
    write_report,
)

FOLDER = "/root/testdata/sf0.001"


def test_read_table_by_path_and_by_name(spark):
    by_path = read_table(spark, f"{FOLDER}/nation.parquet")
    by_path.createOrReplaceTempView("nation_view")
    assert read_table(spark, "nation_view").count() == by_path.count() == 25


def test_csv_with_schema_and_inferred(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.1), (2, None, None)], "k int, s string, x double")
    path = write_csv(df, str(tmp_path / "t"))
    found = read_csv(spark, path, df.schema, NULL_MARK)
    assert sorted(found.collect()) == sorted(df.collect())
    assert read_csv(spark, path, null_mark=NULL_MARK).schema["x"].dataType.typeName() == "double"
    again = write_report(df, str(tmp_path / "p"), fmt="parquet")
    assert read_report(spark, again, df.schema, "parquet").count() == 2
    assert read_report(spark, path, df.schema).count() == 2
    plain = str(tmp_path / "plain")
    df.write.option("header", True).csv(plain)
    assert sorted(read_csv(spark, plain, df.schema).collect()) == sorted(df.collect())


def test_sample_is_written_once(spark, tmp_path):
    df = spark.range(5000)
    path = str(tmp_path / "sample")
    first = {r.id for r in ensure_sample(df, path, ["id"], 0.1).collect()}
    second = {r.id for r in ensure_sample(spark.range(10), path, ["id"], 0.1).collect()}
    assert first == second and 400 < len(first) < 600
    assert ensure_sample(df, path, ["id"], 0.5).count() > 2000
    # a write that failed half-way: some rows, and no note that it was finished
    broken = tmp_path / "broken"
    done = ensure_sample(df, str(broken), ["id"], 0.1).inputFiles()[0].removeprefix("file://")
    folder = Path(done).parents[1] / "done"
    for file in folder.iterdir():
        file.unlink()
    (folder / "_temporary").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(folder.parent / "rows"))
    assert {r.id for r in ensure_sample(df, str(broken), ["id"], 0.1).collect()} == first


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["", None, "a,b", 'q"q', '""', "line\nbreak", "cr\rx", "crlf\r\nx", "\\N", "\\", 'a\\"b']
    texts += [" lead", "trail ", "\t", "#c", "\n", '"', "é🙂", "null", "a\\", "x\u2028y", ",", "\x00"]
    start = dt.datetime(2020, 1, 2, 3, 4, 5, 123456)
    rows = [(i, t, start + dt.timedelta(microseconds=i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, a string, ts timestamp, b string")
    path = write_csv(df, str(tmp_path / "texts"))
    assert sorted(read_csv(spark, path, df.schema, NULL_MARK).collect()) == sorted(df.collect())


def test_samples_ignore_partitioning(spark):
    df = spark.range(20000)
    for draw in (lambda d: hash_sample(d, ["id"], 0.05), lambda d: cap_rows(d, 500, ["id"])):
        assert {r.id for r in draw(df).collect()} == {r.id for r in draw(df.repartition(13)).collect()}
    assert cap_rows(df, 500, ["id"]).count() == 500
    assert cap_rows(df, 50000, ["id"]).count() == 20000


def test_cap_per_group(spark):
    df = spark.range(30000).withColumn("g", F.when(F.col("id") < 40, "small").otherwise("large"))
    capped = cap_rows_per_group(df, 300, ["g"], ["id"]).groupBy("g").count()
    sizes = {r.g: r["count"] for r in capped.collect()}
    assert sizes == {"small": 40, "large": 300}


@pytest.mark.parametrize("seed", range(10))
def test_caps_lose_no_row_on_repeated_keys(spark, seed):
    df = spark.range(20_000).select((F.col("id") % 20).alias("k"), "id", (F.col("id") % 2).alias("g"))
    assert cap_rows(df, 5000, ["k"], seed).count() == 5000
    assert cap_rows(df, 5000, None, seed).count() == 5000
    assert cap_rows(df, 50_000, ["k"], seed).count() == 20_000
    sizes = {r.g: r["count"] for r in cap_rows_per_group(df, 2000, ["g"], ["k"], seed).groupBy("g").count().collect()}
    assert sizes == {0: 2000, 1: 2000}


def test_caps_of_equal_rows_and_null_groups(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.lit(None).cast("int").alias("g"))
    assert cap_rows(df, 700, ["k"]).count() == 700
    assert cap_rows_per_group(df, 700, ["g"], ["k"]).count() == 700
    assert cap_rows(df.limit(0), 700).count() == 0


def test_composite_keys_are_told_apart(spark):
    rows = [("a", None), (None, "a"), ("a|b", ""), ("a", "b|"), ("a\\", "N"), ("\\N", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    found = df.select(uniform_hash(["x", "y"], 1, portable=True)).collect()
    assert len(set(found)) == len(rows)


def test_roles_classify_columns(spark):
    schema = "id int, y string, b byte, d decimal(10,2), f float, s string, t date, flag boolean"
    df = spark.createDataFrame([], schema)
    roles = Roles(label="y", date="t", ignore=("id",))
    assert roles.numeric(df) == ["b", "d", "f"]
    assert roles.categorical(df) == ["s", "flag"]
    assert roles.with_ignored("s").features(df) == ["b", "d", "f", "flag"]


def test_shared_folder_prefers_the_session_setting():
    def session(configured, master="yarn"):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": configured}[key])
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_folder(session("hdfs://shared/scratch/")) == "hdfs://shared/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(None))


def test_stored_tables_keep_rows_and_schema(spark):
    df = spark.range(7).withColumn("s", F.lit("x"))
    stored = materialize(df, "small")
    assert stored.schema.names == df.schema.names and stored.count() == 7
    assert stored.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark))


def test_temporary_tables_are_removed(spark):
    kept = materialize(spark.range(3), "kept")
    with temporary_tables(spark):
        gone = materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert Path(gone).exists()
    assert not Path(gone).parent.exists()
    assert kept.count() == 3


@pytest.fixture(scope="module")
def table(spark):
    return materialize(applications(spark, FOLDER), "applications")


def test_full_report_writes_every_table(spark, table, tmp_path):
    out = str(tmp_path)
    full_report(table, ROLES, out, ["application_id"], seeds=1, trees=3, depth=3)
    expected = {
        "missing_rates": 13,
        "basic_stats_numeric_features": 12,
        "basic_stats_categorical_features": 3,
        "relationship_age_fraud_stats": 4,
        "application_volume_stats": 3,
        "correlation_all_features_pearson": 11,
        "correlation_all_features_spearman": 11,
        "feature_importance/information_values": 13,
        "feature_importance/rf_feature_importance": 13,
        "feature_importance/iv_vs_rf": 13,
    }
    for name, rows in expected.items():
        assert read_csv(spark, f"{out}/{name}", null_mark=NULL_MARK).count() == rows, name
    more = ("monthly_high_level_stats", "correlation_high_pairs", "correlations/points", "retention")
    for name in more:
        assert read_csv(spark, f"{out}/{name}", null_mark=NULL_MARK).count() > 0, name


def test_full_report_searches_quantiles_few_times(spark, table, tmp_path, monkeypatch):
    """One search for all shared quantiles; clipping and Spearman need their own."""
    from labelscope.operators import quantiles

    calls = []
    search = quantiles._order_statistics
    monkeypatch.setattr(
        quantiles, "_order_statistics", lambda *a: calls.append(1) or search(*a)
    )
    full_report(table, ROLES, str(tmp_path), ["application_id"], seeds=1, trees=2, depth=2)
    assert len(calls) <= 5


def test_reports_scan_only_their_columns(spark, table):
    from labelscope.operators.trend import monthly_stats

    plan = monthly_stats(table, ROLES)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<applicationdate:date,booked:int,label:int>" in plan


def test_top_categories_are_cut_before_the_shuffle(table):
    from labelscope.operators.distribution import category_rates

    plan = category_rates(table, ROLES)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_plans_have_no_cross_join(table):
    from labelscope.operators.distribution import density_histogram, kde_curve
    from labelscope.operators.information import information_values

    for df in (
        information_values(table, ROLES),
        density_histogram(table, ROLES, "auto"),
        kde_curve(table, ROLES),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lookbacks_of_a_customer_with_half_of_all_orders(spark, tmp_path):
    rng = random.Random(7)
    start = dt.date(1996, 1, 1)
    orders = [
        (
            k,
            1 if rng.random() < 0.5 else rng.randrange(2, 9),
            "O",
            float(k),
            dt.datetime.combine(start + dt.timedelta(days=rng.randrange(300)), dt.time()),
            "1-URGENT",
        )
        for k in range(400)
    ]
    tables = {
        "orders": spark.createDataFrame(
            orders,
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
            "o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(50),
        "customer": spark.read.parquet(f"{FOLDER}/customer.parquet"),
        "nation": spark.read.parquet(f"{FOLDER}/nation.parquet"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.application_id: r for r in applications(spark, str(tmp_path)).collect()}
    assert len(found) == 400
    for key, customer, _, _, when, _ in orders:
        same = [(o[4].date(), o[0]) for o in orders if o[1] == customer]
        day = when.date()
        earlier = [d for d, k in same if (d, k) < (day, key)]
        row = found[key]
        expected = (day - max(earlier)).days if earlier else None
        assert row.days_since_last_application == expected
        in_month = sum(1 <= (day - d).days <= 30 for d, _ in same)
        assert row.total_apps_in_last_30_days == in_month
        assert row.max_open_age == (day - min(d for d, _ in same)).days / 365.25

"""Codes fitted on one table and applied to another."""

import pytest
from pyspark.sql import functions as F

from labelscope.operators.encoding import (
    code_versions,
    encode,
    fit_codes,
    load_codes,
    ordinal_encode,
    save_codes,
)


def _plain(fitted, rows, columns):
    """Codes by sorting the distinct values in plain Python."""
    codes = {
        c: {v: float(i) for i, v in enumerate(sorted({r[c] or "Missing" for r in fitted}))}
        for c in columns
    }
    return [{**r, **{c: codes[c].get(r[c] or "Missing", -1.0) for c in columns}} for r in rows]


def _rows(start, n):
    return [
        {
            "id": i,
            "few": ["a", "b", None][i % 3],
            "many": f"v{i * 7 % 501:04d}" if i % 4 else "hot",
            "a.b": None if i % 5 == 0 else f"w{i % 301}",
            "text": f"t {i}" if i % 3 else "new in the second table" if start else "old",
        }
        for i in range(start, start + n)
    ]


SCHEMA = "id int, few string, many string, `a.b` string, text string"
FEATURES = ["few", "many", "a.b", "text"]


@pytest.mark.parametrize("frequent", [1e-3, 0.05, 0.9])
@pytest.mark.parametrize("limit", [0, 10, 200_000])
def test_another_table_is_encoded_by_the_fitted_codes(spark, limit, frequent):
    fitted, other = _rows(0, 900), _rows(700, 900)
    table = fit_codes(spark.createDataFrame(fitted, SCHEMA), FEATURES)
    found = encode(
        spark.createDataFrame(other, SCHEMA).repartition(5), table, limit, frequent=frequent
    )
    assert found.columns == list(other[0])
    got = sorted((r.asDict() for r in found.collect()), key=lambda r: r["id"])
    wanted = _plain(fitted, other, FEATURES)
    assert got == wanted
    assert {r["text"] for r in got} >= {-1.0} and {r["few"] for r in got} == {0.0, 1.0, 2.0}


def test_three_large_columns_share_one_join(spark):
    df = spark.range(20_000).select(
        "id",
        *[F.concat(F.lit(f"{c} "), (F.col("id") * k).cast("string")).alias(c) for c, k in
          (("x", 1), ("y", 3), ("z", 7))],
        (F.col("id") % 7).cast("string").alias("few"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ordinal_encode(df, ["x", "y", "z", "few"], broadcast_codes=100)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1
    sums = found.agg(*[F.sum(c) for c in ("x", "y", "z")], F.max("few")).first()
    assert tuple(sums) == (*[20_000 * 19_999 / 2] * 3, 6.0)


def test_a_hot_value_is_not_shuffled(spark):
    """A value on half of the rows, seen in the fit or not, meets no shuffle join."""
    fit = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("x"))
    table = fit_codes(fit, ["x"])
    for hot in ("v17", "never seen"):
        rows = spark.range(40_000).select(
            "id", F.when(F.col("id") % 2 == 0, hot).otherwise(F.concat(F.lit("v"), "id")).alias("x")
        )
        found = encode(rows, table, broadcast_codes=0)
        counts = {r.x: r["count"] for r in found.groupBy("x").count().collect()}
        wanted = table.codes.where("value = 'v17'").first().code if hot == "v17" else -1.0
        assert counts[wanted] >= 20_000
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # what enters the lookup are the cells without a code
        assert "isnull" in plan


def test_versions_are_stored_whole(spark, tmp_path):
    path = str(tmp_path / "codes")
    assert code_versions(spark, path) == []
    with pytest.raises(ValueError, match="no codes"):
        load_codes(spark, path)
    first = spark.createDataFrame(_rows(0, 300), SCHEMA)
    second = spark.createDataFrame(_rows(300, 300), SCHEMA)
    assert save_codes(fit_codes(first, FEATURES), path) == 1
    assert save_codes(fit_codes(second, ["few", "text"]), path) == 2
    # what a failed write leaves behind has no note
    fit_codes(first, FEATURES).codes.write.parquet(f"{path}/codes/left-behind")
    assert code_versions(spark, path) == [1, 2]
    assert load_codes(spark, path).features == ("few", "text")
    old = load_codes(spark, path, 1)
    got = sorted((r.asDict() for r in encode(second, old).collect()), key=lambda r: r["id"])
    assert got == _plain(_rows(0, 300), _rows(300, 300), FEATURES)
    with pytest.raises(ValueError, match="version 3"):
        load_codes(spark, path, 3)


def test_empty_tables(spark):
    rows = spark.createDataFrame(_rows(0, 30), SCHEMA)
    none = fit_codes(rows.limit(0), FEATURES)
    for limit in (0, 1000):
        unseen = encode(rows, none, limit).select(*[f"`{c}`" for c in FEATURES]).distinct().collect()
        assert [tuple(r) for r in unseen] == [(-1.0,) * 4]
        assert encode(rows.limit(0), fit_codes(rows, FEATURES), limit).collect() == []
    # only fitted columns
    alone = encode(rows.select("many", "text"), fit_codes(rows, ["many", "text"]), 0)
    assert alone.count() == 30 and alone.where("many < 0 or text < 0").isEmpty()

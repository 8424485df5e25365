"""Report sets that appear as a whole, and CSV files that are read in splits."""

import pytest
from pyspark.sql import functions as F

from labelscope.sources import (
    NULL_MARK,
    publish,
    published_report,
    published_runs,
    read_csv,
    write_csv,
    write_report,
)


def test_a_failed_run_leaves_the_old_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert published_runs(spark, path) == []
    with pytest.raises(ValueError, match="no complete run"):
        published_report(spark, path, "one")

    def run(value, fail=False):
        def write(folder):
            for name in ("one", "two"):
                write_report(spark.createDataFrame([(value, name)], "k int, s string"), f"{folder}/{name}")
                if fail:
                    raise RuntimeError("half-way")

        return write

    first = publish(spark, path, run(1))
    with pytest.raises(RuntimeError, match="half-way"):
        publish(spark, path, run(2, fail=True))
    assert published_runs(spark, path) == [first]
    schema = "k int, s string"
    for name in ("one", "two"):
        assert [tuple(r) for r in published_report(spark, path, name, schema).collect()] == [(1, name)]
    publish(spark, path, run(3))
    assert [r.k for r in published_report(spark, path, "two", schema).collect()] == [3]
    assert len(published_runs(spark, path)) == 2


def _texts(spark, n=20_000):
    return spark.range(n).select(
        "id",
        F.concat(F.lit('say "x", '), F.col("id"), F.lit("; a, b\\ é")).alias("s"),
        F.when(F.col("id") % 3 != 0, F.lit("")).alias("t"),
        (F.col("id") / 7).alias("x"),
    )


def test_files_without_line_breaks_are_read_in_splits(spark, tmp_path):
    df = _texts(spark).coalesce(1)
    path = write_csv(df, str(tmp_path / "plain"))
    broken = df.withColumn("s", F.when(F.col("id") == 17, F.lit("two\nlines")).otherwise(F.col("s")))
    other = write_csv(broken, str(tmp_path / "broken"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        for folder, rows, several in ((path, df, True), (other, broken, False)):
            found = read_csv(spark, folder, rows.schema, NULL_MARK)
            assert (found.rdd.getNumPartitions() > 1) == several
            assert found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()
        # told by the caller
        assert read_csv(spark, path, df.schema, NULL_MARK, line_breaks=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb", "a\rb"])
def test_the_note_goes_when_line_breaks_come(spark, tmp_path, text):
    path = str(tmp_path / "t")
    plain = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    broken = spark.createDataFrame([(3, text)], "k int, s string")
    note = tmp_path / "t" / "_one_line_a_row"
    write_csv(plain, path)
    assert note.exists()
    write_csv(broken, path, mode="append")
    assert not note.exists()
    both = sorted(read_csv(spark, path, plain.schema, NULL_MARK).collect())
    assert both == sorted(plain.union(broken).collect())
    write_csv(plain, path, mode="append")
    assert not note.exists()
    write_csv(plain, path, mode="overwrite")
    assert note.exists()
    # numbers alone, and no rows at all
    write_csv(plain.select("k"), path, mode="overwrite")
    assert note.exists()
    write_csv(broken.limit(0), path, mode="overwrite")
    assert read_csv(spark, path, plain.schema, NULL_MARK).count() == 0


def test_the_full_report_is_published(spark, tmp_path):
    from labelscope.plans.suite import published_full_report
    from labelscope.roles import Roles

    rows = [(i, i % 2, float(i % 9), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, x double, s string")
    roles = Roles(label="y", ignore=("id",))
    out = str(tmp_path / "out")
    run = published_full_report(df, roles, out, ["id"], seeds=1, trees=2, depth=2)
    assert published_runs(spark, out) == [run]
    found = published_report(spark, out, "missing_rates")
    assert {r.feature for r in found.collect()} == {"x", "s"}

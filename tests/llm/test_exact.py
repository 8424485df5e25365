"""Exact duplicates: the merge tree against plain grouping."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelscope.llm import exact
from tests.llm.brute import FOLD

SCHEMA = "doc_id bigint, text string"


def _expected(rows, best):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(FOLD)].append(doc)
    out = []
    for doc, text in rows:
        folded = (text or "").translate(FOLD)
        own = groups[folded]
        keep = best((d for d in own if d is not None), default=None)
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256(folded.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(df):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize(("runs", "fan_in"), [(64, 8), (16, 2), (3, 2), (1, 2)])
def test_merge_tree_equals_grouping(spark, keep, runs, fan_in):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "A", "b c", "É", "é", "x" * draw.randrange(40)])) for i in range(900)]
    # one text on a third of the rows
    rows += [(1000 + i, "hot text") for i in range(450)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = exact.exact_duplicates(df, keep=keep, runs=runs, fan_in=fan_in)
    assert _found(found) == _expected(rows, {"smallest": min, "largest": max}[keep])


def test_odd_rows(spark):
    long = "Long " * 400_000
    rows = [
        (1, None),
        (2, ""),
        (None, ""),
        (3, long),
        (4, long.upper()),
        (None, "alone"),
        (None, "ALONE"),
        (5, "same"),
        (5, "same"),
        (5, "other"),
        (6, "İ"),
        (7, "i̇"),
        (8, " same"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("digest", F.lit(1)).withColumn("KEEP_ID", F.lit("x"))
    assert _found(exact.exact_duplicates(df)) == _expected(rows, min)
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # a group of null ids only keeps them all, and rows of one id and text stay together
    assert ids == sorted([1, 3, None, None, 5, 5, 5, 6, 7, 8], key=str)
    assert exact.exact_duplicates(df.limit(0)).collect() == []
    assert exact.drop_copies(df.limit(0)).collect() == []


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    for found in (exact.exact_duplicates(df), exact.drop_copies(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_round_is_one_exchange_into_sorted_runs(spark):
    """Partitions are ranges of digests of a group of runs, as many in every round."""
    df = spark.range(3000).select("id", F.concat(F.lit("t"), F.col("id") % 700).alias("text"))
    digests = exact._digested(df, "id", "text")
    for runs, fan_in, rounds in ((64, 8, 2), (64, 4, 3), (64, 2, 6)):
        merged = exact.merged_runs(digests, runs=runs, fan_in=fan_in)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange" in x]
        assert len(exchanges) == rounds
        assert all("REPARTITION_BY_NUM" in x or "shufflepartitionidpassthrough" in x.lower()
                   for x in exchanges), exchanges
        # a merge needs no sort of its own
        assert plan.count("Sort [part") == rounds
        assert merged.count() == 700
        parts = merged.select(F.spark_partition_id().alias("p"), F.hex("digest").alias("d"))
        edges = parts.groupBy("p").agg(F.min("d").alias("low"), F.max("d").alias("high")).orderBy("p").collect()
        assert len(edges) > runs / 2
        assert all(a.high < b.low for a, b in zip(edges, edges[1:]))


def test_runs_follow_the_rows():
    assert exact._run_count(0) == 64 and exact._run_count(64 * 250_000) == 64
    assert exact._run_count(64 * 250_000 + 1) == 512
    assert exact._run_count(10**15) == exact.MOST_RUNS

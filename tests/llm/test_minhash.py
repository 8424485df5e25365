"""Near duplicates against all common shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import exact, minhash, tables
from labelscope.llm.components import components
from labelscope.llm.queries import queries
from tests.llm.brute import FOLD, near_components

SCHEMA = "doc_id bigint, text string"


def _rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def _expected(rows, k, percent):
    return {i: (n, c, i == c) for i, (n, c) in near_components(rows, k, percent).items()}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    found = _rows(queries()["op1_near_duplicates"](spark, folder))
    assert found == _expected(rows, 4, 80)
    assert any(not kept for _, _, kept in found.values())


def test_edited_copies_of_any_length(spark):
    """Chains and stars of edits around the threshold, from 4 to 400 words."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(60):
        words = draw.choices(vocabulary, k=draw.choice([4, 5, 8, 14, 40, 90, 400]))
        for copy in range(6):
            rows.append((group * 10 + copy, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) * copy // 90)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
    found = _rows(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert found == _expected(rows, 5, 80)


def test_large_group_of_different_copies(spark, monkeypatch):
    """More members than a block, some of them linked only to other members."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(i % 9):
            words[draw.randrange(200)] = f"x{draw.random()}"
        rows.append((i, " ".join(words)))
    found = _rows(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert found == _expected(rows, 5, 80)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "One two"),
        (5, "one TWO"),
        (6, "one"),
        (7, "É two"),
        (8, "é two"),
        (9, long),
        (10, long + " end"),
        (None, "one two"),
        (4, "one  two"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("KEPT", F.lit(2))
    found = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()),
        key=str,
    )
    n = 300_000 - 4
    assert found == sorted(
        [
            (1, 0, 1, True),
            (2, 0, 2, True),
            (3, 0, 3, True),
            (4, 1, 4, True),
            (4, 1, 4, True),
            (5, 1, 4, False),
            (6, 1, 6, True),
            (7, 1, 7, True),
            (8, 1, 8, True),
            (9, n, 9, True),
            (10, n + 1, 9, False),
            (None, 1, 4, False),
        ],
        key=str,
    )
    assert minhash.near_duplicates(df.where("doc_id < 0")).collect() == []


def test_registers_hold_leading_zeros_and_mantissa():
    least = np.full((1, minhash.BUCKETS), np.uint64(1) << np.uint64(56), np.uint64)
    least[0, 1] = (np.uint64(1) << np.uint64(50)) | (np.uint64(1) << np.uint64(49))
    first, second = minhash.registers(least)[0, :2]
    assert first == 0
    assert second == (6 << 10) | 512


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a int, b int")
    found = {r.node: r.comp for r in components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_links_beside_the_hub_are_found(spark):
    """Pairs of alike documents in bands whose hub is like neither of them."""
    draw = random.Random(9)
    rows = []
    for group in range(150):
        base = [f"g{group}w{i}" for i in range(100)]
        for copy in range(5):
            words = list(base)
            start = 20 * copy
            words[start : start + 20] = [f"c{copy}x{draw.random()}" for _ in range(20)]
            rows.append((len(rows), " ".join(words)))
            words[draw.randrange(100)] = "edited"
            rows.append((len(rows), " ".join(words)))
    found = _rows(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert found == _expected(rows, 5, 80)


def test_kept_is_having_the_id_of_the_component(spark):
    """As the query's contract says, also where ids repeat or are null."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (3, text.upper()), (9, text), (None, text), (5, ""), (5, None)]
    rows += [(None, "one two three four five six")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(df, shingle=4, percent=80).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.kept == (r.doc_id == r.component_id)
    assert sum(r.kept and r.component_id == 3 for r in found) == 3


@pytest.mark.parametrize("bits", [8, 1 << 27])
def test_a_small_filter_gives_the_same_rows(spark, monkeypatch, bits):
    """A filter of one byte rules out next to nothing, and no result depends on it."""
    monkeypatch.setattr(tables, "BITMAP", min(bits, 32_768))
    monkeypatch.setattr(tables, "FILTER_BITS", bits)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    components = near_components(rows, 5, 80)
    kept = {i for i, (_, c) in components.items() if i == c}
    assert {r.doc_id for r in minhash.drop_near_duplicates(docs, one_row=True).collect()} == kept
    least = {}
    for i, t in rows:
        least[(t or "").translate(FOLD)] = min(i, least.get((t or "").translate(FOLD), i))
    assert {r.doc_id for r in exact.drop_copies(docs, one_row=True).collect()} == set(least.values())


def test_the_filter_never_rules_out_a_key(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("key"))
    found = tables.maybe_among(rows, "key", keys, "may")
    assert found.where("id < 500 and not may").isEmpty()
    # 16 bits a key
    assert found.where("may").count() < 500 + 0.1 * 100_000
    assert tables.maybe_among(rows, "key", keys.limit(0), "may").where("may").isEmpty()


def test_corrections_agree(spark):
    """The column and the array form of the corrected estimate."""
    cases = [(0, 10, 10), (128, 300, 300), (90, 50, 400), (17, 1000, 3)]
    df = spark.createDataFrame(np.array(cases, float).tolist(), "m double, a double, b double")
    column = [r[0] for r in df.select(minhash.corrected_estimate(F.col("m"), F.col("a"), F.col("b"))).collect()]
    m, a, b = np.array(cases, float).T
    assert np.allclose(minhash.corrected_share(m, np.minimum(a, b), np.maximum(a, b)), column)
    assert column[0] < 0 and column[1] == 1.0

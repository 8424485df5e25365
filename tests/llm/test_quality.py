"""Measures against plain Python, host verdicts against their formula."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelscope.llm import quality
from tests.llm.brute import WORD


def _plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + k
        for i in range(len(words) - 2)
        for k in range(3)
        if windows[tuple(words[i : i + 3])] > 1
    }
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines),
        len(lines) - len(set(lines)),
        len(covered),
    ]


def test_measures_equal_plain_python():
    draw = random.Random(8)
    parts = ["a", "b", "a b", "\n", "\n\n", " ", "\t", "é#", "<b>", "日本", "\r\n", "x\x0by", " ", "🙂"]
    texts = [None, "", "\n", " a", "a a a a", "a\n", "\na\na"]
    texts += ["".join(draw.choices(parts, k=draw.randrange(1, 40))) for _ in range(3000)]
    found = np.concatenate(list(quality.measures(pa.array(texts))), axis=1).T.tolist()
    assert found == [_plain(t) for t in texts]


def test_few_documents_prove_little(spark):
    """A bad host with many documents goes, one with a single bad document stays."""
    good = " ".join(f"word{i}" for i in range(60))
    bad = good + " " + "# " * 40
    rows = [(i, f"h{i % 10}", good) for i in range(1000)]
    rows += [(2000 + i, "bad", bad) for i in range(200)] + [(3000, "bad", good)]
    rows += [(4000, "single", bad), (4001, None, bad), (4002, "h1", None), (4003, "h1", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    df = df.withColumn("host", F.lit(1)).withColumn("N_WORDS", F.lit(1))
    found = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(found) == len(rows)
    assert not found[3000].kept and not found[3000].base_failed
    assert found[4000].kept and found[4001].kept and found[0].kept
    assert found[4002].base_failed and found[4003].base_failed and not found[4002].kept
    assert quality.judged(df.limit(0)).collect() == []


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {(r.doc_id, r.kept) for r in quality.judged(df).collect()}
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    assert {(r.doc_id, r.kept) for r in quality.judged(df).collect()} == one


def test_prior_weight_follows_the_spread_between_hosts():
    rng = np.random.default_rng(3)
    n = rng.integers(50, 400, 4000).astype(float)
    failed = rng.binomial(n.astype(int), rng.beta(2, 6, 4000)).astype(float)
    mean = failed.sum() / n.sum()
    weight = quality.prior_weight(
        mean, float((failed**2 / n).sum()), int(n.sum()), len(n), float((n**2).sum())
    )
    assert abs(mean - 0.25) < 0.02 and 7 < weight < 9


def test_a_long_text(spark):
    text = "one two three " * 400_000
    df = spark.createDataFrame([(1, "s", text)], "doc_id bigint, source string, text string")
    row = quality.judged(df).first()
    assert (row.n_words, row.n_repeat_words) == (1_200_000, 1_200_000)

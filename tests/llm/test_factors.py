"""The factorisation machine: its identity, its gradient, held-out labels, odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelscope.llm import factors
from labelscope.llm.queries import op11_quality_scores


def _machine(n, rank=3, seed=1):
    draw = np.random.default_rng(seed)
    return factors.Machine(0.3, draw.normal(size=n), draw.normal(size=(n, rank)))


def _pairwise(machine, which, values):
    total = machine.base + sum(machine.weights[i] * x for i, x in zip(which, values))
    for a in range(len(which)):
        for b in range(a + 1, len(which)):
            total += machine.vectors[which[a]] @ machine.vectors[which[b]] * values[a] * values[b]
    return total


def _rows(seed=2, docs=40, n=30):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(0, 9, docs)
    which = np.concatenate([draw.choice(n, s, replace=False) for s in sizes]).astype(np.int64)
    return which, draw.normal(size=len(which)), np.concatenate([[0], np.cumsum(sizes)])


def test_sum_of_squares_equals_all_pairs():
    machine = _machine(30)
    which, values, firsts = _rows()
    found = machine.logits(which, values, firsts)
    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        assert abs(found[i] - _pairwise(machine, which[a:b], values[a:b])) < 1e-9


def test_a_step_follows_the_gradient(monkeypatch):
    """One step on one row moves every parameter against the numeric gradient."""
    monkeypatch.setattr(factors, "PASSES", 1)
    monkeypatch.setattr(factors, "LEAST_STEPS", 1)
    monkeypatch.setattr(factors, "SHRINK", 0.0)
    machine = _machine(6)
    which, values = np.array([0, 2, 5]), np.array([0.5, -1.0, 2.0])
    firsts, label = np.array([0, 3]), np.array([1.0])

    def loss(m):
        return float(np.log1p(np.exp(-m.logits(which, values, firsts)))[0])

    after = factors._trained(machine, which, values, firsts, label, 0)
    for name in ("weights", "vectors"):
        old, new = getattr(machine, name), getattr(after, name)
        for place in np.ndindex(old.shape):
            moved = [np.array(old) for _ in range(2)]
            moved[0][place] += 1e-5
            moved[1][place] -= 1e-5
            up, down = (
                factors.Machine(machine.base, *((m, machine.vectors) if name == "weights" else (machine.weights, m)))
                for m in moved
            )
            slope = (loss(up) - loss(down)) / 2e-5
            step = new[place] - old[place]
            assert abs(step) < 1e-12 if abs(slope) < 1e-9 else step * slope < 0


def test_features_equal_plain_python():
    draw = random.Random(3)
    parts = ["a", "b ", "AB ", "a!", "\n", " ", "é", "9", "日本 ", "x# ", "x# ", "\t"]
    texts = [None, "", " ", "\n\n", "Ab AB ab"] + [
        "".join(draw.choices(parts, k=draw.randrange(0, 50))) for _ in range(500)
    ]
    for low, high, which, values, firsts in factors.features(pa.array(texts)):
        for i in range(low, high):
            own = which[firsts[i - low] : firsts[i - low + 1]]
            words = re.findall(r"[^\x20\x09-\x0d]+", (texts[i] or "").lower())
            hashed = own[own < 1 << factors.WORD_BITS]
            assert len(hashed) == len(set(words))
            steps = own[own >= 1 << factors.WORD_BITS] - (1 << factors.WORD_BITS)
            assert len(steps) == 2 * len(factors.STATISTICS)
            assert ((steps // factors.CELLS)[::2] == np.arange(len(factors.STATISTICS))).all()
            named = dict(zip(factors.STATISTICS, steps[::2] % factors.CELLS, strict=True))
            share = len(set(words)) / max(len(words), 1)
            assert named["distinct_words"] == min(int(np.sqrt(share) * 24), 23)
            top = max(map(words.count, words), default=0) / max(len(words), 1)
            assert named["top_word"] == min(int(np.sqrt(top) * 24), 23)
            same = sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)
            assert named["same_neighbours"] == min(int(np.sqrt(same) * 24), 23)
            assert np.isfinite(values).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = op11_quality_scores(spark, folder)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 500
    good = [r.predicted for r in held if r.quality == 1]
    bad = [r.predicted for r in held if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_held_out_labels_are_never_read(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality"))
        .otherwise(F.col("quality")),
    )
    # other columns tell nothing either
    other = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    one = {r.doc_id: r.score for r in factors.scored(docs, labels, held_out=held_out).collect()}
    two = {r.doc_id: r.score for r in factors.scored(other, turned, held_out=held_out).collect()}
    assert one == two


def test_odd_rows(spark):
    """Nulls, several labels and texts of an id, clashing names, one class, empty tables."""
    good = " ".join(f"word{i}" for i in range(60))
    bad = "###!! " * 60
    rows = [(i, good if i % 2 else bad, i % 2) for i in range(200)]
    rows += [(None, good, 1), (300, None, None), (301, "", 0), (302, good * 2000, 5), (1, bad, 1), (1, good, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind int")
    docs = docs.withColumn("score", F.lit("x")).withColumn("which", F.lit(1)).withColumn("id", F.lit(9))
    marks = [(i, i % 2) for i in range(200)] + [(4, 0), (4, 0), (None, 1), (301, None), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    found = factors.scored(docs, labels, metadata=("score",)).collect()
    assert len(found) == len(rows)
    scores = {r.doc_id: r.score for r in found if r.doc_id is not None and r.doc_id != 1}
    assert scores[3] > 0.9 and scores[2] < 0.1 and 0 <= scores[300] <= 1
    assert not any(r.held_out for r in found)
    assert factors.scored(docs.limit(0), labels, metadata=()).collect() == []
    none = factors.scored(docs, labels.limit(0), metadata=()).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    only = factors.scored(docs, labels.where("quality = 1"), metadata=()).collect()
    assert min(r.score for r in only) > 0.9


def test_the_sample_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id", "concat('some text ', id) as text")
    labels = spark.range(5000).selectExpr("id", "cast(id % 2 as int) as label")
    found = factors.labelled_features(docs.union(docs), labels, fit_rows=500)
    assert 350 < found.count() < 650 and found.select("id").distinct().count() == found.count()

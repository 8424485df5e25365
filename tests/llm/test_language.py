"""Language shares: held-out accuracy, known mixtures, brute-force likelihood."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from labelscope.llm import language
from labelscope.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"


def _docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out_accuracy(spark):
    found = queries()["op3_languages"](spark, FOLDER)
    rows = found.join(_docs(spark).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 200
    assert np.mean([r.lang_pred == r.lang for r in unseen]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.score for r in rows]) > 0.95


def test_mixtures_are_recovered(spark):
    docs = _docs(spark).where("n_chars between 1500 and 6000")
    model = language.fitted(docs, fit_rows=100)
    own = {
        name: next(
            r.text for r in docs.where(F.col("lang") == name).orderBy("doc_id").collect()
        )[:1500]
        for name in model.languages
    }
    for a, b in itertools.combinations(model.languages, 2):
        mixed, alone = language.infer([own[a][:900] + " " + own[b][:600], own[a]], model)
        assert set(mixed) == {a, b}
        assert abs(mixed[a] - 0.6) < 0.1
        assert set(alone) == {a}


def test_em_reaches_the_best_grid_point(spark):
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(40), size=3).T)
    counts = rng.integers(1, 20, 40).astype(float)
    shares, value = language.mixture(counts, logs, rounds=500)
    grid = [
        float(counts @ np.log(np.exp(logs) @ np.array([i, j, 50 - i - j]) * 0.02 + 1e-300))
        for i in range(51)
        for j in range(51 - i)
    ]
    assert value >= max(grid) - 0.05
    assert abs(shares.sum() - 1) < 1e-9


def test_odd_rows(spark):
    rows = [
        (1, "the cat and the dog", "en"),
        (3, "der Hund und die Katze", "de"),
        (4, None, "en"),
        (5, "", None),
        (6, "123 !?", "en"),
        (6, "und der Hund", None),
        (None, "the dog", "fr"),
        (7, "the cat " * 200_000, None),
        (8, "É", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df = df.withColumn("SCORE", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    found = {(r.doc_id, r.lang_pred) for r in language.identified(df).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (6, "de"), (7, "en")} <= found
    assert not any(lang == "fr" for _, lang in found)
    kept = language.kept_languages(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 3, 6, 7, 8}
    nothing = language.identified(df.where("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identified(df.limit(0)).collect() == []


def test_small_shares_and_short_texts_equal_the_ungated_choice(spark):
    docs = _docs(spark).where("n_chars between 1500 and 6000")
    model = language.fitted(docs.where(~language.held_out()), fit_rows=100)
    unseen = docs.where(language.held_out()).orderBy("doc_id").select("lang", "text").collect()
    own = {name: [r.text for r in unseen if r.lang == name][:6] for name in model.languages}
    texts = []
    for a, b in itertools.permutations(model.languages, 2):
        for x, y in zip(own[a], own[b]):
            for size, share in ((40, 0.1), (80, 0.1), (200, 0.1), (300, 0.02), (1000, 0.02), (60, 0)):
                cut = round(size * (1 - share))
                texts.append(x[:cut] + " " + y[: size - cut])
    found = language.infer(texts, model)
    several = 0
    for text, shares in zip(texts, found, strict=True):
        buckets, _, _ = language.trigrams([text])
        start = int(model.logs[buckets].sum(axis=0, dtype=np.float64).argmax())
        free = language.language_set(buckets, model.logs, start)
        assert shares == {model.languages[k]: s for k, s in free.items()}, text
        several += len(free) > 1
    assert several > 20


def test_gain_bound_skips_only_what_is_proven():
    rng = np.random.default_rng(4)
    skipped = 0
    for _ in range(300):
        n = int(rng.integers(3, 400))
        logs = np.log(rng.dirichlet(np.full(60, 0.3), size=2).T + 1e-6)
        part = logs[rng.choice(60, n, p=(p := np.exp(logs[:, 0])) / p.sum())].astype(np.float32)
        least = language.penalty(n) * language.OVERLAP
        share = np.linspace(0, 1, 2001)[:, None]
        ratio = np.exp((part[:, 1] - part[:, 0]).astype(float))
        best = np.log1p(share * (ratio - 1)).sum(axis=1).max()
        if not language.may_gain(part, 0, least):
            skipped += 1
            assert best <= least
    assert skipped > 100

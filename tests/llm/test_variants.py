"""Spelling variants against a search of all one-edit neighbours in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.llm import variants
from labelscope.llm.queries import op12_spelling_variants
from tests.llm.brute import FOLD

SCHEMA = "word string, n bigint"


def _words(rows, deleted=199, least_chars=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % deleted == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def _neighbours(vocabulary):
    letters = sorted({c for w in vocabulary for c in w})
    found = {}
    for w in vocabulary:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        found[w] = {x for x in near if x != w and x in vocabulary}
    return found


def _plain(vocabulary, ratio=5):
    near = _neighbours(vocabulary)
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {
        w: (form[w], root(w), n, len(near[w]), vocabulary.get(form[w])) for w, n in vocabulary.items()
    }


def _found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = _plain(_words([tuple(r) for r in docs]))
    assert sum(f is not None for f, *_ in wanted.values()) > 100
    assert _found(op12_spelling_variants(spark, folder)) == wanted


def _vocabulary(seed, n, letters, sizes):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.choice(sizes))) for _ in range(n)}
    for w in list(words):
        k = draw.randrange(len(w))
        words.add(w[:k] + draw.choice(letters) + w[k + draw.randrange(2) :])
    return {w: draw.randrange(1, 2000) for w in words if w}


@pytest.mark.parametrize("broadcast", [0, 30, 20_000])
def test_frontier_finds_every_pair(spark, monkeypatch, broadcast):
    """Dense vocabularies with repeated letters, whichever way levels are joined."""
    monkeypatch.setattr(variants, "BROADCAST_EDGES", broadcast)
    for seed, letters, sizes in ((1, "ab", range(1, 8)), (2, "aéÿ", range(3, 7))):
        vocabulary = _vocabulary(seed, 120, letters, list(sizes))
        df = spark.createDataFrame(list(vocabulary.items()), SCHEMA)
        pairs = [(r.word, r.near, r.near_n) for r in variants.trie_neighbours(df).collect()]
        wanted = [(w, x, vocabulary[x]) for w, near in _neighbours(vocabulary).items() for x in near]
        assert sorted(pairs) == sorted(wanted)


def test_long_words_are_paired_too(spark):
    """Pairs over the depth of the trie, and all pairs where the trie has one level."""
    for seed, letters in ((3, "ab"), (4, "abé")):
        vocabulary = _vocabulary(seed, 150, letters, [1, 2, 3, 4, 5, 6])
        vocabulary |= {"a" * n: 5 for n in range(1, 60)} | {"a" * 40 + "b" + "a" * 20: 7}
        vocabulary |= {"a" * 61: 9, "ab" * 50: 3, "ba" + "ab" * 49: 4, "ab" * 49 + "a": 4}
        df = spark.createDataFrame(list(vocabulary.items()), SCHEMA)
        for depth in (1, 4, 32):
            short = df.where(F.length("word") <= depth)
            found = variants.trie_neighbours(short).union(variants.long_neighbours(df, depth))
            pairs = [tuple(r) for r in found.collect()]
            near = _neighbours(vocabulary)
            assert sorted(pairs) == sorted((w, x, vocabulary[x]) for w in near for x in near[w])


def test_chains_of_forms_end_at_their_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(23)] + [("x", "w3"), ("y", "x")]
    df = spark.createDataFrame(forms, "word string, form string")
    assert {r.word: r.root for r in variants.roots(df).collect()} == {w: "w23" for w, _ in forms}


def test_odd_rows(spark):
    """Nulls, repeated rows, ties of forms, clashing names, runs of a hundred thousand letters."""
    long = "xy" * 50_000
    rows = [(None, "Grösser grösser"), (1, None), (2, ""), (3, "grösser grosser 12 grosse")]
    rows += [(4, "colour color COLOUR colör")] * 9 + [(i, "flavour " * 30) for i in range(8)]
    rows += [(20 + i, f"flavor flavors {long} {long}z") for i in range(6)]
    rows += [(30 + i, "abcdefg bbcdefg cbcdefg " + "abcdefh bbcdefh " * 40) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.withColumn("word", F.lit("x")).withColumn("N", F.lit(1)).withColumn("id", F.lit(2))
    vocabulary = _words(rows)
    wanted = _plain({w: n for w, n in vocabulary.items() if len(w) < 1000})
    for w in (x for x in vocabulary if len(x) >= 1000):
        wanted[w] = (None, w, vocabulary[w], 1, None)
    assert _found(variants.variants(df)) == wanted
    assert variants.variants(df.limit(0)).collect() == []
    assert variants.variants(df.where("text is null")).collect() == []


def test_words_are_dealt_out_once_for_all_levels(spark, monkeypatch):
    """A frontier's plan has no shuffle of the words themselves."""
    plans = []
    keep = variants.stored

    def watched(df, name):
        if name == "frontier":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(variants, "stored", watched)
    words = spark.createDataFrame([("planet", 9), ("planets", 6), ("plane", 7)], "word string, n bigint")
    found = {(r.word, r.near) for r in variants.trie_neighbours(words).collect()}
    pairs = {("planet", "planets"), ("planet", "plane")}
    assert found == pairs | {(b, a) for a, b in pairs}
    assert plans and not any("hashpartitioning(word" in p for p in plans)

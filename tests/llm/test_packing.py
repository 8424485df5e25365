"""Packing: exact pieces, gapless windows, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelscope.llm import packing
from labelscope.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 2048


def _check(rows, texts):
    """Pieces cover each document, windows have no gaps; returns the share of padding."""
    whole = Tokenizer.from_file(PATH)
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    padding = tokens = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= WINDOW
        tokens += at
        padding += 0 if at & (at - 1) == 0 else WINDOW - at
    return padding / (padding + tokens)


def test_query_packs_every_token(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries()["op5_pack_windows"](spark, folder).collect()
    assert _check(rows, {d.doc_id: d.text for d in docs}) < 0.01


def test_combinations_are_used(spark):
    """Lengths that fit together in threes leave nothing to cut."""
    rows = [(i, "a " * n) for i in range(300) for n in (([300, 700, 1034])[i % 3],)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = packing.packed(df, PATH).collect()
    assert _check(found, dict(rows)) < 0.02
    combined = [r for r in found if packing._COMBINED <= r.sequence_id < packing._LANES]
    assert len(combined) > 250


def test_odd_rows(spark):
    long = "word and, more\n" * 100_000
    rows = [(1, None), (2, ""), (3, long), (None, "x"), (4, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.withColumn("class", F.lit(1)).withColumn("START", F.lit(2))
    assert _check(packing.packed(df, PATH).collect(), dict(rows)) < 0.05
    repeated = packing.packed(df.union(df).where("doc_id = 4"), PATH).collect()
    assert sorted(r.offset for r in repeated) == [0, repeated[0].doc_tokens]
    assert packing.packed(df.where("doc_id < 0"), PATH).collect() == []


def test_least_squares_find_the_mix():
    patterns = packing.combinations()
    assert (patterns.sum(axis=1) == packing.CLASSES).all()
    assert len({tuple(p) for p in patterns.tolist()}) == len(patterns)
    draw = random.Random(2)
    histogram = np.zeros(packing.CLASSES + 1, np.int64)
    for p in draw.sample(range(len(patterns)), 40):
        for kind in patterns[p]:
            histogram[kind] += 1000 * (kind > 0)
    used = packing.repeat_counts(histogram, patterns)
    filled = np.zeros_like(histogram)
    for p, n in used.items():
        for kind in patterns[p]:
            filled[kind] += n * (kind > 0)
    assert (filled <= histogram).all()
    assert filled.sum() > 0.97 * histogram.sum()

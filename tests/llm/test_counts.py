"""Piecewise encodings against whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from labelscope.llm import encoding
from labelscope.llm.counts import sentence_counts, token_counts
from labelscope.llm.encoding import encoded
from labelscope.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"
ODD = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", " ", "▁", "\x85",
    "\x1c", "\x0b", "\x00", "a", "É", "é", "́", "'s", "'", "it's", ".", ",", "<|endoftext|>",
    "<|startoftext|>", "</s>", "<s>", "<unk>", "12", "3", "word", "Word", "der", "​", "‍",
    "日本", "語", "🙂", "👩‍👩‍👧", "ﬁ", "İ", "Σ", "ς", "…", "–", "“", "”", "|", "<", ">", "≠", "﻿",
]


def _texts():
    draw = random.Random(3)
    made = ["".join(draw.choices(ODD, k=draw.randrange(1, 30))) for _ in range(4000)]
    return [None, "", " ", "a ", " a", "  a  b  ", *made]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("remembered", [0, encoding.REMEMBERED_BYTES])
def test_pieces_give_the_ids_of_whole_texts(name, remembered, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", remembered)
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = _texts()
    column = pa.array(texts * 2)
    for low, high, ids, total in encoded(column, path, end_id=1):
        for i in range(low, high):
            expected = whole.encode(texts[i % len(texts)] or "", add_special_tokens=False).ids
            assert ids[total[i - low] : total[i - low + 1]].tolist() == [*expected, 1], texts[i]


def test_sentence_counts_are_those_of_whole_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    texts = _texts()
    found = np.concatenate(list(sentence_counts(pa.array(texts), path)))
    expected = [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
    assert found.tolist() == expected


def test_query_counts_whole_texts(spark):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries()["op8_token_counts"](spark, FOLDER).collect()}
    assert len(found) == len(docs)
    for doc in docs:
        n = len(model.encode(doc.text or "", num_threads=1))
        row = found[doc.doc_id]
        assert (row.n_tokens, row.over_limit) == (n, n > 4096)
        assert row.n_bytes == len((doc.text or "").encode())


def test_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    long = "lorem ipsum, " * 200_000
    rows = [(1, None), (1, ""), (None, "a b"), (2, long), (2, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.withColumn("id", F.lit("x")).withColumn("N_TOKENS", F.lit(1))
    found = [tuple(r) for r in token_counts(df.coalesce(1), path, limit=10).collect()]
    lengths = [len(whole.encode(t or "").ids) for _, t in rows]
    assert found == [
        (i, len(t or ""), n, n > 10) for (i, t), n in zip(rows, lengths, strict=True)
    ]
    assert token_counts(df.limit(0), path).collect() == []

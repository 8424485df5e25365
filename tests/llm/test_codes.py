"""Directly addressable codes: round trips and random access."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelscope.llm import codes, encoding
from labelscope.llm.queries import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def _expected(rows):
    whole = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def _rows(df):
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())


def test_query_reads_back_what_the_library_gives(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert _rows(queries()["op7_token_codes"](spark, folder)) == _expected(rows)


def test_any_id_is_addressable():
    draw = random.Random(4)
    ids = np.array([draw.getrandbits(draw.choice([3, 8, 9, 16, 17, 32])) for _ in range(5000)])
    ids[:600] = 7
    content = codes.file_bytes(ids, np.array([0, 600, 600, 5000]), pa.array(["a", None, "c"]))
    file = codes.CodeFile(content)
    assert [file[i] for i in range(5000)] == ids.tolist()
    for _ in range(300):
        a, b = sorted(draw.choices(range(5001), k=2))
        assert (file.between(a, b) == ids[a:b]).all()
    assert file.names.to_pylist() == ["a", None, "c"]
    assert list(file.documents()) == [(0, 600), (600, 600), (600, 5000)]


def test_small_files_and_odd_rows(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "Long, long text! " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("FIRST", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        files = codes.write_codes(df, PATH, str(tmp_path / "codes"), file_ids=50)
        assert files.count() >= 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert _rows(codes.read_codes(files)) == _expected(rows)
    other = df.where("doc_id < 3").union(df.where("doc_id < 3")).withColumn(
        "doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id"))
    )
    found = codes.round_trip(other, PATH).collect()
    assert sorted(r.start for r in found if r.doc_id is None)[0] == 0
    assert len(found) == 6
    assert codes.round_trip(df.limit(0), PATH).collect() == []


def test_files_are_read_by_several_tasks(spark, tmp_path):
    rows = [(i, f"text number {i} " * 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        files = codes.write_codes(df, PATH, str(tmp_path / "codes"), file_ids=200)
        n = files.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = codes.read_codes(files)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert n >= 8 and 8 <= tasks <= n
    assert _rows(found) == _expected(rows)


def test_null_ids_on_a_third_of_the_rows_are_dealt_to_several_tasks(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"some text {i * 7919 % 1000} " * 5) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    # such a small table would be one partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        files = codes.write_codes(df, PATH, str(tmp_path / "codes"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = codes.read_codes(files).collect()
    assert len(found) == len(rows)
    wanted = Counter(x[2:] for x in _expected(rows))
    assert Counter((r.n_tokens, r.ids_crc32) for r in found) == wanted
    # rows of one id lie in several files, before all others
    firsts = {r.start: r.doc_id for r in found}
    order = [firsts[s] for s in sorted(firsts)]
    assert order == [None] * 2000 + sorted(i for i, _ in rows if i is not None)
    starts = [r.first for r in files.collect()]
    assert sum(s < max(r.start for r in found if r.doc_id is None) for s in starts) >= 2
    again = codes.read_codes(codes.write_codes(df.repartition(3), PATH, str(tmp_path / "again")))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def _pieces(texts):
    """Distinct texts as bytes in a row and bounds."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def test_the_oldest_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", 3000)
    calls = []

    def encode(pieces):
        calls.extend(pieces)
        return [list(p) for p in pieces]

    memory = encoding.Pieces(encode)
    draw = random.Random(2)
    for _ in range(300):
        pieces = list({draw.randbytes(draw.randrange(0, 4)) for _ in range(20)})
        numbers = memory.numbers(*_pieces(pieces))
        for p, i in zip(pieces, numbers, strict=True):
            assert memory.ids[memory.ends[i] : memory.ends[i + 1]].tolist() == list(p)
        assert memory.held() < 6000
    assert len(calls) > 1000
    calls.clear()
    memory.numbers(*_pieces([b"new" * 1000]))
    memory.numbers(*_pieces(pieces[-1:]))
    assert calls == [b"new" * 1000]


def test_equal_hashes_are_no_equal_pieces(monkeypatch):
    """All pieces of a length have one hash: each still gets its own ids."""
    monkeypatch.setattr(encoding, "span_hashes", lambda data, a, b: (b - a).astype(np.uint64))
    memory = encoding.Pieces(lambda pieces: [list(p) for p in pieces])
    draw = random.Random(3)
    for _ in range(50):
        pieces = list({draw.randbytes(draw.randrange(0, 3)) for _ in range(9)})
        numbers = memory.numbers(*_pieces(pieces))
        for p, i in zip(pieces, numbers, strict=True):
            assert memory.ids[memory.ends[i] : memory.ends[i + 1]].tolist() == list(p)

"""Fill-in-the-middle against plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscope.llm import fim
from labelscope.llm.queries import op13_fill_in_middle


def _plain(doc_id, text):
    text = text or ""
    g = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b, c = text[:p], text[p:q], text[q:]
    if h[3] % 100 < 20:
        return n, "spm", p, q - p, f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", p, q - p, f"<P>{a}<S>{c}<M>{b}"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _odd_texts():
    draw = random.Random(5)
    parts = ["a", "<", "S>", "P", ">", "<M", "é", "日", "🙂", "\n", " ", "\x00", "<S>", "é"]
    texts = [None, "", "x", "<P>", "<S", "<S<S>", "🙂", "́"]
    return texts + ["".join(draw.choices(parts, k=draw.randrange(0, 60))) for _ in range(3000)]


@pytest.mark.parametrize("span", [7, 1_000_000])
def test_equals_plain_python(spark, monkeypatch, span):
    """Also where a text lies in several spans."""
    texts = _odd_texts()
    rows = list(enumerate(texts)) + [(7, "again"), (7, "again"), (None, "no id"), (None, None)]
    monkeypatch.setattr(fim, "SPAN_BYTES", span)
    columns = pa.table({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    digests = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    for k in range(4):
        numbers = [int(g[8 * k : 8 * k + 8], 16) for g in digests]
        columns = columns.append_column(f"h{k + 1}", pa.array(numbers))
    found = []
    for batch in fim._former("char", 90, 20)(iter(columns.to_batches(max_chunksize=100))):
        found += [tuple(r.values())[1:] for r in batch.to_pylist()]
    assert found == [_plain(*r) for r in rows]


def test_query_on_odd_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(_odd_texts()[:500])]
    rows += [(7, "again", 1), (7, "again", 1), (None, "no id", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, FORM int")
    df = df.withColumn("h1", F.lit(3)).withColumn("output", F.lit("x"))
    made = fim.fill_in_middle(df)
    found = sorted(tuple(r) for r in fim.digests(made).select(
        F.coalesce("doc_id", F.lit(-1)), "n", "form", F.coalesce("prefix_chars", F.lit(-1)),
        F.coalesce("middle_chars", F.lit(-1)), "output_sha256", "restored_sha256").collect())
    wanted = []
    for doc_id, text, _ in rows:
        n, form, p, m, out = _plain(doc_id, text)
        wanted.append((
            -1 if doc_id is None else doc_id, n, form, -1 if p is None else p,
            -1 if m is None else m, _sha(out), _sha(text or ""),
        ))
    assert found == sorted(wanted)
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_every_text_comes_back(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = op13_fill_in_middle(spark, folder)
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"))
    same = found.join(texts, "doc_id").where("own = restored_sha256")
    assert same.count() == docs.count() == found.count()
    forms = dict(found.groupBy("form").count().collect())
    total = sum(forms.values())
    assert 0.05 < forms["plain"] / total < 0.2 and 0.12 < forms["spm"] / total < 0.25


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units(spark, unit):
    """Cuts lie between words or lines, and the text comes back."""
    texts = ["one two\nthree  four ", "  lead and tail  ", "single", "", None, "\n\n", "a\nb\n\nc"]
    df = spark.createDataFrame(list(enumerate(texts * 20)), "doc_id int, text string")
    rows = fim.fill_in_middle(df, unit=unit).withColumn("back", fim.restored()).collect()
    for row in rows:
        text = (texts * 20)[row.doc_id] or ""
        assert row.back == text
        if row.form != "plain":
            for at in (row.prefix_chars, row.prefix_chars + row.middle_chars):
                if 0 < at < len(text):
                    before = text[at - 1]
                    assert before == "\n" if unit == "line" else text[at].isspace() and not before.isspace()


def test_a_long_text(spark):
    text = "日本語 <text> " * 600_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = fim.digests(fim.fill_in_middle(df)).first()
    n, form, p, m, out = _plain(1, text)
    assert tuple(row) == (1, n, form, p, m, _sha(out), _sha(text))
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(list(fim._spans(fim.unit_starts(data, np.array([0, len(data)]), "char"), len(data)))) > 8

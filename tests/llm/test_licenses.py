"""License spans against a plain search and a full alignment."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from labelscope.llm import licenses
from labelscope.llm.queries import queries


def _common(a, b):
    """Length of the longest common subsequence, without a band."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_query_finds_every_notice(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries()["op2_license_spans"](spark, folder).collect()
    text = {d.doc_id: d.text for d in docs}
    for r in rows:
        assert text[r.doc_id][r.span_start : r.span_end] == r.matched
        assert r.coverage >= licenses.LEAST_COVERAGE
    found = {(r.doc_id, r.license, r.span_start) for r in rows if r.coverage == 1}
    expected = set()
    for doc, body in text.items():
        for name, notice in licenses.NOTICES.items():
            words = re.findall(r"[A-Za-z0-9]+", notice)
            pattern = r"[^A-Za-z0-9]+".join(words)
            for m in re.finditer(rf"(?i)(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])", body or ""):
                expected.add((doc, name, m.start()))
    assert len(expected) > 15
    assert found == expected
    assert all(re.search("(?i)licen[sc]", text[r.doc_id]) for r in rows)


def test_edited_notices_are_found_with_their_coverage(spark):
    draw = random.Random(7)
    rows, truth = [], []
    for name in ("MIT-grant", "GPL-header", "Apache-2.0-header"):
        for edits in range(8):
            words = licenses.NOTICES[name].split()
            for _ in range(edits):
                i = draw.randrange(len(words))
                kind = draw.randrange(3)
                words[i : i + 1] = [["zz"], [], [words[i], "inserted"]][kind]
            noise = [draw.choice(["alpha", "beta", "gamma"]) for _ in range(300)]
            rows.append((len(rows), " ".join(noise) + "\n * " + "\n * ".join(words) + "\nEnd"))
            truth.append((name, words))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.license): r for r in licenses.license_spans(df).collect()}

    def split(text):
        return re.findall("[a-z0-9]+", text.lower())

    for doc, (name, words) in enumerate(truth):
        template = split(licenses.NOTICES[name])
        share = _common(template, split(" ".join(words))) / len(template)
        assert share >= licenses.LEAST_COVERAGE
        assert abs(found[doc, name].coverage - share) < 1e-9


def test_alignment_equals_the_full_table():
    draw = random.Random(3)
    for _ in range(300):
        a = np.array([draw.randrange(6) for _ in range(draw.randrange(1, 12))], np.uint64)
        b = np.array([draw.randrange(6) for _ in range(draw.randrange(1, 12))], np.uint64)
        pairs = licenses.align(a, b, 0, 30)
        assert len(pairs) == _common(a.tolist(), b.tolist())
        assert all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(set(pairs))


def test_odd_rows(spark):
    notice = licenses.NOTICES["MIT"]
    spread = "released, under: the\tMIT\nlicense"
    rows = [
        (1, None),
        (2, ""),
        (3, notice + " " + notice.upper()),
        (3, spread),
        (None, notice),
        (4, "é🙂 " * 100_000 + notice),
        (5, "Released under the"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.withColumn("license", F.lit("x")).withColumn("ID", F.lit(1))
    found = [(r.doc_id, r.span_start, r.span_end) for r in licenses.license_spans(df).collect()]
    n = len(notice) - 1
    expected = [(3, 0, n), (3, n + 2, 2 * n + 2), (3, 0, len(spread)), (None, 0, n)]
    expected.append((4, 300_000, 300_000 + n))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert licenses.license_spans(df.limit(0)).collect() == []


def test_edited_short_notices_are_found(spark):
    """Every short notice with as many words replaced, or left out, as may be missing.

    Not so where a word is gone that tells the license from others.
    """
    draw = random.Random(11)
    rows, truth = [(-1, "(c) Released under an MIT License, see below")], {-1: ("MIT", 0.8)}
    telling = {*licenses.NAMES, *licenses.MODIFIERS, "2", "3", "4"}
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0"):
        template = re.findall("[A-Za-z0-9]+", licenses.NOTICES[name])
        spare = int(len(template) * (1 - licenses.LEAST_COVERAGE) + 1e-9)
        for edits in range(spare + 1):
            for out in itertools.combinations(range(len(template)), edits):
                for new in (["zz"], []):
                    words = [w for i, x in enumerate(template) for w in (new if i in out else [x])]
                    words.insert(draw.randrange(1, len(words)), "inserted")
                    noise = [draw.choice(["alpha", "beta", "gamma"]) for _ in range(20)]
                    rows.append((len(rows), " ".join([*noise, *words, *noise])))
                    told = not any(template[i].lower() in telling for i in out)
                    truth[len(rows) - 1] = (name, 1 - edits / len(template) if told else None)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.license): r.coverage for r in licenses.license_spans(df).collect()}
    for doc, (name, share) in truth.items():
        if share is None:
            assert (doc, name) not in found
        else:
            assert found.get((doc, name), 0) >= share - 1e-9, (name, rows[doc])


def test_every_license_gets_its_own_name_or_none(spark):
    """Lines that differ by the one word that names the license."""
    lines = {
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0-line",
        "Licensed under CC BY 4.0.": "CC-BY-4.0-line",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under CC BY-NC 3.0.": None,
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Released under the BSD License.": "BSD",
        "Released under the ISC License.": "ISC",
        "Released under the MIT License.": "MIT",
        "Released under the Boost License.": None,
        "Released under the Python License.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
        "International License.": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.":
            "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": None,
    }
    rows = [(i, f"Some words before.\n{line}\nAnd after.") for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {}
    for r in licenses.license_spans(df).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    for i, (line, name) in enumerate(lines.items()):
        assert found.get(i, set()) == ({name} if name else set()), line


def test_headers_of_neighbours_are_told_apart(spark):
    """Notices that differ by a version or a name: the better match takes the span."""
    texts = licenses.whole_texts()
    names = [n for n in texts if n.endswith("-notice")]
    rows = [(n, f"/* {texts[n]} */ int x;") for n in names]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for r in licenses.license_spans(df).collect():
        family = r.doc_id.removesuffix("-notice")
        own = r.license.startswith(family) or (family, r.license) == ("GPL-3.0", "GPL-header")
        assert own, (r.doc_id, r.license, r.coverage)


def test_winnowing_finds_every_common_run():
    """Two sequences that share a run of so many prints have a chosen one in it."""
    draw = np.random.default_rng(6)
    for window in (1, 2, 3, 8):
        for _ in range(200):
            run = draw.integers(0, 9, window).astype(np.uint64)
            a, b = (
                np.concatenate([draw.integers(0, 9, draw.integers(0, 9)), run, draw.integers(0, 9, 5)])
                .astype(np.uint64)
                for _ in range(2)
            )
            chosen = [set(x[licenses.winnowed(x, window)].tolist()) for x in (a, b)]
            assert run.min() in chosen[0] & chosen[1]
    assert licenses.winnowed(np.array([5, 3], np.uint64), 4).tolist() == [1]
    assert len(licenses.winnowed(np.zeros(0, np.uint64), 2)) == 0


def test_long_chains_of_hits_hide_no_copy():
    words = np.arange(24, dtype=np.uint64) + np.uint64(1)
    name = " ".join(f"t{i}" for i in range(24))
    index = licenses.index_of({"T": name})
    template = index.words[0]
    text = np.concatenate([np.tile(template[:3], 40), template, template, words])
    hits = [
        (0, i, j)
        for i in range(22)
        for j in range(len(text) - 2)
        if (template[i : i + 3] == text[j : j + 3]).all()
    ]
    found = licenses._matches(text, hits, index, 0.8)
    assert [m[1:] for m in found] == [(24, 120, 143), (24, 144, 167)]


def test_spans_begin_at_the_notice_itself(spark):
    text = "Released it, Released under the MIT License."
    (row,) = licenses.license_spans(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert (row.coverage, row.span_start, row.span_end) == (1.0, 13, len(text) - 1)


def test_whole_license_texts_are_found_to_their_end(spark):
    """As they are, indented as a comment, and with every 19th word replaced."""
    texts = licenses.whole_texts()
    ids = ("MIT ISC BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 MPL-2.0 "
           "CC0-1.0 CC-BY-SA-4.0 Unlicense").split()
    notices = ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")
    names = [f"{i}-text" for i in ids] + [f"{i}-notice" for i in notices]
    assert set(names) <= set(texts)
    rows = []
    for name in names:
        words = texts[name].split()
        edited = ["zz" if i % 19 == 7 else w for i, w in enumerate(words)]
        commented = texts[name].strip().replace("\n", "\n# ")
        rows += [(f"{name} 0", f"Copyright 2020.\n\n{commented}\n\nint main() {{}}")]
        rows += [(f"{name} 1", " ".join(["alpha"] * 50 + edited + ["beta"] * 50))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = {(r.doc_id, r.license): r for r in licenses.license_spans(df).collect()}
    for name in names:
        last = re.findall("[A-Za-z0-9]+", texts[name])[-1]
        whole = found[f"{name} 0", name]
        assert whole.coverage == 1 and whole.matched.endswith(last)
        assert found[f"{name} 1", name].coverage > 0.9

"""Each stage of the pipeline against plain Python, on what its predecessor kept."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelscope.llm import minhash
from labelscope.llm.queries import queries
from labelscope.sources import materialize, shared_folder
from tests.llm.brute import FOLD, WORD, near_components
from tests.llm.test_packing import _check

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and what every stage makes of it. Some texts have no language."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(-1, None, "en", "src1", 0), (-2, "12 34 !?", None, None, 8), (-3, "", "fr", "src2", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language",
        "exact_dedup",
        "near_dedup",
        "mixing",
        "packing",
    ]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
        assert df.dtypes == stages[0].dtypes


def test_language_rejects_what_has_none_and_keeps_clean_documents(stages):
    before, after = ({r.doc_id for r in df.collect()} for df in stages[:2])
    assert {-1, -2, -3} <= before - after
    assert len(before - after) <= 3 + 0.01 * len(before)


def test_one_exact_copy_stays(stages):
    rows = stages[1].collect()
    least = {}
    for r in rows:
        text = (r.text or "").translate(FOLD)
        least[text] = min(r.doc_id, least.get(text, r.doc_id))
    assert len(least) < len(rows)
    assert sorted(tuple(r) for r in stages[2].collect()) == sorted(
        tuple(r) for r in rows if r.doc_id in set(least.values())
    )


def test_one_near_copy_stays(stages):
    rows = stages[2].collect()
    components = near_components([(r.doc_id, r.text) for r in rows], 5, 80)
    kept = {i for i, (_, c) in components.items() if i == c}
    assert len(kept) < len(rows)
    assert sorted(tuple(r) for r in stages[3].collect()) == sorted(
        tuple(r) for r in rows if r.doc_id in kept
    )


def _targets(sizes, share=1.5, epochs=2.0):
    """Water-filling round by round."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[n] for n in free)
        above = {n for n in free if weight[n] * level > epochs * sizes[n]}
        if not above:
            return target | {n: weight[n] * level for n in free}
        for n in above:
            target[n] = epochs * sizes[n]
            left -= target[n]
        free -= above
    return target


def test_sources_are_mixed_to_their_targets(stages):
    sizes, words, texts = defaultdict(int), {}, {}
    for r in stages[3].collect():
        words[r.doc_id] = WORD.findall(r.text)
        texts[r.doc_id] = r.text
        sizes[r.source] += len(words[r.doc_id])
    taken, times = Counter(), Counter()
    for r in stages[4].collect():
        own = WORD.findall(r.text)
        assert r.text == texts[r.doc_id]
        taken[r.source] += len(own)
        times[r.doc_id] += len(own)
    for source, target in _targets(sizes).items():
        # whole documents: the nearest sum is at most half of one away
        largest = max(len(words[r.doc_id]) for r in stages[3].where(F.col("source").eqNullSafe(source)).collect())
        assert abs(taken[source] - target) <= largest / 2 + 1
    assert all(n <= 2 * len(words[doc]) for doc, n in times.items())


def test_all_tokens_are_packed(stages):
    # repeated documents are told apart by a number of their own
    docs = materialize(stages[4].withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.pack(docs.sparkSession, docs, FOLDER)
    assert _check(packed.collect(), texts) < 0.01
    totals = [df.agg(F.sum("length")).first()[0] for df in (packed, stages[5])]
    assert totals[0] == totals[1]


def test_empty_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.collect() == []


def test_one_copy_stays_where_ids_repeat_or_are_null(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a, "x")] * 30 + [(5, a.upper(), "y")] * 30 + [(None, a, "z"), (7, a, "z")]
    rows += [(None, b, "x")] * 40 + [(8, "alone c", "x"), (None, "alone d", "x")]
    rows += [(9, f"{a} end", "x")] * 5 + [(None, f"{b} end", "x")] * 5
    columns = "doc_id bigint, text string, source string"
    docs = materialize(spark.createDataFrame(rows, columns).repartition(7), "odd")
    exact = materialize(corpus_pipeline.drop_copies(spark, docs, FOLDER), "odd")
    assert exact.columns == docs.columns
    left = sorted(((r.doc_id, r.text.lower()) for r in exact.collect()), key=str)
    assert left == sorted({(5, a), (None, b), (8, "alone c"), (None, "alone d"), (9, f"{a} end"),
                           (None, f"{b} end")}, key=str)
    for given in (docs, exact):
        found = corpus_pipeline.drop_near_copies(spark, given, FOLDER)
        assert found.columns == docs.columns
        left = sorted(((r.text.lower()[:2], r.doc_id) for r in found.collect()), key=str)
        assert [x[0] for x in left] == ["a0", "al", "al", "b0"]
        assert [x[1] for x in left if x[0] == "a0"] == [5]
    marked = minhash.near_duplicates(docs, one_row=True).where("kept").collect()
    assert sorted((r.doc_id for r in marked), key=str) == [5, 8, None, None]


def test_the_session_keeps_its_settings(spark):
    """Nothing that a stage or a query sets is left behind."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "stage")
    for name in ("op5_pack_windows", "op6_host_quality", "op7_token_codes", "op9_chat_tree"):
        queries()[name](spark, "/root/testdata/sf0.001").limit(1).collect()
    assert [spark.conf.get(n) for n in names] == before


def test_only_the_rows_of_the_stages_stay_stored(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "labelscope" / spark.sparkContext.applicationId
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = sorted(p.name for p in folder.iterdir() if p.name not in before)
    assert sorted(n.rsplit("-", 1)[0] for n in new) == sorted(n for n, _ in corpus_pipeline.STAGES)
    assert found.count() > 0 and "sequence_id" in found.columns

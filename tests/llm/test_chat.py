"""Chat trees: exact round trips, shared turns once, what a token sees."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscope.llm import chat
from labelscope.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _expected(rows):
    """conv -> result, from rows of conv, turn, role, text in order."""
    template = chat.Template()
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(
            (turn is not None, turn or 0, role or "", text or "")
        )
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (
            len(turns),
            _sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)),
            len(loss),
            _sha(loss),
            sum(len("".join(template.parts(t[2], t[3]))) for t in turns),
        )
    return out


def _found(df):
    rows = df.collect()
    found = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
        for r in rows
    }
    assert len(found) == len(rows)
    return found


def test_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    hostile = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    assert _found(queries()["op9_chat_tree"](spark, folder)) == _expected(rows)


def test_escapes_can_be_undone():
    template = chat.Template()
    draw = random.Random(1)
    parts = ["<", "|", "\\", "[", "INST]", "/", "s>", "</s>", "<|end|>", "SYS>>", "<<", "a", "\n", "]"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randrange(12)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text
        assert not any(c in escaped for c in template.controls)
        assert template.read("".join(template.parts(text, text[::-1]))) == (text, text[::-1])


@pytest.mark.parametrize("tokenizer", [None, PATH])
@pytest.mark.parametrize("room", [1, 300, 100_000])
def test_trees(spark, tokenizer, room):
    draw = random.Random(2)
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(1, 7)):
            text = draw.choice(["yes", "no <|end|>", "é \\ [INST]", ""])
            rows.append((conv, turn, ["user", "assistant"][turn % 2], text))
    df = spark.createDataFrame(rows, SCHEMA)
    chats = chat.formatted(df, tokenizer=tokenizer, sequence_tokens=room)
    assert _found(chat.read_back(chats, tokenizer=tokenizer)) == _expected(rows)

    sequences = chats.sequences.collect()
    nodes = 0
    for s in sequences:
        nodes += len(s.nodes)
        for node in s.nodes:
            path = [i for low, high in node.sees for i in range(low, high)]
            own = list(range(node.start, node.end))
            # along its path the positions of a token count from 0
            assert [s.position_ids[i] for i in path + own] == list(range(len(path + own)))
            if node.parent >= 0:
                parent = s.nodes[node.parent]
                assert path[-1] == parent.end - 1
    paths = {}
    for conv, _, role, text in rows:
        paths[conv] = (*paths.get(conv, ()), (role, text))
    distinct = {p[:i] for p in paths.values() for i in range(1, len(p) + 1)}
    if room == 100_000:
        assert nodes == len(distinct) if len(sequences) == 1 else nodes >= len(distinct)


def test_odd_rows(spark):
    long = "long text <|end|> " * 60_000
    rows = [
        (1, 0, "user", None),
        (1, 1, None, "x"),
        (2, 0, "user", None),
        (2, 1, None, "x"),
        (None, 0, "assistant", "only"),
        (3, 5, "assistant", long),
        (3, 5, "assistant", long),
        (3, None, "system", ""),
        (4, 0, "user\n", "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("LEAF", F.lit(1)).withColumn("turns", F.lit(1))
    chats = chat.formatted(df)
    assert _found(chat.read_back(chats)) == _expected(rows)
    assert chat.read_back(chat.formatted(df.limit(0))).collect() == []


def test_a_null_id_on_a_third_of_the_turns(spark):
    """One conversation of 33,000 turns: no array of it is built, and it comes back."""
    draw = random.Random(4)
    rows = [
        (None if i % 3 == 0 else i // 30, i, ["user", "assistant"][i % 2], f"text {draw.random()}")
        for i in range(100_000)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    chats = chat.formatted(df)
    plan = chats.members._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    found = _found(chat.read_back(chats))
    assert found == _expected(rows)
    assert found[None][0] == 33_334


def test_a_full_sequence_begins_anew_with_its_ancestors(spark):
    """Conversations that share long first turns, in sequences of a few tokens."""
    shared = [("system", "s" * 50), ("user", "u" * 50), ("assistant", "a" * 50)]
    rows = []
    for conv in range(40):
        own = [*shared[: conv % 4], ("user", f"own {conv % 13}"), ("assistant", "end")]
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(own)]
        # some conversations are the beginning of others
        rows += [(100 + conv, i, r, t) for i, (r, t) in enumerate(own[:-1])]
    df = spark.createDataFrame(rows, SCHEMA)
    for room in (1, 200, 10_000):
        chats = chat.formatted(df, sequence_tokens=room)
        assert _found(chat.read_back(chats)) == _expected(rows)
        if room == 1:
            assert chats.sequences.count() >= 20


def test_few_sequences_are_read_at_a_time(spark, monkeypatch):
    """A file with many sequences reaches a worker in small batches."""

    def sizes(template, path):
        def read(batches):
            for batch in batches:
                leaves = [x["leaf"] for row in batch.column("leaves").to_pylist() for x in row]
                n = len(leaves)
                columns = [leaves, [batch.num_rows] * n, [""] * n, [0] * n, [""] * n, [0] * n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, chat._READ.types, strict=True)],
                    schema=chat._READ,
                )

        return read

    monkeypatch.setattr(chat, "_reader", sizes)
    rows = [(i, 0, "user", f"text {i}") for i in range(100)]
    chats = chat.formatted(spark.createDataFrame(rows, SCHEMA), sequence_tokens=1)
    one_file = chats.sequences.coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    found = chat.read_back(chat.FormattedChats(one_file, chats.members)).collect()
    assert len(found) == 100
    assert max(r.n_turns for r in found) <= 8
    assert spark.conf.get(setting) == before

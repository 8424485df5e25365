"""Chat formatting as a prefix tree: shared first turns are emitted once."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.encoding import encoded
from labelscope.llm.tables import stored

#: Tokens after which a sequence is closed; the next one repeats the open ancestors.
SEQUENCE_TOKENS = 65_536
#: Sequences that are read, and sent to a Python worker, at a time.
SEQUENCES_AT_ONCE = 8


@dataclass(frozen=True)
class Template:
    """Marks around role and text, and the strings that must not occur inside them.

    A control string inside a role or text gets a backslash after its first
    character. One that has backslashes there already gets one more, so the
    escape can be undone in any text.
    """

    begin: str = "<|turn|>"
    between: str = "<|text|>"
    end: str = "<|end|>"
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained_roles: tuple[str, ...] = field(default=("assistant",))

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        starts = {}
        for c in self.controls:
            starts.setdefault(c[0], []).append(re.escape(c[1:]))
        parts = [(re.escape(s), "|".join(rest)) for s, rest in sorted(starts.items())]
        put = "|".join(f"{s}\\\\*(?={rest})" for s, rest in parts)
        take = "|".join(f"{s}\\\\+(?={rest})" for s, rest in parts)
        return re.compile(put), re.compile(take)

    def escape(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._patterns[1].sub(lambda m: m[0][:-1], text)

    def parts(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the text of a turn, the text, and what stands after it."""
        head = f"{self.begin}{self.escape(role)}{self.between}"
        return head, self.escape(text), self.end

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        head, _, rest = formatted.partition(self.between)
        role = head.removeprefix(self.begin)
        return self.unescape(role), self.unescape(rest.removesuffix(self.end))


Tokens = list[np.ndarray]


@lru_cache(maxsize=4)
def _codec(
    path: str | None,
) -> tuple[Callable[[list[str]], Tokens], Callable[[Tokens], list[str]]]:
    """Texts to tokens and back, many at a time; code points if there is no tokenizer."""
    if path is None:
        return (
            lambda texts: [np.frombuffer(t.encode("utf-32-le"), np.int32) for t in texts],
            lambda tokens: [t.astype("<i4").tobytes().decode("utf-32-le") for t in tokens],
        )
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> Tokens:
        # through the pieces that other texts have had encoded before
        found: Tokens = []
        for _, _, ids, total in encoded(pa.array(texts, pa.string()), path):
            found += np.split(ids.astype(np.int32), total[1:-1])
        return found

    def decode(tokens: Tokens) -> list[str]:
        return tokenizer.decode_batch([t.tolist() for t in tokens], skip_special_tokens=False)

    return encode, decode


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, each with its place and the name of the prefix that ends with it.

    A name is the digest of the name before it, the role and the text, so equal
    names mean equal first turns. The last turn of a conversation has its path,
    the names of all its prefixes.
    """
    names: list[str] = []
    name = b""
    waiting: dict | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if waiting is not None:
                if row["conv"] != waiting["conv"]:
                    waiting["path"] = "".join(names)
                    names, name = [], b""
                out.append(waiting)
            role, text = row["role"].encode(), row["text"].encode()
            size = len(role).to_bytes(8, "big")
            name = hashlib.blake2b(name + size + role + text, digest_size=16).digest()
            waiting = {
                "conv": row["conv"],
                "place": len(names),
                "name": name.hex(),
                "role": row["role"],
                "text": row["text"],
                "path": None,
            }
            names.append(waiting["name"])
        if out:
            yield _turn_batch(out, batch.schema.field("conv").type)
    if waiting is not None:
        waiting["path"] = "".join(names)
        yield _turn_batch([waiting], batch.schema.field("conv").type)


def _turn_batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int64(), *[pa.string()] * 4)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], t) for c, t in zip(rows[0], types, strict=True)],
        names=list(rows[0]),
    )


class _Layout:
    """One sequence under construction: nodes depth first, each emitted once."""

    def __init__(self, trained_roles: tuple[str, ...], room: int) -> None:
        self.trained_roles, self.room = trained_roles, room
        self.conversation: int | None = None
        self.clear()

    def clear(self) -> None:
        self.names: list[str] = []  # of the prefixes on the current path
        self.where: list[int] = []  # their nodes
        self.kept: list[tuple[str, Tokens]] = []  # and what they say
        self.size = 0
        self.tokens: Tokens = []
        self.positions: Tokens = []
        self.starts, self.ends, self.parents, self.depths = [], [], [], []
        self.trained: list[list[int] | None] = []
        self.sees: list[list[list[int]]] = []
        self.leaves: list[dict] = []

    def _emit(self, name: str, role: str, parts: Tokens) -> None:
        parent = self.where[-1] if self.where else -1
        depth = self.depths[parent] if parent >= 0 else 0
        start, n = self.size, sum(map(len, parts))
        self.tokens += parts
        self.positions.append(np.arange(depth, depth + n, dtype=np.int32))
        self.size += n
        sees = [list(x) for x in self.sees[parent]] if parent >= 0 else []
        if parent >= 0:
            # the parent itself; what touches becomes one interval
            low, high = self.starts[parent], self.ends[parent]
            if sees and sees[-1][1] == low:
                sees[-1][1] = high
            else:
                sees.append([low, high])
        self.names.append(name)
        self.where.append(len(self.starts))
        self.kept.append((role, parts))
        self.starts.append(start)
        self.ends.append(start + n)
        self.depths.append(depth + n)
        self.parents.append(parent)
        self.sees.append(sees)
        low = start + len(parts[0])
        self.trained.append([low, low + len(parts[1])] if role in self.trained_roles else None)

    def add(self, rank: int, leaf: str, place: int, name: str, role: str, parts: Tokens) -> pa.RecordBatch | None:
        """The next turn of the conversations in their order; a sequence that is full.

        A sequence is closed at the first turn that a conversation doesn't share
        with the one before. The next one then begins with the turns that are
        shared, which are its ancestors.
        """
        done = None
        if rank != self.conversation:
            self.conversation = rank
            self.shared, self.leaf = 0, leaf
        if self.shared == place:
            if place < len(self.names) and self.names[place] == name:
                self.shared += 1
                if name == leaf:
                    self.leaves.append({"leaf": leaf, "node": self.where[place]})
                return None
            # here the conversation leaves the path of the one before
            self.shared = -1
            del self.names[place:], self.where[place:], self.kept[place:]
            if self.size >= self.room and self.leaves:
                done = self.row()
                again = list(zip(self.names, self.kept, strict=True))
                self.clear()
                for own, (said_by, said) in again:
                    self._emit(own, said_by, said)
        self._emit(name, role, parts)
        if name == leaf:
            self.leaves.append({"leaf": leaf, "node": self.where[-1]})
        return done

    def row(self) -> pa.RecordBatch:
        nodes = [
            {"start": s, "end": e, "parent": p, "loss": t, "sees": v}
            for s, e, p, t, v in zip(
                self.starts, self.ends, self.parents, self.trained, self.sees, strict=True
            )
        ]
        lists = []
        for parts in (self.tokens, self.positions):
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists.append(pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), pa.array(values)))
        types = [f.type for f in _SEQUENCE][2:]
        more = [pa.array([x], t) for x, t in zip((nodes, self.leaves), types, strict=True)]
        return pa.RecordBatch.from_arrays([*lists, *more], schema=_SEQUENCE)


_SEQUENCE = pa.schema(
    [
        ("token_ids", pa.list_(pa.int32())),
        ("position_ids", pa.list_(pa.int32())),
        (
            "nodes",
            pa.list_(
                pa.struct(
                    [
                        ("start", pa.int32()),
                        ("end", pa.int32()),
                        ("parent", pa.int32()),
                        ("loss", pa.list_(pa.int32())),
                        ("sees", pa.list_(pa.list_(pa.int32()))),
                    ]
                )
            ),
        ),
        ("leaves", pa.list_(pa.struct([("leaf", pa.string()), ("node", pa.int32())]))),
    ]
)
_SEQUENCE_SQL = (
    "token_ids array<int>, position_ids array<int>, "
    "nodes array<struct<start: int, end: int, parent: int, loss: array<int>, "
    "sees: array<array<int>>>>, leaves array<struct<leaf: string, node: int>>"
)


def _emitter(template: Template, path: str | None, room: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _Layout(template.trained_roles, room)
        encode = _codec(path)[0]
        for batch in batches:
            rows = batch.to_pylist()
            said = [template.parts(r["role"], r["text"]) for r in rows]
            distinct = list(dict.fromkeys(p for parts in said for p in parts))
            tokens = dict(zip(distinct, encode(distinct), strict=True))
            for row, parts in zip(rows, said, strict=True):
                turn = [tokens[p] for p in parts]
                done = layout.add(
                    row["rank"], row["leaf"], row["place"], row["name"], row["role"], turn
                )
                if done:
                    yield done
        if layout.leaves:
            yield layout.row()

    return emit


@dataclass(frozen=True)
class FormattedChats:
    """The output: stored sequences, and which leaf each conversation ends at."""

    sequences: DataFrame
    members: DataFrame


def formatted(
    conversations: DataFrame,
    template: Template | None = None,
    tokenizer: str | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
) -> FormattedChats:
    """All conversations as sequences of a prefix tree.

    A node of the tree is a turn after the same turns before it. Equal
    conversations are one leaf, and only one of them is laid out. Conversations
    are range-partitioned and sorted by the names of their prefixes, which
    brings those with the same first turns together and is the depth-first
    order of the tree; each then adds the turns that its predecessor doesn't
    share. A first turn that a third of all conversations share spreads over as
    many tasks as its conversations do. A sequence is closed by the first
    conversation that finds ``sequence_tokens`` in it. At the start of the next
    one the ancestors of its first leaf are emitted anew, since a sequence must
    hold all that its tokens see.

    In a row of ``sequences``, ``position_ids`` count along a token's own path,
    and a token of a node sees the intervals ``sees`` of its ancestors and its
    own node up to itself. ``loss`` is the interval that is trained on.

    Turns stay rows throughout, sorted by conversation and place, and stream
    through the tasks; of a conversation only the names of its prefixes and the
    sequence that holds it are kept in memory.

    Turns are ordered by turn, then role and text, nulls first. A null role or
    text is empty; a null id is a conversation too, however many rows have it. Repeated rows are repeated
    turns. The tokenizer file must be one that gives texts back exactly, such as
    a byte-level one; without it the tokens are code points. Other columns may
    have any name. An empty table gives no sequence.
    """
    template = template or Template()

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    rows = conversations.select(
        F.col(f"`{id_col}`").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        filled(role_col).alias("role"),
        filled(text_col).alias("text"),
    )
    by_turn = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    id_type = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {id_type}, place bigint, name string, role string, text string, path string"
    turns = by_turn.select("conv", "role", "text").mapInArrow(_named, schema)
    turns = stored(turns, "chat-turns")
    ends = turns.where("path is not null").select("conv", F.col("name").alias("leaf"), "path")
    first = ends.groupBy("leaf").agg(F.min(F.struct("conv", "path")).alias("best"))
    ranked = (
        first.select("leaf", "best.conv", "best.path")
        .repartitionByRange("path")
        .sortWithinPartitions("path")
        .select("leaf", "conv", F.monotonically_increasing_id().alias("rank"))
    )
    ranked = stored(ranked, "chat-ranks")
    same = turns["conv"].eqNullSafe(ranked["conv"])
    chosen = turns.join(ranked, same).select("rank", "leaf", "place", "name", "role", "text")
    in_order = chosen.repartitionByRange("rank").sortWithinPartitions("rank", "place")
    sequences = in_order.mapInArrow(_emitter(template, tokenizer, sequence_tokens), _SEQUENCE_SQL)
    return FormattedChats(
        stored(sequences, "chat-sequences"), ends.select("conv", "leaf")
    )


def _reader(template: Template, path: str | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _codec(path)[1]
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.asarray(batch.column("token_ids")[i].values)
                nodes = batch.column("nodes")[i].as_py()
                number = {n["start"]: k for k, n in enumerate(nodes)}
                texts = decode([tokens[n["start"] : n["end"]] for n in nodes])
                trained = decode([tokens[slice(*(n["loss"] or (0, 0)))] for n in nodes])
                # what each node says, what of it is trained on, and its formatted length
                turns = [
                    ("{}\n{}\n".format(*template.read(text)), template.unescape(loss), len(text))
                    for text, loss in zip(texts, trained, strict=True)
                ]
                out = []
                for leaf in batch.column("leaves")[i].as_py():
                    own = nodes[leaf["node"]]
                    path_nodes = []
                    for low, high in [*own["sees"], [own["start"], own["end"]]]:
                        while low < high:
                            path_nodes.append(number[low])
                            low = nodes[number[low]]["end"]
                    said = [turns[k] for k in path_nodes]
                    whole = "".join(x[0] for x in said)
                    loss = "".join(x[1] for x in said)
                    out.append(
                        {
                            "leaf": leaf["leaf"],
                            "n_turns": len(said),
                            "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                            "loss_chars": len(loss),
                            "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                            "formatted_chars": sum(x[2] for x in said),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, _READ)

    return read


_READ = pa.schema(
    [
        ("leaf", pa.string()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(
    chats: FormattedChats,
    template: Template | None = None,
    tokenizer: str | None = None,
    id_col: str = "conv_id",
) -> DataFrame:
    """One row per conversation, from the sequences alone.

    The turns of a leaf are those that it sees, in order; the loss text is what
    the loss intervals on its path hold, unescaped. A sequence is a large row,
    so a task holds few of them at a time, however many a file has.
    """
    schema = (
        "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    )
    leaves = chats.sequences.mapInArrow(_reader(template or Template(), tokenizer), schema)
    leaves = stored(leaves, "chat-leaves", SEQUENCES_AT_ONCE)
    joined = chats.members.join(leaves, "leaf").drop("leaf")
    return joined.withColumnRenamed("conv", id_col)

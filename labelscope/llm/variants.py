"""Spelling variants: words one edit apart, found by walking a trie as a relation."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.encoding import spans
from labelscope.llm.tables import stored
from labelscope.llm.text import as_bytes, mask_spans, mix, powers, runs

#: One occurrence in so many loses a code point.
DELETED = 199
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A form has to be so many times as frequent.
RATIO = 5

#: Words are walked through the trie up to this many code points; pairs with a
#: longer word share the hash of a text with one code point left out.
TRIE_CHARS = 32
#: Edges of a level that are sent to every task; more are joined by a shuffle.
BROADCAST_EDGES = 20_000
#: Levels that are walked before the frontier is stored, at most.
LEVELS_AT_ONCE = 4
#: Words that one task starts with.
WORDS_PER_TASK = 4_000

#: Different words that a task counts together before it passes them on.
COUNTED_WORDS = 400_000
#: Hashes of longer words are computed one by one.
CRC_BYTES = 64

_STEP = 0xD6E8FEB86659FD93
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32, from its reversed polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_CRC = _crc_table()


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of the bytes, continued from that of the bytes before it."""
    found = np.empty(len(starts), np.uint32)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > CRC_BYTES):
        found[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(sizes <= CRC_BYTES)
    # longest first, so that those which go on are a slice
    order = short[np.argsort(-sizes[short], kind="stable")]
    at, state = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    going = np.searchsorted(-sizes[order], -np.arange(CRC_BYTES), "left")
    for step, n in enumerate(going):
        if not n:
            break
        byte = data[at[:n] + step]
        state[:n] = _CRC[(state[:n] ^ byte) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    found[order] = state ^ np.uint32(0xFFFFFFFF)
    return found


def _counter(deleted: int, least_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for low, high in runs(batch.column("text")):
                data, bounds = as_bytes(batch.column("text").slice(low, high - low))
                # C3 leads the code points C0 to FF and no others
                inside = _ASCII[data] | (data == 0xC3)
                inside[1:] |= data[:-1] == 0xC3
                starts, ends, firsts = mask_spans(inside, bounds)
                lower = _FOLDED[data]
                before = [zlib.crc32(f"{i}:".encode()) for i in ids[low:high]]
                before = np.repeat(np.array(before, np.uint32), np.diff(firsts))
                crcs = _crcs(lower, starts, ends, before)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = chars[ends] - chars[starts]
                cut = (crcs % np.uint32(deleted) == 0) & (chars > least_chars)
                shorter = []
                for i in np.flatnonzero(cut):
                    word = lower[starts[i] : ends[i]].tobytes().decode()
                    place = int(crcs[i]) % len(word)
                    shorter.append((word[:place] + word[place + 1 :]).encode())
                whole = (crcs % np.uint32(deleted) != 0) & (chars >= least_chars)
                found = pa.chunked_array(
                    [spans(lower, starts[whole], ends[whole]), pa.array(shorter, pa.large_binary())]
                ).value_counts()
                waiting.append(
                    pa.table(
                        [found.field("values").cast(pa.large_string()), found.field("counts")],
                        names=["word", "n"],
                    )
                )
                if sum(map(len, waiting)) > COUNTED_WORDS:
                    merged = _merged(waiting)
                    waiting = [merged]
                    if 2 * len(merged) > COUNTED_WORDS:
                        yield from merged.to_batches()
                        waiting = []
        if waiting:
            yield from _merged(waiting).to_batches()

    return count


def _merged(tables: list[pa.Table]) -> pa.Table:
    same = [t.cast(pa.schema([("word", pa.large_string()), ("n", pa.int64())])) for t in tables]
    total = pa.concat_tables(same).group_by("word").aggregate([("n", "sum")])
    return pa.table([total["word"].cast(pa.string()), total["n_sum"]], names=["word", "n"])


def words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    deleted: int = DELETED,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough.

    An occurrence whose hash of id and word ``deleted`` divides loses the code
    point that the hash names. A null id counts as empty.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    counted = rows.mapInArrow(_counter(deleted, least_chars), "word string, n bigint")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= least_count)


def edges(vocabulary: DataFrame) -> DataFrame:
    """``depth, node, edge, near_n``: the trie of the words ``word, n``.

    A node is its prefix, ``depth`` code points long, and an edge the code point
    that leads on. An empty edge says that a word ends here, and ``near_n`` how
    often it occurs.
    """
    depth = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth")
    steps = vocabulary.select("word", "n", depth)
    return (
        steps.select(
            "depth",
            F.substring("word", F.lit(1), F.col("depth")).alias("node"),
            F.substring("word", F.col("depth") + 1, F.lit(1)).alias("edge"),
            F.when(F.length("word") == F.col("depth"), F.col("n")).alias("n"),
        )
        .groupBy("depth", "node", "edge")
        .agg(F.max("n").alias("near_n"))
    )


def _own(pos: Column) -> Column:
    """The code point of the word at a position; empty at its end."""
    return F.substring("word", pos + 1, F.lit(1))


def _edited(vocabulary: DataFrame, level: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The first edits at a depth, of words that came so far without one.

    States ``word, n, pos, node, near_n`` after a code point is left out, still
    at their node, and after one is replaced, one edge further down. Two words
    one edit apart part at the first code point that differs, so nothing is left
    out before an equal one, and only greater code points are put in, because
    the other word finds the smaller ones.
    """
    at = F.lit(depth)
    here = vocabulary.where(F.length("word") > depth).withColumn("node", F.substring("word", F.lit(1), at))
    none = F.lit(None).cast("bigint").alias("near_n")
    left_out = here.where(_own(at) != _own(at + 1)).select(
        "word", "n", F.lit(depth + 1).alias("pos"), "node", none
    )
    nodes = level.select(F.col("node").alias("at"), "edge")
    replaced = here.join(nodes, (F.col("node") == F.col("at")) & (F.col("edge") > _own(at))).select(
        "word", "n", F.lit(depth + 1).alias("pos"), F.concat("node", "edge").alias("node"), none
    )
    return left_out, replaced


def _followed(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """Edited states one edge further down, along the rest of their words.

    A state at the end of its word whose node ends a word gets that word's
    count as ``near_n``; such states stay as they are.
    """
    nodes = level.select(
        F.col("node").alias("at"), F.col("edge"), F.col("near_n").alias("end_n")
    )
    # what has ended needs no edge any more
    key = F.when(F.col("near_n").isNull(), _own(F.col("pos")))
    joined = frontier.withColumn("own", key).join(
        nodes, (F.col("node") == F.col("at")) & (F.col("own") == F.col("edge")), "left"
    )
    ended = F.col("near_n").isNotNull()
    return joined.where(ended | F.col("edge").isNotNull()).select(
        "word",
        "n",
        F.when(ended, F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"),
        F.when(ended, F.col("node")).otherwise(F.concat("node", "edge")).alias("node"),
        F.coalesce("near_n", "end_n").alias("near_n"),
    )


def trie_neighbours(vocabulary: DataFrame) -> DataFrame:
    """``word, near, near_n`` for all pairs of words ``word, n`` one edit apart, both ways.

    The frontier holds states (word, position, node) after one edit; a state
    without an edit is a word and a depth. Every level joins both with the
    edges of that depth: words branch into their edits, edited states follow
    the rest of their word. A pair is found from one side, the longer word or
    the one whose differing code point is smaller, and returned from both.

    Levels with few nodes are sent to every task, and several of them are
    walked before the frontier is stored; at the others states are shuffled to
    their node.
    """
    level_of = stored(edges(vocabulary).repartition("depth", "node"), "trie")
    sizes = {r["depth"]: r["n"] for r in level_of.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    pairs = vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    if sizes:
        tasks = max(1, math.ceil(vocabulary.count() / WORDS_PER_TASK))
        # dealt out once; a shuffle in the plan of every level takes memory of the driver
        starts = stored(vocabulary.select("word", "n").repartition(tasks, "word"), "starts")
        deepest = max(sizes)
        frontier = None
        chained = 0
        for depth in range(deepest + 1):
            few = sizes[depth] <= BROADCAST_EDGES
            level = level_of.where(F.col("depth") == depth)
            level = F.broadcast(level) if few else level
            left_out, replaced = _edited(starts, level, depth)
            frontier = left_out if frontier is None else frontier.union(left_out)
            frontier = _followed(frontier, level).union(replaced)
            chained += 1
            if depth < deepest and chained < LEVELS_AT_ONCE and sizes[depth + 1] <= BROADCAST_EDGES:
                continue
            chained = 0
            # every union adds partitions, most of them small
            walked = stored(frontier.coalesce(tasks), "frontier")
            done = walked.where("near_n is not null")
            pairs = pairs.union(done.select("word", "n", F.col("node").alias("near"), "near_n"))
            frontier = walked.where("near_n is null")
    return _both_ways(pairs)


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every word, at place -1, and of what it is without the code point at a place."""
    for batch in batches:
        for word in batch.column("word").to_pylist():
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = len(codes)
            power = powers(_STEP, n)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes + np.uint64(1)) * power)])
            # what follows the place moves one to the front
            back = np.uint64(pow(_STEP, -1, 1 << 64))
            hashes = mix(np.append(sums[n], sums[:-1] + (sums[n] - sums[1:]) * back))
            # leaving out either of two equal neighbours gives the same: the first counts
            first = np.ones(n + 1, bool)
            first[2:] = codes[1:] != codes[:-1]
            key = hashlib.blake2b(word.encode(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.DictionaryArray.from_arrays(np.zeros(n + 1, np.int32), pa.array([key])).cast(
                        pa.binary()
                    ),
                    pa.array(np.full(n + 1, n), pa.int64()),
                    pa.array(np.arange(-1, n), pa.int64()),
                    pa.array(hashes.view(np.int64)),
                    pa.array(first),
                ],
                names=["key", "size", "place", "hash", "first"],
            )


def long_neighbours(vocabulary: DataFrame, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """Those neighbours ``word, near, near_n`` of which one has more than ``trie_chars`` code points.

    One word replaces a code point of the other if both are the same without
    that place, and lacks one if the other becomes it. No more words than there
    are letters share a hash at a place, so no group is large. Found pairs are
    compared as texts.
    """
    schema = "key binary, size bigint, place bigint, hash bigint, first boolean"
    long = vocabulary.where(F.length("word") >= trie_chars)
    hashes = long.select("word").mapInArrow(_left_out, schema)
    hashes = stored(hashes, "left-out")
    a, b = (hashes.select(*[F.col(c).alias(f"{c}_{x}") for c in hashes.columns]) for x in "ab")
    both = (F.col("hash_a") == F.col("hash_b")) & (F.greatest("size_a", "size_b") > trie_chars)
    replaced = a.where("place_a >= 0").join(
        b, both & (F.col("place_a") == F.col("place_b")) & (F.col("key_a") != F.col("key_b"))
    )
    lacks = a.where("place_a >= 0 and first_a").join(b.where("place_b = -1"), both)
    place = F.col("place_a").cast("int").alias("place")
    # the shorter word is compared as it is
    found = replaced.where("key_a < key_b").select("key_a", "key_b", place, F.lit(False).alias("lacks"))
    found = found.union(lacks.select("key_a", "key_b", place, F.lit(True)))
    keyed = long.mapInArrow(_keyed, "key binary, word string, n bigint")
    keyed = stored(keyed, "long-words")
    x, y = (keyed.select(*[F.col(c).alias(f"{c}_{x}") for c in keyed.columns]) for x in "xy")

    def without(word: str) -> Column:
        return F.concat(
            F.substring(word, F.lit(1), F.col("place")),
            F.substring(word, F.col("place") + 2, F.length(word)),
        )

    other = F.when(F.col("lacks"), F.col("word_y")).otherwise(without("word_y"))
    same = (
        found.join(x, F.col("key_a") == F.col("key_x"))
        .join(y, F.col("key_b") == F.col("key_y"))
        .where(without("word_x") == other)
    )
    return _both_ways(same.select("word_x", "n_x", "word_y", "n_y"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """``word, near, near_n`` from either side of pairs of two words and their counts."""
    pairs = pairs.toDF("word", "n", "near", "near_n")
    sides = F.expr(
        "explode(array(struct(word, near, near_n), struct(near as word, word as near, n as near_n)))"
    )
    return pairs.select(sides.alias("s")).select("s.*")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("word").to_pylist()
        keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), batch.column("word"), batch.column("n")],
            names=["key", "word", "n"],
        )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms are followed to the last one.

    A form is more frequent than its word, so there is no circle. Every round
    takes the root of the root, which halves what is left of each chain.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = found.join(beyond, "root", "left").select(
            "word",
            F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved"),
        )
        step = stored(step, "roots")
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    deleted: int = DELETED,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    trie_chars: int = TRIE_CHARS,
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters, A-Z lower-cased, of at least ``least_chars`` code
    points that occur at least ``least_count`` times. Two are near when they
    differ by one inserted, deleted or replaced code point. The form of a word
    is the near word that occurs most often (of equal ones the first in
    code-point order), if it occurs ``ratio`` times as often; the root follows
    forms to the last.

    A null text has no words, and a null id counts as empty. Repeated rows count
    as often as they occur. Whole texts are taken, and words of any length.
    Other columns may have any name. An empty table, or one without frequent
    words, gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    vocabulary = stored(words(docs, id_col, text_col, deleted, least_chars, least_count), "words")
    near = trie_neighbours(vocabulary.where(F.length("word") <= trie_chars))
    if not vocabulary.where(F.length("word") > trie_chars).isEmpty():
        near = near.union(long_neighbours(vocabulary, trie_chars))
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    form = (-F.col("best.less") >= ratio * F.col("n")) & F.col("best").isNotNull()
    formed = vocabulary.join(best, "word", "left").select(
        "word",
        F.when(form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(form, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

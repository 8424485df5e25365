"""Packing token sequences into windows by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.encoding import encoded
from labelscope.llm.tables import stored
from labelscope.llm.text import tidy

#: Lengths are counted in this many classes per window.
CLASSES = 256
#: Most pieces that a combination puts into one window.
DEPTH = 4
#: Windows that one lane of residuals fills, about.
LANE_WINDOWS = 256

#: Sequence ids of whole windows, of combinations and of lanes.
_COMBINED = 1 << 61
_LANES = 1 << 62
_LANE_ROOM = 1 << 24


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` classes that sum to ``classes``; 0 is none."""
    rows = [np.array([[0] * (depth - 1) + [classes]], np.int64)]
    heads = np.arange(1, classes, dtype=np.int64)[:, None]
    for width in range(2, depth + 1):
        rest = classes - heads.sum(axis=1)
        whole = np.column_stack([heads, rest])[rest >= heads[:, -1]]
        padded = np.zeros((len(whole), depth), np.int64)
        padded[:, depth - width :] = whole
        rows.append(padded)
        # one more class, not below the last one and leaving room for another
        room = np.maximum(rest // 2 - heads[:, -1] + 1, 0)
        more = np.repeat(heads, room, axis=0)
        step = np.arange(len(more)) - np.repeat(np.cumsum(room) - room, room)
        heads = np.column_stack([more, more[:, -1] + step])
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, patterns: np.ndarray) -> dict[int, int]:
    """How often to use each pattern, from the number of pieces of each class.

    Non-negative least squares by an active set: the pattern that explains most
    of what is left joins, all are fitted anew, and those that would be negative
    leave. At most as many patterns as classes stay. Counts are rounded down,
    and no class is used more often than it has pieces.
    """
    target = histogram.astype(float)
    target[0] = 0
    columns = np.zeros((len(histogram), 0))
    active: list[int] = []
    counts = np.zeros(0)
    rest = target.copy()
    tried: set[int] = set()
    usable = patterns[(target[patterns] > 0).all(axis=1, where=patterns > 0)]
    for _ in range(3 * len(histogram)):
        if not len(usable):
            break
        gain = np.where(usable > 0, rest[usable], 0.0).sum(axis=1)
        gain /= np.sqrt((usable > 0).sum(axis=1))
        gain[list(tried)] = -1
        best = int(gain.argmax())
        if gain[best] <= 0.5:
            break
        column = np.bincount(usable[best], minlength=len(histogram)).astype(float)
        column[0] = 0
        tried.add(best)
        active.append(best)
        columns = np.column_stack([columns, column])
        counts = np.append(counts, 0.0)
        while True:
            fitted = np.linalg.lstsq(columns, target, rcond=None)[0]
            low = fitted <= 1e-9
            if not low.any():
                counts = fitted
                break
            drop = counts - fitted
            ratio = np.where(low & (drop > 0), counts / np.where(drop > 0, drop, 1), np.inf)
            counts = counts + min(1.0, ratio.min()) * (fitted - counts)
            stays = (counts > 1e-9) | ~low
            if stays.all():
                stays[np.flatnonzero(low)[fitted[low].argmin()]] = False
            columns, counts = columns[:, stays], counts[stays]
            left = [a for a, s in zip(active, stays, strict=True) if not s]
            active = [a for a, s in zip(active, stays, strict=True) if s]
            # what has just joined and leaves at once would join again
            tried = set(active) | ({best} if best in left else set())
            if not active:
                break
        rest = target - columns @ counts
    used: dict[int, int] = {}
    places = {tuple(p): i for i, p in enumerate(patterns.tolist())}
    free = histogram.astype(np.int64).copy()
    for best, count in sorted(zip(active, counts, strict=True), key=lambda x: -x[1]):
        classes, times = np.unique(usable[best][usable[best] > 0], return_counts=True)
        n = min(int(count + 1e-6), int((free[classes] // times).min()))
        if n > 0:
            used[places[tuple(usable[best].tolist())]] = n
            free[classes] -= n * times
    return used


def _piecer(path: str, end_id: int, window: int):
    """Cuts every document into whole windows and one shorter piece, which keeps its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, _, ids, total in encoded(batch.column("text"), path, end_id):
                rows, keys, starts, lengths, sums, totals, tails = [], [], [], [], [], [], []
                plain = ids.astype("<u4")
                for i, (a, b) in enumerate(zip(total[:-1].tolist(), total[1:].tolist())):
                    for at in range(a, b, window):
                        to = min(at + window, b)
                        piece = plain[at:to].tobytes()
                        rows.append(low + i)
                        keys.append(number)
                        starts.append(at - a)
                        lengths.append(to - at)
                        sums.append(zlib.crc32(piece))
                        totals.append(b - a)
                        tails.append(piece if to - at < window else None)
                        number += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        batch.column("id").take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(tails, pa.binary()),
                    ],
                    names=["piece", "id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return cut


def _splitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksums of the two parts of pieces that a window's end cuts."""
    for batch in batches:
        heads = np.asarray(batch.column("head"))
        parts = [
            (zlib.crc32(ids[: 4 * n]), zlib.crc32(ids[4 * n :]))
            for ids, n in zip(batch.column("ids").to_pylist(), heads.tolist(), strict=True)
        ]
        first, second = zip(*parts, strict=True) if parts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("piece"),
                pa.array(first, pa.int64()),
                pa.array(second, pa.int64()),
            ],
            names=["piece", "crc_head", "crc_tail"],
        )


def _ranked(rest: DataFrame) -> DataFrame:
    """``rest`` with ``rank``: 0, 1, … within each class.

    Each class is spread over cells, about as many as a cell has rows, by a
    hash of the piece; ranks are those in the cell after the counts of the
    cells before. A class with a third of all pieces is counted and sorted in
    many tasks.
    """
    n = rest.count()
    cells = max(1, int(n**0.5) // 8)
    rows = rest.withColumn("h", F.xxhash64("piece")).withColumn(
        "cell", F.pmod("h", F.lit(cells)).cast("int")
    )
    sums = rows.groupBy("class", "cell").agg(F.count("*").alias("n"))
    running = Window.partitionBy("class").orderBy("cell")
    sums = sums.select(
        "class", "cell", (F.sum("n").over(running) - F.col("n")).alias("cell_start")
    )
    within = F.row_number().over(Window.partitionBy("class", "cell").orderBy("h", "piece"))
    return (
        rows.withColumn("within", within)
        .join(sums, ["class", "cell"])
        .withColumn("rank", F.col("cell_start") + F.col("within") - 1)
        .drop("cell", "cell_start", "within")
    )


def packed(
    docs: DataFrame,
    path: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: the id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its tokens and ``end_id``. Whole windows of it stand alone;
    what is left is a piece below the window's length. Pieces are counted by
    length class. All combinations of up to four classes that fill a window are
    fitted to the counts by non-negative least squares, on the driver, which
    sees 256 numbers; the repeat counts are rounded down, and the pieces of a
    class go to the combinations by their rank. All other pieces are packed
    greedily: laid end to end in lanes of bounded length and cut where a window
    ends, so only the last window of a lane has padding.

    A null or empty text is the end token alone. Rows that repeat a document
    are packed each for itself, null ids too. A text of any length is cut into
    windows in the task that reads it. Other columns may have any name. An
    empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (
        f"piece bigint, id {id_type}, start bigint, length bigint, ids_crc32 bigint, "
        "doc_tokens bigint, ids binary"
    )
    pieces = stored(rows.mapInArrow(tidy(_piecer(path, end_id, window)), schema), "pieces")
    about = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.where(F.col("length") == window).select(
        *about, F.col("piece").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )

    unit = window // CLASSES
    rest = pieces.where(F.col("length") < window).select(
        "piece", *about, F.ceil(F.col("length") / unit).cast("int").alias("class")
    )
    histogram = np.zeros(CLASSES + 1, np.int64)
    for row in rest.groupBy("class").agg(F.count("*").alias("n")).collect():
        histogram[row["class"]] = row["n"]
    patterns = combinations()
    slots, taken, base = [], [0] * (CLASSES + 1), 0
    for pattern, count in repeat_counts(histogram, patterns).items():
        for slot, kind in enumerate(patterns[pattern].tolist()):
            if kind:
                slots.append((kind, taken[kind], taken[kind] + count, base, slot))
                taken[kind] += count
        base += count
    spark = docs.sparkSession
    # at most CLASSES patterns of DEPTH slots
    table = F.broadcast(
        spark.createDataFrame(
            slots, "class int, first bigint, after bigint, base bigint, slot int"
        )
    )
    ranked = stored(_ranked(rest), "ranked-pieces")
    place = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    placed = ranked.join(table, "class", "left").where(
        F.coalesce(place, F.lit(False))
    )
    number = F.lit(_COMBINED) + F.col("base") + F.col("rank") - F.col("first")
    in_window = Window.partitionBy("sequence_id").orderBy("slot")
    combined = placed.withColumn("sequence_id", number).select(
        *about,
        "sequence_id",
        (F.sum("length").over(in_window) - F.col("length")).alias("offset"),
    )

    uses = spark.createDataFrame(list(enumerate(taken)), "class int, used bigint")
    left = ranked.join(F.broadcast(uses), "class").where("rank >= used")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    lanes = max(1, tokens // (window * LANE_WINDOWS))
    lane = F.pmod(F.xxhash64("piece", F.lit(2)), F.lit(lanes)).cast("bigint")
    in_lane = Window.partitionBy("lane").orderBy("h", "piece")
    laid = (
        left.withColumn("lane", lane)
        .withColumn("at", F.sum("length").over(in_lane) - F.col("length"))
        .withColumn("offset", F.col("at") % window)
        .withColumn("head", F.least(F.col("length"), window - F.col("offset")))
        .withColumn(
            "sequence_id",
            F.lit(_LANES) + F.col("lane") * _LANE_ROOM + F.floor(F.col("at") / window),
        )
    )
    laid = stored(laid.select("piece", *about, "sequence_id", "offset", "head"), "lanes")
    uncut = laid.where("head = length").select(*about, "sequence_id", "offset")
    cut = laid.where("head < length")
    sums = cut.select("piece", "head").join(
        pieces.where("ids is not null").select("piece", "ids"), "piece"
    )
    sums = sums.mapInArrow(_splitter, "piece bigint, crc_head bigint, crc_tail bigint")
    parts = F.array(
        F.struct(
            F.col("start"),
            F.col("head").alias("length"),
            F.col("crc_head").alias("ids_crc32"),
            F.col("sequence_id"),
            F.col("offset"),
        ),
        F.struct(
            (F.col("start") + F.col("head")).alias("start"),
            (F.col("length") - F.col("head")).alias("length"),
            F.col("crc_tail").alias("ids_crc32"),
            (F.col("sequence_id") + 1).alias("sequence_id"),
            F.lit(0).cast("bigint").alias("offset"),
        ),
    )
    halves = cut.join(sums, "piece").select("id", "doc_tokens", F.inline(parts))
    result = (
        whole.unionByName(combined).unionByName(uncut).unionByName(halves.select(*whole.columns))
    )
    return result.withColumnRenamed("id", id_col)

"""Token ids in files of directly addressable codes.

A file holds the ids of consecutive documents. Level 0 has the low eight bits
of every id. A bitmap tells which ids go on, level 1 has the next eight bits of
those, and so forth. A directory holds the number of set bits before every
512th, so the place of an id on the next level is one directory entry plus the
bits of one block: any id can be read without decoding others.

Layout, little-endian: ``DACIDS01``, the length of the header (uint32), the
header as JSON, then the sections it names, aligned to 8 bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.encoding import encoded
from labelscope.llm.tables import stored
from labelscope.sources import shared_folder

MAGIC = b"DACIDS01"
CHUNK_BITS = 8
#: Bits between two entries of a rank directory.
RANK_EVERY = 512
#: A file is closed when it has this many ids; a document is never split.
FILE_IDS = 4_000_000

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Chunks, continuation bitmap and rank directory of each level; no bitmap on the last."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        chunk = (rest & np.uint32(0xFF)).astype(np.uint8)
        more = rest >> np.uint32(CHUNK_BITS)
        goes_on = more > 0
        if not goes_on.any():
            levels.append({"chunks": chunk})
            return levels
        bitmap = np.packbits(goes_on, bitorder="little")
        step = RANK_EVERY // 8
        padded = np.zeros(-(-len(bitmap) // step) * step, np.uint8)
        padded[: len(bitmap)] = bitmap
        blocks = _POPCOUNT[padded].reshape(-1, step).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32)
        levels.append({"chunks": chunk, "bitmap": bitmap, "ranks": ranks})
        rest = more[goes_on]


class CodeFile:
    """The ids of one file; single ids and ranges by their place in it."""

    def __init__(self, content: bytes | pa.Buffer) -> None:
        data = np.frombuffer(content, np.uint8)
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        size = int(data[8:12].view(np.uint32)[0])
        self.header = json.loads(data[12 : 12 + size].tobytes())

        def section(name: str) -> np.ndarray:
            at, n, kind = self.header["sections"][name]
            return data[at : at + n].view(kind)

        self.levels = [
            {part: section(f"{part}{k}") for part in parts}
            for k, parts in enumerate(self.header["levels"])
        ]
        self.starts = section("starts")
        self.names = pa.ipc.open_stream(section("names").tobytes()).read_all().column(0)

    def _rank(self, level: dict[str, np.ndarray], at: int) -> int:
        """Set bits of the bitmap before ``at``."""
        block = at // RANK_EVERY
        low = block * RANK_EVERY // 8
        n = int(level["ranks"][block]) + int(_POPCOUNT[level["bitmap"][low : at // 8]].sum())
        if at % 8:
            n += int(_POPCOUNT[level["bitmap"][at // 8] & ((1 << at % 8) - 1)])
        return n

    def __getitem__(self, at: int) -> int:
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level["chunks"][at]) << shift
            if "bitmap" not in level or not level["bitmap"][at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(level, at), shift + CHUNK_BITS
        return value

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids start to end (exclusive), as uint32."""
        out = np.zeros(end - start, np.uint32)
        where, shift = slice(None), 0
        for level in self.levels:
            out[where] |= level["chunks"][start:end].astype(np.uint32) << np.uint32(shift)
            if "bitmap" not in level or end == start:
                break
            bits = np.unpackbits(level["bitmap"][start // 8 : -(-end // 8)], bitorder="little")
            on = np.flatnonzero(bits[start % 8 : start % 8 + end - start])
            where = on if isinstance(where, slice) else where[on]
            start = self._rank(level, start)
            end, shift = start + len(on), shift + CHUNK_BITS
        return out

    def documents(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)


def file_bytes(ids: np.ndarray, starts: np.ndarray, names: pa.Array) -> bytes:
    """One file: ids of documents in a row, where each begins, and the documents' names."""
    levels = encode_levels(ids)
    sink = pa.BufferOutputStream()
    table = pa.table({"name": names})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    parts = {f"{n}{k}": a for k, level in enumerate(levels) for n, a in level.items()}
    parts |= {"starts": starts.astype(np.int64), "names": np.frombuffer(sink.getvalue(), np.uint8)}
    header = {"levels": [list(level) for level in levels], "sections": {}}
    room = len(json.dumps(header)) + sum(len(n) + 60 for n in parts) + 16
    at = -(-(12 + room) // 8) * 8
    for name, values in parts.items():
        header["sections"][name] = [at, values.nbytes, values.dtype.str]
        at = -(-(at + values.nbytes) // 8) * 8
    text = json.dumps(header).encode().ljust(room)
    out = bytearray(at)
    out[:8], out[8:12], out[12 : 12 + room] = MAGIC, np.uint32(room).tobytes(), text
    for name, values in parts.items():
        low = header["sections"][name][0]
        out[low : low + values.nbytes] = values.tobytes()
    return bytes(out)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def _writer(path: str, end_id: int, folder: str, file_ids: int):
    """Writes the documents of a sorted partition; yields a row per finished file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        number, held, ids, lengths, names = 0, 0, [], [], []

        def finished() -> pa.RecordBatch:
            # a name of its own for every attempt: only the files that the table of
            # files lists belong to the output
            name = f"ids-{part:06d}-{number:06d}-{uuid.uuid4().hex[:12]}.dac"
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            content = file_bytes(np.concatenate(ids), starts, pa.concat_arrays(names))
            with system.open_output_stream(f"{root}/{name}") as sink:
                sink.write(content)
            row = {
                "part": [part],
                "number": [number],
                "file": [f"{folder}/{name}"],
                "n_docs": [len(starts) - 1],
                "n_ids": [int(starts[-1])],
            }
            return pa.RecordBatch.from_pydict(row, _FILES)

        for batch in batches:
            for low, high, found, total in encoded(batch.column("text"), path, end_id):
                ids.append(found)
                lengths.append(np.diff(total))
                names.append(batch.column("id").slice(low, high - low))
                held += len(found)
                if held >= file_ids:
                    yield finished()
                    number, held, ids, lengths, names = number + 1, 0, [], [], []
        if names:
            yield finished()

    return write


_FILES = pa.schema(
    [
        ("part", pa.int64()),
        ("number", pa.int64()),
        ("file", pa.string()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
    ]
)


def write_codes(
    docs: DataFrame,
    path: str,
    folder: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all documents, ascending by id, and return the table of files.

    The table, ``part, number, file, n_docs, n_ids, first``, is what commits the
    files: ``first`` is the number of ids in all files before. Documents are
    range-partitioned by id, and each task writes files of bounded size. A task
    that is repeated writes new files, and the table lists those of the attempt
    that succeeded. A null or empty text is the end token alone. Null ids come
    first. Rows with equal ids follow each other in the order of a hash of their
    text, by which an id that many rows share is dealt to several ranges.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    place = F.xxhash64("text")
    in_order = rows.repartitionByRange("id", place).sortWithinPartitions("id", place, "text")
    schema = "part bigint, number bigint, file string, n_docs bigint, n_ids bigint"
    files = stored(
        in_order.mapInArrow(_writer(path, end_id, folder, file_ids), schema), "code-files"
    )
    before = Window.orderBy("part", "number")  # one row per file
    return files.withColumn("first", F.sum("n_ids").over(before) - F.col("n_ids"))


#: Tasks that read files back, at most.
MOST_READERS = 10_000


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, place = _place(row["file"])
            with system.open_input_file(place) as source:
                content = CodeFile(source.read_buffer())
            starts = content.starts[:-1]
            crc = [
                zlib.crc32(content.between(a, b).astype("<u4").tobytes())
                for a, b in content.documents()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    content.names.combine_chunks(),
                    pa.array(starts + row["first"], pa.int64()),
                    pa.array(np.diff(content.starts), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )


def read_codes(files: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: the id, ``start, n_tokens, ids_crc32``."""
    schema = f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    # a task per file, whatever the small table of files is stored in
    tasks = max(1, min(files.count(), MOST_READERS))
    spread = files.select("file", "first", "part", "number").repartitionByRange(tasks, "part", "number")
    return spread.mapInArrow(_reader, schema).withColumnRenamed("id", id_col)


def code_folder(docs: DataFrame) -> str:
    """A new folder below the one that all executors share."""
    spark = docs.sparkSession
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/labelscope/{app}/codes-{uuid.uuid4().hex[:12]}"


def round_trip(
    docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the documents' ids to a new shared folder, and read the files back.

    An empty table gives an empty result and no file.
    """
    files = write_codes(docs, path, code_folder(docs), end_id, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    return read_codes(files, id_type, id_col)

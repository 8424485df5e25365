"""Fill-in-the-middle texts: units, cuts and pieces as Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.tables import unused
from labelscope.llm.text import as_bytes, runs

#: The marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: Bytes of units that are held as lists at a time; cut between units.
SPAN_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def unit_starts(data: np.ndarray, bounds: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of the texts begin: code points, words or lines.

    A word takes the white space before it, a line the line break at its end.
    White space behind the last word belongs to that word.
    """
    if unit == "char":
        first = (data & 0xC0) != 0x80
    elif unit == "line":
        first = np.zeros(len(data), bool)
        first[1:] = data[:-1] == 10
    elif unit == "word":
        space = _SPACE[data]
        first = space.copy()
        first[1:] &= ~space[:-1]
        # white space at the end of a text begins no word
        ends = bounds[1:][bounds[1:] > bounds[:-1]]
        last = np.maximum.accumulate(np.where(space, -1, np.arange(len(data))))
        first[_tails(last, ends, first)] = False
    else:
        raise ValueError(f"no such unit: {unit}")
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(first)


def _tails(last: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of white space that reaches to the end of its text."""
    behind = last[ends - 1] + 1
    behind = behind[behind < ends]
    return behind[first[behind]]


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _spans(starts: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    """Numbers of units [low, high) that have about ``SPAN_BYTES`` together."""
    edges = np.append(starts, end)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(edges, edges[low] + SPAN_BYTES, "right")) - 1
        high = min(len(starts), max(low + 1, high))
        yield low, high
        low = high


def pieces(
    data: np.ndarray, starts: np.ndarray, firsts: np.ndarray, cuts: np.ndarray
) -> list[pa.Array]:
    """Prefix, middle and suffix of every text.

    ``firsts`` is the number of the first unit of each text, with one more
    entry; ``cuts`` has the units before the middle and before the suffix. The
    units of a span are a list array with one list per text. Its values are
    flattened beside the index of their list; their ordinals give a role; each
    role's values are filtered, made lists again and joined. A text over
    several spans is joined once more.
    """
    n = len(firsts) - 1
    parts: list[list[pa.Array]] = [[], [], []]
    owners: list[np.ndarray] = []
    raw = pa.py_buffer(np.ascontiguousarray(data))
    for low, high in _spans(starts, len(data)):
        edges = np.append(starts[low:high], starts[high] if high < len(starts) else len(data))
        text_low = int(np.searchsorted(firsts, low, "right")) - 1
        text_high = int(np.searchsorted(firsts, high, "left"))
        inside = np.diff(np.clip(firsts[text_low : text_high + 1], low, high))
        flat = pa.Array.from_buffers(
            pa.binary(), high - low, [None, pa.py_buffer(edges.astype(np.int32)), raw]
        )
        units = _lists(flat, inside)
        values, parent = pc.list_flatten(units), pc.list_parent_indices(units)
        owner = np.arange(text_low, text_high)
        first = pa.array(firsts[owner])
        ordinal = pc.subtract(pa.array(np.arange(low, high)), pc.take(first, parent))
        after = [
            pc.cast(pc.greater_equal(ordinal, pc.take(pa.array(cuts[owner, i]), parent)), pa.int8())
            for i in (0, 1)
        ]
        role = pc.add(*after)
        for which in (PREFIX, MIDDLE, SUFFIX):
            own = pc.equal(role, which)
            counts = np.bincount(
                np.asarray(pc.filter(parent, own), np.int64), minlength=len(owner)
            )
            parts[which].append(pc.binary_join(_lists(pc.filter(values, own), counts), b""))
        owners.append(owner)
    of = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    per_text = np.bincount(of, minlength=n)
    none = pa.array([], pa.binary())
    found = []
    for which in (PREFIX, MIDDLE, SUFFIX):
        joined = pa.concat_arrays(parts[which]) if parts[which] else none
        # spans follow the texts, so those of a text follow each other
        found.append(pc.binary_join(_lists(joined, per_text), b""))
    return found


def _former(unit: str, plain: int, spm: int):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in runs(batch.column("text")):
                rows = batch.slice(low, high - low)
                yield _formed(rows, unit, plain, spm)

    return form


def _formed(rows: pa.RecordBatch, unit: str, plain: int, spm: int) -> pa.RecordBatch:
    text = rows.column("text")
    data, bounds = as_bytes(text)
    starts = unit_starts(data, bounds, unit)
    firsts = np.searchsorted(starts, bounds)
    n = np.diff(firsts)
    draws = [np.asarray(rows.column(f"h{i}"), np.int64) for i in (1, 2, 3, 4)]
    cuts = np.sort(np.stack([draws[0] % (n + 1), draws[1] % (n + 1)], axis=1), axis=1)

    whole = pc.fill_null(text.cast(pa.string()), "").cast(pa.binary())
    marked = np.zeros(len(n), bool)
    for mark in MARKS:
        marked |= np.asarray(pc.match_substring(whole, mark.encode()))
    is_plain = (np.diff(bounds) == 0) | marked | (draws[2] % 100 >= plain)
    is_spm = ~is_plain & (draws[3] % 100 < spm)
    # plain texts need no pieces
    cuts[is_plain] = n[is_plain, None]
    prefix, middle, suffix = pieces(data, starts, firsts, cuts)
    p, s, m = (pa.scalar(mark.encode(), pa.binary()) for mark in MARKS)
    empty = pa.scalar(b"", pa.binary())
    output = pc.if_else(
        pa.array(is_plain),
        whole,
        pc.if_else(
            pa.array(is_spm),
            pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty),
            pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty),
        ),
    )
    codes = np.where(is_plain, 0, np.where(is_spm, 2, 1))
    # the counts of pieces are in code points, whatever the units are
    sizes = [pc.utf8_length(x.cast(pa.string())) for x in (prefix, middle)]
    hidden = pa.array(is_plain)
    nothing = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            rows.column("id"),
            pa.array(n, pa.int64()),
            pc.take(pa.array([PLAIN, PSM, SPM]), pa.array(codes)),
            *[pc.if_else(hidden, nothing, size.cast(pa.int64())) for size in sizes],
            output.cast(pa.string()),
        ],
        names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "char",
    rate: int = 90,
    spm: int = 20,
    seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n, form, prefix_chars, middle_chars, output``.

    ``n`` is the number of units (``char``, ``word`` or ``line``). Four numbers
    drawn from the seed and the id alone say where a text is cut, whether it is
    transformed (``rate`` in a hundred) and in which order (``spm`` in a hundred
    of those begin with the suffix), so a lost task draws the same again.

    A null text is empty. Empty texts, and texts that hold one of the marks,
    stay plain, and have no piece lengths. Rows of a null id draw as an empty
    id; rows that repeat an id draw the same numbers. Other columns may have any
    name. An empty table gives an empty result. Whole texts are taken; the units
    of a long one are held in spans of a megabyte, so beside the text itself
    memory is bounded.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    draws = [
        F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}")
        for i in range(4)
    ]
    rows = rows.withColumn("digest", digest).select("id", "text", *draws)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    out = rows.mapInArrow(_former(unit, rate, spm), schema)
    return out.withColumnRenamed("id", unused(["n", "form", "prefix_chars", "middle_chars", "output"], id_col))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text from the output and its form alone.

    The pieces hold no mark, and a mark neither begins with another's end nor
    ends with another's beginning, so the first place of each mark is its own.
    """
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    p, s, m = MARKS
    middle = F.substring_index(out, m, -1)
    psm_prefix = F.substring_index(F.substring_index(out, s, 1), p, -1)
    psm_suffix = F.substring_index(F.substring_index(out, m, 1), s, -1)
    spm_prefix = F.substring_index(F.substring_index(out, m, 1), p, -1)
    spm_suffix = F.substring_index(F.substring_index(out, p, 1), s, -1)
    return (
        F.when(kind == PSM, F.concat(psm_prefix, middle, psm_suffix))
        .when(kind == SPM, F.concat(spm_prefix, middle, spm_suffix))
        .otherwise(out)
    )


def digests(formed: DataFrame) -> DataFrame:
    """Hashes in place of the output: of itself and of the text rebuilt from it."""
    others = [F.col(f"`{c}`") for c in formed.columns if c != "output"]
    return formed.select(
        *others,
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )

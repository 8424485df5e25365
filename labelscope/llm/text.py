"""Words, shingles and pieces of whole texts as arrays, batch by batch.

Everything here runs inside Arrow functions. A record batch is taken in runs
of rows of bounded size, so memory follows ``RUN_BYTES`` and the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time.
RUN_BYTES = 1_000_000
#: Bytes hashed at a time; runs are cut between words.
BLOCK_BYTES = 1_000_000

#: The pattern of a word for Spark and DuckDB: anything but these white spaces.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of an odd number, modulo 2 ** 64."""
    steps = np.full(n, base & _MASK, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for blocks of up to n bytes."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _tables:
        _tables[size] = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
    return _tables[size]


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False
) -> np.ndarray:
    """A 64-bit hash of every span [start, end) of the bytes; spans ascend."""
    table = _LOWER if fold_case else _BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        block = data[low : ends[to - 1]]
        power, inverse = _tables_for(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * power[: len(block)], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _ODD)
        at = to
    return out


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives the memory it has used back to the system.

    Python workers outlive their tasks, and what they keep unused counts against
    the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts stay within the limit; a longer text stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(
    data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each text.

    The last entry of the third array is the number of words. ``breaks`` tells
    for each byte whether it stands between words.
    """
    return mask_spans(~breaks[data], bounds)


def mask_spans(
    inside: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_spans` of words whose bytes are those that ``inside`` marks."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:][bounds[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row (one for each place where they fit)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, power in enumerate(powers(_BASE, k)):
        total += words[i : i + n] * power
    return mix(total + np.uint64(k * int(_ODD) & _MASK))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The different hashes, ascending."""
    hashes = np.sort(hashes)
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    return hashes[first]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, the ascending hashes of its distinct shingles of k words.

    Words are those of :data:`WORD` after lower-casing A-Z. A text with fewer
    than k words has its whole word sequence as its one shingle, and a text
    without words, or null, has none.
    """
    for low, high in runs(column):
        data, bounds = as_bytes(column.slice(low, high - low))
        starts, ends, firsts = word_spans(data, bounds)
        words = span_hashes(data, starts, ends, fold_case=True)
        windows = window_hashes(words, k)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            if b - a >= k:
                yield distinct(windows[a : b - k + 1])
            else:
                yield window_hashes(words[a:b], int(b - a)) if b > a else words[:0]

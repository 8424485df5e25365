"""Whole texts to token ids, through the distinct pieces of a run of texts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from labelscope.llm.text import as_bytes, runs, span_hashes

#: Memory of the pieces and encodings that one Python worker remembers.
REMEMBERED_BYTES = 64_000_000

_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def piece_starts(
    data: np.ndarray, bounds: np.ndarray, separators: bytes = b" \n", punctuation: bytes = b""
) -> np.ndarray:
    """Where the texts are cut: at their starts, and before

    - a separator that follows a character which is surely no white space,
    - a punctuation mark that follows an ASCII letter.

    Tokenizers that begin a new word at these places give the same tokens for
    the pieces as for the whole. Where it is not sure what precedes (a
    three-byte character of a block that has spaces), nothing is cut.
    """
    marks = np.zeros(256, bool)
    marks[list(separators)] = True
    cut = marks[data]
    at = np.flatnonzero(cut)
    before = data[np.maximum(at - 1, 0)]
    sure = (before > 32) & (before != 127)
    wide = np.flatnonzero(before >= 128)
    second, third = data[np.maximum(at[wide] - 2, 0)], data[np.maximum(at[wide] - 3, 0)]
    space = (second == 0xC2) & np.isin(before[wide], (0x85, 0xA0))
    space |= (second >= 128) & (second < 0xC0) & (third >= 0xE1) & (third <= 0xE3)
    sure[wide] = ~space
    cut[:] = False
    if punctuation:
        marks[:] = False
        marks[list(punctuation)] = True
        np.logical_and(marks[data[1:]], _LETTER[data[:-1]], out=cut[1:])
    cut[at[sure & (at > 0)]] = True
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(cut)


class Pieces:
    """Remembers the encoding of pieces and puts whole texts together from them.

    Pieces are kept as arrays: their bytes and ids one after the other, and their
    hashes in order, by which a whole run of pieces is looked up at once. A piece
    counts as known only if its bytes are the same too.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]) -> None:
        self.encode = encode
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.data_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def held(self) -> int:
        """Bytes of memory that the known pieces take."""
        n = len(self.order)
        return int(self.data_ends[-1]) + 4 * int(self.ends[-1]) + 32 * n

    def _forget_half(self) -> None:
        """Forget the pieces that have been known for longest."""
        first = (len(self.ends) - 1) // 2
        stays = self.order >= first
        self.hashes, self.order = self.hashes[stays], self.order[stays] - first
        for pool, ends in (("data", "data_ends"), ("ids", "ends")):
            edges = getattr(self, ends)
            setattr(self, pool, getattr(self, pool)[edges[first] : edges[-1]].copy())
            setattr(self, ends, edges[first:] - edges[first])

    def _known(self, data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = self.order[at]
        sizes = np.diff(bounds)
        a, b = self.data_ends[number], self.data_ends[number + 1]
        same = (self.hashes[at] == hashes) & (b - a == sizes)
        hit = np.flatnonzero(same)
        own = data[_ranges(bounds[hit], bounds[hit + 1])]
        other = self.data[_ranges(a[hit], b[hit])]
        # a hash that lies decides nothing
        wrong = np.flatnonzero(own != other)
        if len(wrong):
            same[hit[np.searchsorted(np.cumsum(sizes[hit]), wrong, "right")]] = False
        return np.where(same, number, -1)

    def numbers(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The numbers of different pieces that follow each other, encoding new ones first."""
        if self.held() > REMEMBERED_BYTES:
            self._forget_half()
        hashes = span_hashes(data, bounds[:-1], bounds[1:])
        number = self._known(data, bounds, hashes)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            low, high = bounds[fresh], bounds[fresh + 1]
            found = self.encode([data[a:b].tobytes() for a, b in zip(low, high, strict=True)])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
            n = len(self.ends) - 1
            number[fresh] = np.arange(n, n + len(fresh))
            self.data = _grown(self.data, self.data_ends[-1], data[_ranges(low, high)])
            self.ids = _grown(self.ids, self.ends[-1], flat)
            self.data_ends = np.append(self.data_ends, self.data_ends[-1] + np.cumsum(high - low))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(lengths))
            by_hash = fresh[np.argsort(hashes[fresh], kind="stable")]
            at = np.searchsorted(self.hashes, hashes[by_hash])
            self.hashes = np.insert(self.hashes, at, hashes[by_hash])
            self.order = np.insert(self.order, at, number[by_hash])
        return number

    def of(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple:
        """For each span of the bytes where its ids begin and end in the third result."""
        found = spans(data, starts, ends).dictionary_encode()
        number = self.numbers(*binary_parts(found.dictionary))[np.asarray(found.indices)]
        return self.ends[number], self.ends[number + 1], self.ids


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary values in a row, and where each begins."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _grown(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The pool with ``more`` after what is used; a larger copy only when it is full."""
    if used + len(more) > len(pool):
        larger = np.zeros(2 * (used + len(more)), pool.dtype)
        larger[:used] = pool[:used]
        pool = larger
    pool[used : used + len(more)] = more
    return pool


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans [start, end) of the bytes as an array of binary values."""
    parts = [None, pa.py_buffer(_offsets(starts, ends)), pa.py_buffer(_packed(data, starts, ends))]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), parts)


def _offsets(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans; without a copy where they follow each other."""
    if len(starts) and (starts[1:] == ends[:-1]).all():
        return np.ascontiguousarray(data[starts[0] : ends[-1]])
    return data[_ranges(starts, ends)]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All indexes of the ranges [start, end), one range after the other."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)


@lru_cache(maxsize=4)
def token_pieces(path: str) -> tuple[Pieces, bytes, bytes]:
    """A tokenizer file of the tokenizers library, and where texts may be cut for it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in pieces]
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # a special string must not be cut apart, so what occurs in one is no place to cut
    added = tokenizer.get_added_tokens_decoder().values()
    inside = "".join(t.content for t in added).encode()
    loose = any(t.lstrip or t.rstrip or t.single_word for t in added)
    separators = b"" if loose else bytes(b for b in b" \n" if b not in inside)
    punctuation = b"" if loose else bytes(b for b in _PUNCTUATION if b not in inside)
    return Pieces(encode), separators, punctuation


def encoded(
    column: pa.Array, path: str, end_id: int | None = None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows low to high, all their ids in a row (uint32), and where each text's begin.

    The ids are those that the library gives for each whole text, followed by
    ``end_id``. The tokenizer must begin a new word at a space or line break
    after other text, and at punctuation after a letter, as byte-level and
    word-splitting tokenizers do.
    """
    pieces, separators, punctuation = token_pieces(path)
    for low, high in runs(column):
        data, bounds = as_bytes(column.slice(low, high - low))
        starts = piece_starts(data, bounds, separators, punctuation)
        ends = np.append(starts[1:], len(data))
        a, b, pool = pieces.of(starts, ends, data)
        first = np.searchsorted(starts, bounds)
        total = np.concatenate([[0], np.cumsum(b - a)])[first]
        ids = pool[_ranges(a, b)]
        if end_id is not None:
            ids = np.insert(ids, total[1:], np.uint32(end_id))
            total = total + np.arange(len(total))
        yield low, high, ids, total

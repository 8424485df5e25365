"""License notices in documents: winnowed fingerprints pick candidates, alignment decides."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.text import as_bytes, runs, span_hashes, window_hashes, word_spans

#: Words in a fingerprint of a template of ``LONG`` words or more, at most; shorter
#: templates are noticed by single words.
SHINGLE = 3
LONG = 16
#: Prints of which one is chosen, at most.
MOST_WINDOW = 16
#: Longer templates are refused: an alignment counts in 16 bits.
MOST_WORDS = 30_000
#: Share of a template's words that must be found in order.
LEAST_COVERAGE = 0.8
#: Share of a match that a better one must cover to take its place.
SAME_SPAN = 0.8

#: Words that a short notice must have where its template has them,
#: beside the numbers of versions; and those that make another license of one when
#: they are put in.
NAMES = """
mit isc bsd apache mozilla mpl eclipse epl gnu gpl lgpl agpl cc cc0 commons attribution unlicense
zlib wtfpl ofl openssl
""".split()
MODIFIERS = "lesser affero nc sa nd noncommercial sharealike noderivatives noderivs".split()

#: Short notices by which public licenses are applied, and the
#: beginnings (``-grant``, ``-header``) of some texts that are often cut short.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 "
    "International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
    'this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
    "to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may '
    "not use this file except in compliance with the License. You may obtain a copy of the "
    "License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under "
    "the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met:",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
    "International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related "
    "or neighboring rights to this work.",
    "ISC": "Released under the ISC License.",
    "BSD": "Released under the BSD License.",
    "Apache-2.0-line": "Released under the Apache License 2.0.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
    "International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons "
    "Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons "
    "Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons "
    "Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


@lru_cache(maxsize=1)
def whole_texts() -> Mapping[str, str]:
    """The license texts and whole headers beside this module: ``X-text``, ``X-notice``."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return MappingProxyType({f.stem: f.read_text("utf-8") for f in files})


#: A word is a run of ASCII letters and digits and of other characters beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = as_bytes(texts)
    starts, ends, firsts = word_spans(data, bounds, _BREAK)
    return data, starts, ends, firsts, span_hashes(data, starts, ends, fold_case=True)


@dataclass(frozen=True)
class NoticeIndex:
    """The templates' words, how often each is there, which of them tell, and for
    each print length and window: print -> (template, place)."""

    names: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    bags: tuple[tuple[np.ndarray, np.ndarray], ...]
    telling: tuple[np.ndarray, ...]
    tables: tuple[tuple[int, int, np.ndarray, tuple[tuple[tuple[int, int], ...], ...]], ...]


@lru_cache(maxsize=1)
def _telling() -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the telling words, and of the modifiers among them, ascending."""
    # versions have one or two digits a part, and 0 is often left out
    words = [*NAMES, *MODIFIERS, *map(str, range(1, 100))]
    return tuple(np.sort(_words(pa.array([" ".join(x)]))[4]) for x in (words, MODIFIERS))


def _among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words


def winnowed(prints: np.ndarray, window: int) -> np.ndarray:
    """Places of the least print, the last of equal ones, of every ``window`` in a row.

    A run of so many prints that occurs elsewhere too has the same one chosen.
    """
    n = len(prints) - window + 1
    if n <= 0:
        return np.array([len(prints) - 1 - int(prints[::-1].argmin())] if len(prints) else [], np.int64)
    least, place = prints[:n].copy(), np.arange(n)
    for i in range(1, window):
        lower = prints[i : i + n] <= least
        least[lower] = prints[i : i + n][lower]
        place[lower] = np.flatnonzero(lower) + i
    return np.unique(place)


def needed(n: int, least: float) -> int:
    """How many of a template's ``n`` words must be found."""
    return max(1, math.ceil(least * n - 1e-9))


def index_of(templates: Mapping[str, str], least: float = LEAST_COVERAGE) -> NoticeIndex:
    """The inverted index; a template without words, or beyond ``MOST_WORDS``, is refused.

    A match lacks at most ``spare`` of a template's words, so a run of
    ``need / (spare + 1)`` of them stands together where none are inserted. Prints
    of k words, winnowed over w prints, find every common run of k + w - 1 words:
    k is ``SHINGLE``, and w takes the rest of that run. Such runs are too short to
    be telling in a template of fewer than ``LONG`` words: it is indexed by
    ``spare + 1`` single words, of which a match has one at least, the rarest:
    those in the fewest templates, then the longest.
    """
    names = tuple(sorted(templates))
    found = [_words(pa.array([templates[name]])) for name in names]
    words = [f[4] for f in found]
    in_templates = Counter(w for own in words for w in set(own.tolist()))
    places: dict[tuple, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for t, (_, starts, ends, _, own) in enumerate(found):
        if not 0 < len(own) <= MOST_WORDS:
            raise ValueError(f"{names[t]} has {len(own)} words, of 1 to {MOST_WORDS}")
        need = needed(len(own), least)
        spare = len(own) - need
        if len(own) < LONG:
            size, window, order = 1, 1, sorted(
                range(len(own)),
                key=lambda i: (in_templates[int(own[i])], int(starts[i] - ends[i]), i),
            )
            windows, chosen = window_hashes(own, size), order[: spare + 1]
        else:
            run = math.ceil(need / (spare + 1))
            size = min(SHINGLE, run)
            window = min(run - size, MOST_WINDOW - 1) + 1
            windows = window_hashes(own, size)
            chosen = winnowed(windows, window).tolist()
        for at in chosen:
            places[size, window][int(windows[at])].append((t, at))
    tables = []
    for (size, window), own in sorted(places.items()):
        prints = np.array(sorted(own), np.uint64)
        tables.append((size, window, prints, tuple(tuple(own[int(p)]) for p in prints)))
    bags = tuple(np.unique(own, return_counts=True) for own in words)
    # in a long text the names stand in many places, and any of them may be edited
    telling = tuple(
        np.flatnonzero(_among(own, _telling()[0])) if len(own) < LONG else np.zeros(0, np.int64) for own in words
    )
    return NoticeIndex(names, tuple(words), bags, telling, tuple(tables))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Matched (template, text) places of the longest common subsequence in a band.

    Template word i may match text words from i + diagonal - band to
    i + diagonal + band.
    """
    width = 2 * band + 1
    table = np.zeros((len(template) + 1, width + 2), np.int16)
    same = np.zeros((len(template), width), bool)
    offsets = np.arange(width) + diagonal - band
    for i, word in enumerate(template):
        at = i + offsets
        inside = (at >= 0) & (at < len(words))
        same[i] = inside & (words[np.clip(at, 0, len(words) - 1)] == word)
        # one column to the right is the same text word in the row before
        row = np.maximum(table[i, 2:], table[i, 1:-1] + same[i])
        table[i + 1, 1:-1] = np.maximum.accumulate(row)
    pairs = []
    i, k = len(template), width
    while i > 0 and k > 0:
        value = table[i, k]
        if value == 0:
            break
        if value == table[i, k - 1]:
            k -= 1
        elif value == table[i - 1, k + 1] and k < width:
            i, k = i - 1, k + 1
        else:
            i -= 1
            pairs.append((i, int(i + offsets[k - 1])))
    return pairs[::-1]


def _common(bag: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> int:
    """Words of a template that a text has in any order: no alignment has more."""
    distinct, counts = bag
    place = np.minimum(np.searchsorted(distinct, words), len(distinct) - 1)
    own = np.bincount(place[distinct[place] == words], minlength=len(distinct))
    return int(np.minimum(own, counts).sum())


def _spans(
    template: np.ndarray,
    bag: tuple[np.ndarray, np.ndarray],
    words: np.ndarray,
    low: int,
    high: int,
    need: int,
    telling: np.ndarray,
) -> list[tuple[int, int, int]]:
    """(matched, first word, last word) of the matches on diagonals low to high.

    Left and right of a match the rest is searched again. A match must have all
    the ``telling`` places of the template, and no modifier that the template
    doesn't have.
    """
    middle, band = (low + high) // 2, (high - low + 1) // 2
    spans = []
    parts = [(max(0, middle - band), min(len(words), middle + band + len(template)))]
    while parts:
        a, b = parts.pop()
        if b - a < need or _common(bag, words[a:b]) < need:
            continue
        pairs = align(template, words[a:b], middle - a, band)
        if len(pairs) < need:
            continue
        # the match ends as early as it can; from there back it begins as late
        first, last = a + pairs[0][1], a + pairs[-1][1]
        turned = last + 1 - len(template) - middle
        back = align(template[::-1], words[first : last + 1][::-1], turned, band)
        if len(back) == len(pairs):
            first = last - back[-1][1]
            pairs = [(len(template) - 1 - i, j) for i, j in back]
        if _told(template, telling, pairs, words[first : last + 1]):
            spans.append((len(pairs), first, last))
        parts += [(a, first), (last + 1, b)]
    return spans


def _told(
    template: np.ndarray, telling: np.ndarray, pairs: list[tuple[int, int]], span: np.ndarray
) -> bool:
    """Whether all telling places are matched, and the span has no modifier of another license."""
    matched = np.zeros(len(template), bool)
    matched[[i for i, _ in pairs]] = True
    put_in = span[_among(span, _telling()[1])]
    return bool(matched[telling].all()) and bool(np.isin(put_in, template).all())


def _better(matches: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """The matches that none of a higher coverage has most of the span of."""
    shares = [m[1] / sizes[m[0]] for m in matches]
    kept = []
    for m, share in zip(matches, shares, strict=True):
        least = SAME_SPAN * (m[3] - m[2] + 1)
        beaten = any(
            other > share and min(m[3], x[3]) - max(m[2], x[2]) + 1 >= least
            for x, other in zip(matches, shares, strict=True)
        )
        if not beaten:
            kept.append(m)
    return kept


def _matches(
    words: np.ndarray, hits: list[tuple[int, int, int]], index: NoticeIndex, least: float
) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word) in one text, from its hits.

    Hits of a template whose diagonals are close are a chain. A chain that
    spreads over more than twice the template is taken in overlapping bands.
    Candidates that overlap one of their template with more matches are dropped,
    and those whose span a template with a higher coverage has.
    """
    diagonals = defaultdict(set)
    for t, at, place in hits:
        diagonals[t].add(place - at)
    found = []
    for t, chosen in diagonals.items():
        template, bag = index.words[t], index.bags[t]
        need = needed(len(template), least)
        if len(words) < need or _common(bag, words) < need:
            continue
        band = max(2, len(template) // 8)
        own = sorted(chosen)
        spans: set[tuple[int, int, int]] = set()
        begin = 0
        for i in range(1, len(own) + 1):
            if i < len(own) and own[i] - own[i - 1] <= band:
                continue
            while begin < i:
                # one band holds all diagonals up to a template's length from its first
                end = bisect_right(own, own[begin] + 2 * len(template), begin, i)
                low, high = own[begin] - band, own[end - 1] + band
                spans.update(_spans(template, bag, words, low, high, need, index.telling[t]))
                begin = i if end == i else bisect_right(own, own[begin] + len(template), begin, i)
        taken: list[tuple[int, int]] = []
        for matched, low, high in sorted(spans, key=lambda s: (-s[0], s[2] - s[1], s[1])):
            # taken spans are apart and sorted, so only two neighbours can overlap
            at = bisect_right(taken, (low, high))
            if (at == 0 or taken[at - 1][1] < low) and (at == len(taken) or taken[at][0] > high):
                taken.insert(at, (low, high))
                found.append((t, matched, low, high))
    return sorted(_better(found, [len(w) for w in index.words]), key=lambda m: (m[2], m[3], m[0]))


def _scanner(index: NoticeIndex, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low, high in runs(column):
                part = column.slice(low, high - low)
                data, starts, ends, firsts, words = _words(part)
                hits = defaultdict(list)
                for size, window, prints, entries in index.tables:
                    windows = window_hashes(words, size)
                    at = winnowed(windows, window)
                    place = np.searchsorted(prints, windows[at])
                    place = np.minimum(place, len(prints) - 1)
                    known = prints[place] == windows[at]
                    at, place = at[known], place[known]
                    owner = np.searchsorted(firsts, at, "right") - 1
                    inside = at + size <= firsts[owner + 1]
                    for doc, i, p in zip(owner[inside], at[inside], place[inside], strict=True):
                        for t, j in entries[p]:
                            hits[int(doc)].append((t, j, int(i - firsts[doc])))
                bounds = as_bytes(part)[1]
                rows, out = [], defaultdict(list)
                for doc in sorted(hits):
                    a, b = firsts[doc], firsts[doc + 1]
                    for t, matched, first, last in _matches(words[a:b], hits[doc], index, least):
                        begin, end = starts[a + first], ends[a + last]
                        before = data[bounds[doc] : begin].tobytes().decode()
                        text = data[begin:end].tobytes().decode()
                        rows.append(low + doc)
                        out["license"].append(index.names[t])
                        out["coverage"].append(matched / len(index.words[t]))
                        out["span_start"].append(len(before))
                        out["span_end"].append(len(before) + len(text))
                        out["matched"].append(text)
                if rows:
                    ids = batch.column("id").take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(out["license"], pa.string()),
                            pa.array(out["coverage"], pa.float64()),
                            pa.array(out["span_start"], pa.int64()),
                            pa.array(out["span_end"], pa.int64()),
                            pa.array(out["matched"], pa.string()),
                        ],
                        names=["id", *out],
                    )

    return scan


def license_spans(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    least_coverage: float = LEAST_COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per notice found: the id, ``license, coverage, span_start, span_end, matched``.

    Without ``templates`` these are :data:`NOTICES` and :func:`whole_texts`.
    ``coverage`` is the share of the template's words that the text has in
    order within a band around the diagonal; the span (in characters, the end
    excluded) goes from the first of them to the last. Words are compared
    without punctuation and the case of A-Z. The words that tell licenses apart
    (``NAMES``, ``MODIFIERS`` and version numbers) must all be there in a match of
    a short template, and no match has a modifier that its template hasn't. Of matches of about the same
    span only those of the highest coverage stay. The index of the templates is
    small and goes to every task; documents are scanned where they are read.

    A text may match several templates and one several times; matches of one
    template don't overlap. An empty table gives an empty result. Null and empty texts, and texts without a notice,
    give no row. Repeated rows give repeated results, a null id a null id.
    Whole texts of any length are scanned; other columns may have any name.
    """
    if templates is None:
        templates = {**NOTICES, **whole_texts()}
    text = F.col(f"`{text_col}`").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {id_type}, license string, coverage double, span_start bigint, span_end bigint, "
        "matched string"
    )
    found = rows.mapInArrow(
        _scanner(index_of(templates, least_coverage), least_coverage), schema
    )
    return found.withColumnRenamed("id", id_col)

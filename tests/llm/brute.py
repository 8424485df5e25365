"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int) -> frozenset[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple]:
    """id -> (number of shingles, smallest id reachable), by counting common shingles."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, shingles in sets.items():
        for s in shingles:
            holders[s].append(i)
    common: Counter = Counter()
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                common[a, b] += 1
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}

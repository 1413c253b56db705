"""Brute-force forms of the training-data operators, on plain Python rows."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def crc(key, modulus: int) -> int:
    return zlib.crc32(str(key).encode()) % modulus


def repeats(rows: list[tuple[int, str | None]], width: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    first: dict[tuple, int] = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), sha(" ".join(kept))))
    return out


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, width: int) -> frozenset:
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def union(nodes, links) -> dict:
    """Each node's smallest reachable node."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_duplicates(rows, width: int = 4, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept)."""
    sets = [(doc, shingles(text, width)) for doc, text in rows]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    root = union([d for d, _ in sets], links)
    return [(d, len(s), root[d], root[d] == d) for d, s in sets]

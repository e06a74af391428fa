"""Vectorised word hashing, shared by the operators that compare word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Word hashes that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 200_000

#: Words hashed at once.
BATCH_WORDS = 1 << 18

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes that are not space, \\t, \\n, \\v, \\f or \\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A hash for each run of size word hashes; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by, out = (_B if second else _A), h[:n].copy()
    with np.errstate(over="ignore"):
        for t in range(1, size):
            out = out * by + h[t : t + n]
        out = (out ^ (out >> _S)) * _MIX
        return out ^ (out >> _S)


def winnowed(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values of g, the place of its smallest, the last on ties."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for t in range(1, width):
        less = g[t : t + n] <= best
        best[less] = g[t : t + n][less]
        at[less] = np.flatnonzero(less) + t
    return at


def batched(texts: Iterator[tuple[int, str | None]], known: WordHashes) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(keys, word hashes, ends) for groups of (key, text) with about BATCH_WORDS words each."""
    keys, parts, size = [], [], 0
    for key, text in texts:
        w = split_words(text)
        keys.append(key)
        parts.append(w)
        size += len(w) + 1
        if size >= BATCH_WORDS:
            yield keys, hashed([x for p in parts for x in p], known), np.cumsum([len(p) for p in parts])
            keys, parts, size = [], [], 0
    if keys:
        yield keys, hashed([x for p in parts for x in p], known), np.cumsum([len(p) for p in parts])


def inside(ends: np.ndarray, size: int, n: int) -> np.ndarray:
    """The starts of the runs of size words that stay in one document, of n runs in the batch."""
    ok = np.ones(max(n, 0), bool)
    for e in ends[:-1]:
        ok[max(0, e - size + 1) : e] = False
    return np.flatnonzero(ok)

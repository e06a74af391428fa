"""Plain Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def kept_quality(text):
    n, _, symbols, _, repeats = quality(text)
    t = text or ""
    lines = t.split("\n")
    return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > len(t) or 2 * sum("A" <= c <= "Z" for c in t) > len(t) or len(t) > 16 * n or 5 * len(set(lines)) < 2 * len(lines) - 5)


def classes(rows, similarity=0.8):
    """{doc_id: smallest doc_id of the class}; links: equal texts, or a shared 5-word run and a small edit distance."""
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    first, runs = {}, defaultdict(set)
    for d, t in sorted(rows):
        t = t or ""
        if t in first:
            up[find(d)] = find(first[t])
            continue
        first[t] = d
        w = words(t)
        for i in range(max(1, len(w) - 4) if w else 0):
            runs[tuple(w[i : i + 5])].add(d)
    text, seen = dict(rows), set()
    for group in runs.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = words(text[a]), words(text[b])
                    band = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
                    if max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) <= band and distance(x, y) <= band:
                        p, q = sorted((find(a), find(b)))
                        up[q] = p
    return {d: find(d) for d in up}


def without_repeats(rows, length=13):
    """{doc_id: (words, kept words)}; ids must differ."""
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            run = tuple(w[i : i + length])
            least[run] = min(least.get(run, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - length + 1) if least[tuple(w[i : i + length])] < d for k in range(length)}
        out[d] = (w, [x for i, x in enumerate(w) if i not in gone])
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

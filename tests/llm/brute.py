"""Plain re-computations of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def classes(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text, size=5):
    words = [w.translate(ASCII_LOWER) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar(texts, percent=75):
    """{id: (n_shingles, component)} from {id: text}."""
    sets = {k: shingles(t) for k, t in texts.items()}
    index = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            index[x].add(k)
    links = []
    for k, s in sets.items():
        shared = Counter(o for x in s for o in index[x] if o < k)
        links += [(k, o) for o, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[o]) - n)]
    group = classes(texts, links)
    return {k: (len(sets[k]), group[k]) for k in texts}


def without_repeats(texts, long=200):
    """{id: (n_bytes, n_removed, n_spans, sha256)} from {id: text}."""
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(d[i : i + long] for d in data.values() for i in range(len(d) - long + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - long + 1):
            if seen[d[i : i + long]] > 1:
                gone[i : i + long] = b"\x01" * long
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[k] = len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def edits(item, words):
    """Least word edit distance of the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)

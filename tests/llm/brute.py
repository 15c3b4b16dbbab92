"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def blank_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size=2):
    words = blank_words(text)
    return set() if not words else {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def components(rows, percent=80):
    """doc_id -> (set size, smallest linked id) for (doc_id, text) rows with distinct ids, by counting shared shingles of all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                shared[i, j] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(docs, items, window=13):
    """doc_id -> (n_words, n_hit, n_items, digest, contaminated) by looking up every window of every item."""
    windows = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        w = min(window, len(words))
        for i in range(len(words) - w + 1 if words else 0):
            windows[tuple(words[i : i + w])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        words, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                got = windows.get(tuple(words[i : i + n]))
                if got:
                    found |= got
                    hit.update(range(i, i + n))
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out

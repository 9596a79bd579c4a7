"""Plain versions of what the operators compute, over lists of (id, text)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(UPPER))


def shingle_set(text, size):
    w = words(text, SOLID)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def union_find(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


def jaccard_components(rows, size=4, percent=85):
    """Per row (id, size of its set, smallest id it can reach)."""
    sets = [shingle_set(t, size) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for held in holders.values():
        for k, b in enumerate(held):
            for a in held[:k]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = union_find(len(rows), links)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root[i]].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(sets[i]), least[root[i]]) for i, (d, _) in enumerate(rows)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]

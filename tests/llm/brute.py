"""Plain versions of the operators' contracts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key, k):
    return zlib.crc32(("" if key is None else str(key)).encode()) % k


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def simhash(text, k=3):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) * 2 > len(h)) if h else 0


def least_of_groups(ids, linked):
    """The smallest id of each id's component, None last."""
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def similar(a, b, k=5, least=0.8):
    x, y = set(shingles(a, k)), set(shingles(b, k))
    return len(x & y) >= least * len(x | y) if x or y else True


def base_scores(rows):
    """(n_tokens, n_known, N, base) of (id, text) rows."""
    toks = [WORD.findall((t or "").translate(LOW)) + [None] for _, t in rows]
    c = Counter()
    for (key, _), t in zip(rows, toks):
        if fold(key, 10):
            c.update(t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for t in toks]


def word_edits(item, text):
    """Edits between an item's words and the best stretch of a text's words."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes by source -> targets."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        each = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s for s in free if each[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else each[s] for s in order}
        full |= over


def lengths(x):
    return np.array([len(i) for i in x])

"""Fixtures and plain versions that the operators are held against."""

from __future__ import annotations

import random
import re
from collections import Counter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, parts=4):
    """A documents table from (doc_id, text)."""
    full = [(d, t, "en", None, len(t) if t is not None else None) for d, t in rows]
    return spark.createDataFrame(full, DOC).repartition(parts)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def copies(seed, n=300, bases=8):
    """Texts with exact and near copies of some bases, and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopü") + rng.choice("qrst")
    originals = [[word() for _ in range(rng.randint(5, 120))] for _ in range(bases)]
    out = []
    for i in range(n):
        words = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            p = rng.randrange(len(words))
            words[p] = rng.choice([f"zz{rng.randrange(9)}", words[p] + "x"])
        out.append((100 + i, " ".join(words)))
    return out


def words_of(text):
    folded = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def jaccard_plain(given, size, percent):
    sets = []
    for _, t in given:
        w = words_of(t)
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] * bool(w)
        sets.append(frozenset(grams))
    parent = {d: d for d, _ in given if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        if given[i][0] is None:
            continue
        met = Counter(j for g in s for j in holders.get(g, ()))
        for j, k in met.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(given[i][0]), find(given[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(given, sets, strict=True)), key=str)


def repeats_plain(given, length=50):
    """(doc_id, kept bytes, removed, spans)."""
    first = {}
    coded = [(d, (t or "").encode()) for d, t in given]
    for d, b in coded:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, b in coded:
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), spans))
    return sorted(out, key=str)

"""Small documents with the cases that every operator must stand, and plain-Python forms of the contracts."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc long, row long, h long, c long, t string, id string, length int, words string, _row long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the other columns clash with names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), 7, 7, 7, 7, "x", "x", 7, "x", 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, width=5):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(fold)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def components(rows, width=5):
    """(doc_id, text) -> component id by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    comp = {i: i for i, _ in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return {i: find(i) for i, _ in sets}


def removed(rows, span):
    """(doc_id, text) -> for each row, which words a window covers that also starts in a smaller doc_id."""
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - span + 1):
            if i is not None:
                first[tuple(w[a : a + span])] = min(first.get(tuple(w[a : a + span]), i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            if i is not None and first[tuple(w[a : a + span])] < i:
                gone[a : a + span] = [True] * span
        out.append(gone)
    return out

"""Small document tables with the awkward cases, and plain versions of what the operators compute."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile("[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, lang="en", source="s"):
    """(id, text) rows as documents."""
    return table(spark, [(i, t, lang, source, len(t or "")) for i, t in texts], DOCS)


def shingle_set(text, size):
    w = words((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def linked_groups(texts, size, percent):
    """Smallest id of the component of every id, by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in texts}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}

import random
import re

import pytest
from helpers import documents

from leadloom.llm import decontam


def split(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def runs(words, n):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def plain(docs, items, percent=80):
    out = set()
    for item, q in items:
        w = split(q)
        n = min(5, len(w))
        if not n:
            continue
        own = runs(w, n)
        for doc, t in docs:
            k = len(own & runs(split(t), n))
            if 100 * k >= percent * len(own):
                out.add((doc, item, k, len(own)))
    return out


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    items = [(i, text(rng, rng.choice([5, 6, 9, 15, 17, 31, 33, 59, 140]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "One, two"), (103, "solo"), (104, "é ü"), (105, items[3][1].upper()), (None, items[4][1]), (106, "same same same same same same same")]
    docs = [(i, text(rng, rng.choice([1, 4, 50, 400]))) for i in range(60)]
    for k in range(80):
        _, q = items[rng.randrange(40)]
        w = q.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "zz"
        lead = text(rng, rng.randrange(300)) if rng.random() < 0.9 else ""
        docs.append((200 + k, lead + rng.choice([" ", "\n", ". "]) + rng.choice([" ", ", ", "\n"]).join(w).title() + " " + text(rng, rng.randrange(40))))
    docs += [(500, None), (501, ""), (502, "x one two solo é ü"), (503, text(rng, 40_000) + " " + items[0][1] + " " + text(rng, 10_000)), (504, "same " * 20),
             (505, items[5][1]), (505, items[5][1]), (505, items[6][1]), (None, items[7][1])]
    return docs, items


def test_leaks_equal_plain_containment(spark, data):
    docs, items = data
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    found = decontam.find(documents(spark, docs), bench)
    got = [(r.doc_id, r.item_id, r.n_common, r.n_item) for r in found.collect()]
    assert set(got) == plain(docs, items)
    assert len(got) == len(set(got))


def test_documents_with_leaks_go(spark, data):
    docs, items = data
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, *_ in plain([(k, t) for k, (_, t) in enumerate(docs)], items)}
    kept = [(r.doc_id, r.text) for r in decontam.without_leaks(documents(spark, docs), bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(x) for k, x in enumerate(docs) if k not in bad)


def test_full_filter_changes_nothing(spark, data):
    docs, items = data
    bench = spark.createDataFrame(items, "item_id long, text string")
    small, wide = ({tuple(r)[:4] for r in decontam.find(documents(spark, docs), bench, bits=b).collect()} for b in (8, 20))
    assert small == wide


def test_empty(spark):
    docs, none = documents(spark, [(1, "a b c d e f")]), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.find(docs, none).count() == 0 and decontam.find(docs.where("false"), some).count() == 0
    assert decontam.without_leaks(docs, none).count() == 1 and decontam.without_leaks(docs, some).count() == 0

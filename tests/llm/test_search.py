import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=50):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("y"))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    common = ["the", "of", "and", "a"]
    rare = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(120)]

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))

    docs = [(i, text(rng.choice([1, 5, 30, 80]))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (900, None), (901, ""), (902, "!? -"), (903, "The-OF_and\x00a1É Straße"), (904, text(40_000))]
    stem = text(6)
    items = [(i, stem * (i % 2) + " " + text(rng.choice([3, 8, 20]))) for i in range(25)]
    items += [(50, None), (51, " ..."), (52, "nowhere found"), (2, text(4)), (None, text(5)), (53, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("block, cells", [(1 << 18, 1 << 22), (40, 1 << 10)])
def test_equals_plain_ranking(spark, case, monkeypatch, block, cells):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = case
    for top in (50, 3):
        found = sorted(map(tuple, search.rank(*tables(spark, docs, items), top=top).collect()), key=str)
        assert found == plain(docs, items, top)


def test_empty_tables(spark, case):
    docs, items = case
    d, q = tables(spark, docs, items)
    assert search.rank(d.where("false"), q).count() == 0
    assert search.rank(d, q.where("false")).count() == 0
    assert search.rank(d.where("text is null"), q).count() == 0


def test_plan_shares_sets_and_adds_up():
    rng = random.Random(9)
    items = [sorted(rng.sample(range(40), rng.randint(1, 12))) + ([40, 41, 42] if i % 3 else []) for i in range(30)]
    plan = search.Plan(items, 43)
    assert plan.leaf[40] == plan.leaf[41] == plan.leaf[42]       # the same items hold them
    assert plan.sums and sum(map(len, plan.items)) < sum(map(len, items)) // 2

    def all_terms(node):
        if node < plan.leaves:
            return np.flatnonzero(plan.leaf == node).tolist()
        return [t for n in plan.sums[node - plan.leaves] for t in all_terms(n)]

    for own, nodes in zip(items, plan.items):
        assert sorted(t for n in nodes for t in all_terms(n)) == own  # every term once
    assert search.Plan([[]], 0).items == [set()]

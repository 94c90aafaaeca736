import random

import pytest
from helpers import DOCS, documents, linked_groups, shingle_set
from pyspark.sql import functions as F

from leadloom.llm import blocks, common, jaccard
from leadloom.llm.components import components


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage = text(rng, 60)
    rows = [(i, text(rng, rng.choice([1, 2, 3, 4, 8, 20, 60, 150]))) for i in range(120)]
    for g in range(12):
        base = text(rng, rng.choice([10, 30, 80, 200, 400]))
        rows += [(1000 + 100 * g + k, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5, 8]))) for k in range(rng.randint(2, 14))]
    rows += [(5000 + i, text(rng, 40) + " " + passage + " " + text(rng, 20)) for i in range(30)]  # a passage in common is no link
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "One  two"), (6004, "one TWO"), (6005, "one"), (6006, text(rng, 30_000))]
    chain = text(rng, 100).split()
    for k in range(12):  # neighbours are linked, the ends are not
        rows.append((7000 + k, " ".join(chain[2 * k:] + [f"n{j}" for j in range(2 * k)])))
    return rows


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 70)])
def test_components_equal_all_pairs(spark, texts, size, percent):
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.join(documents(spark, texts), size, percent).collect()}
    tops, sizes = linked_groups(texts, size, percent)
    assert found == {i: (tops[i], sizes[i]) for i in tops}


def test_large_blocks_are_searched_in_slices(spark, texts, monkeypatch):
    rng = random.Random(8)
    base = text(rng, 60)
    rows = texts + [(8000 + k, edited(rng, base, rng.randint(0, 3))) for k in range(150)]
    monkeypatch.setattr(blocks, "SLICE", 8)
    monkeypatch.setattr(blocks, "CROWD", 5)
    monkeypatch.setattr(blocks, "FLUSH", 3000)
    found = {r.doc_id: r.component_id for r in jaccard.join(documents(spark, rows), 3, 90).collect()}
    assert found == linked_groups(rows, 3, 90)[0]


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 2), (None, "a b c d", 3), (None, "z", 4), (2, "a b c d", 5), (9, "q r s", 6), (9, "u v w", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    found = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.join(docs, 3, 90).collect())
    assert found == sorted([("3", "2"), ("3", "2"), ("None", "2"), ("None", "None"), ("2", "2"), ("9", "9"), ("9", "9")])
    assert jaccard.join(docs.where("false"), 3, 90).count() == 0


def test_one_of_each_group_stays(spark, texts):
    docs = documents(spark, texts + texts[:5])
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs, 5, 80).collect())
    tops, sizes = linked_groups(texts, 5, 80)
    assert kept == sorted(set(tops.values()))
    rows = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(map(str, jaccard.keep_one(rows, 5, 80).collect())) == sorted(map(str, rows.where("text is null").union(rows.where("doc_id = 1 and text is not null").limit(1)).collect()))


def test_search_equals_counting():
    rng = random.Random(5)
    sets = []
    for _ in range(40):
        base = {rng.randrange(60) for _ in range(rng.randint(1, 40))}
        sets += [base, {x for x in base if rng.random() > 0.08} | {rng.randrange(60) for _ in range(rng.randint(0, 2))} or {1}]
    import numpy as np

    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for percent in (60, 80, 90, 100):
        index = jaccard.Index(arrays, percent)
        for s, a in zip(sets, arrays):
            want = [i for i, t in enumerate(sets) if 100 * len(s & t) >= percent * len(s | t)]
            assert index.search(a) == want


def test_sketches_differ_no_more_than_sets():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        base = {rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 32, 33, 100, 700]))}
        other = {x for x in base if rng.random() > 0.1} | {rng.getrandbits(64) for _ in range(rng.randint(1, 60))}
        a, b = (np.array(sorted(x), np.uint64) for x in (base, other))
        words = min(len(blocks.sketch(a)), len(blocks.sketch(b)))
        x, y = (blocks.folded(blocks.sketch(s)[None, :], words)[0] for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(base ^ other)
        assert len(blocks.sketch(a)) == 1 or blocks.folded(blocks.sketch(a)[None, :], 1)[0, 0] == np.bitwise_xor.reduce(blocks.sketch(a))


def test_near_links_join_all_near_pairs():
    import numpy as np

    rng = random.Random(4)
    sets = [{rng.getrandbits(64) for _ in range(60)} for _ in range(4)]
    sets = [s if k < 4 else {x for x in rng.choice(sets) if rng.random() > 0.1} for k, s in enumerate(sets + [None] * 60)]
    sizes = np.array([len(s) for s in sets])
    sketches = np.array([blocks.folded(blocks.sketch(np.array(sorted(s), np.uint64))[None, :], 1)[0] for s in sets])
    top = {i: i for i in range(len(sets))}
    for a, b in blocks.near_links(np.arange(len(sets)), sizes, sketches, 80):
        low, high = sorted((top[a], top[b]))
        top = {k: low if v == high else v for k, v in top.items()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= 80 * len(a | b):
                assert top[i] == top[j]


def test_similar_sets_share_a_signature():
    import numpy as np

    rng = random.Random(6)
    for percent in (70, 80, 90):
        classes = jaccard.Classes(percent)
        for _ in range(400):
            n = rng.choice([1, 2, 3, 5, 9, 10, 19, 20, 21, 57, 120, 300])
            base = [rng.getrandbits(64) for _ in range(n)]
            other = list(base)
            while True:  # as far away as is still similar
                trial = other[1:] if rng.random() < 0.5 and len(other) > 1 else other + [rng.getrandbits(64)]
                common_ = len(set(trial) & set(base))
                if 100 * common_ < percent * len(set(trial) | set(base)):
                    break
                other = trial
            a, b = (np.concatenate(jaccard.signatures(np.array(sorted(set(x)), np.uint64), classes)) for x in (base, other))
            assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("part", [1 << 18, 12])
def test_components_of_paths_and_stars(spark, part, monkeypatch):
    from leadloom.llm import components as module

    monkeypatch.setattr(module, "PART", part)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)] + [(301, 300), (300, 301)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("first", [0, 30])
def test_components_name_each_node_once(spark, first, monkeypatch):
    from leadloom.llm import components as module

    monkeypatch.setattr(module, "PART", 12)
    triangle = [(first + 2, first + 1), (first + 3, first + 1), (first + 3, first + 2)]
    edges = triangle + [(100 + i, 100) for i in range(1, 18)]
    found = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == [(first + i, first + 1) for i in (1, 2, 3)] + [(100 + i, 100) for i in range(18)]

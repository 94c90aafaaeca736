import math
import random
from collections import Counter

import pytest
from helpers import FOLD, documents, words

from leadloom.llm import lm


def plain(texts, target, size):
    """Scores by counting in dictionaries."""
    split = {k: [w.translate(FOLD) for w in words(t)] for k, (_, t) in enumerate(texts)}
    counts = Counter(w for k, ws in split.items() if texts[k][0] in target for w in ws)
    vocabulary = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:size]]
    known = set(vocabulary)
    models = []
    for inside in (lambda k: texts[k][0] in target, lambda k: True):
        pairs, single, before = Counter(), Counter(), Counter()
        for k, ws in split.items():
            if inside(k):
                ids = [None] + [w if w in known else "?" for w in ws]
                for a, b in zip(ids, ids[1:]):
                    pairs[a, b] += 1
                    single[b] += 1
                    before[a] += 1
        total = sum(single.values())
        s = lm.STRENGTH

        def loss(a, b, pairs=pairs, single=single, before=before, total=total):
            return -math.log2((pairs[a, b] + s * (single[b] + s / (len(vocabulary) + 1)) / (total + s)) / (before[a] + s))

        models.append(loss)
    out = []
    for k, ws in split.items():
        ids = [None] + [w if w in known else "?" for w in ws]
        found = [sum(m(a, b) for a, b in zip(ids, ids[1:])) / len(ws) if ws else None for m in models]
        out.append((texts[k][0], len(ws), *found, None if not ws else found[0] - found[1]))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    lists = [["alpha", "Beta", "gamma", "delta"], ["x", "y", "beta", "z"]]
    rows = [(i, " ".join(rng.choice(lists[i % 2]) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "never seen words"), (None, "alpha beta"), (0, rows[0][1]), (103, "alpha " * 30_000)]


@pytest.mark.parametrize("size", [3, 50])
def test_scores_equal_plain(spark, texts, size, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 200)
    target = {i for i, _ in texts if i is not None and i % 2 == 0 and i < 100}
    ids = spark.createDataFrame([(i,) for i in target] * 2 + [(None,)], "doc_id long")
    found = lm.cross_entropy_difference(documents(spark, texts), ids, size).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2])[:8])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(plain(texts, target, size), key=key), strict=True):
        assert got[:2] == want[:2]
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(got[2:], want[2:]))


def test_target_texts_score_lower(spark, texts):
    target = [(i,) for i, _ in texts if i is not None and i % 2 == 0 and i < 100]
    rows = lm.cross_entropy_difference(documents(spark, texts), spark.createDataFrame(target, "doc_id long")).where("doc_id < 80 and n_words > 9").collect()
    assert max(r.score for r in rows if r.doc_id % 2 == 0) < min(r.score for r in rows if r.doc_id % 2)


def test_no_target_and_empty(spark, texts):
    none = spark.createDataFrame([], "doc_id long")
    assert lm.cross_entropy_difference(documents(spark, texts), none).where("n_words > 0 and score is null").count() == 0
    assert lm.cross_entropy_difference(documents(spark, texts).where("false"), none).count() == 0
    rows = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, target int, score int")
    assert lm.cross_entropy_difference(rows, rows.select("doc_id")).first().n_words == 2


def test_every_word_of_the_target_counts(spark):
    rows = [(i, " ".join(f"common{j % 7} w{i * 50 + j}" for j in range(50))) for i in range(60)]
    rows += [(100, "common1 w2998"), (101, "common1 w2999 w1"), (102, "common1 nowhere")]
    found = sorted(map(tuple, lm.cross_entropy_difference(documents(spark, rows), spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).collect()))
    for got, want in zip(found, sorted(plain(rows, set(range(60)), 10**9)), strict=True):
        assert got[:2] == want[:2] and all(abs(a - b) < 1e-9 for a, b in zip(got[2:], want[2:]))
    assert found[-3][4] != found[-1][4]  # of 3007 words in the target, the last is no unknown word

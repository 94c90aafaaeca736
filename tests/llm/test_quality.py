import random
from collections import Counter

import pytest
from helpers import documents, words

from leadloom.llm import quality


def plain(text):
    w = words(text)
    runs = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {k for k, n in Counter(runs).items() if n > 1}
    covered = {i + j for i, r in enumerate(runs) if r in often for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def good(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8))) + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, good(rng)) for i in range(150)]
    rows += [(200 + i, " ".join(w + "###" for w in good(rng).split())) for i in range(8)]
    rows += [(300 + i, " ".join([w] * 20 for w in ()) or " ".join(w for w in good(rng, 8).split() for _ in range(20))) for i in range(8)]
    rows += [(400 + i, "\n".join([" ".join(w.upper() + "!!" for w in good(rng, 30).split())] * 5)) for i in range(8)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "a"), (504, "é b é b é b"), (505, "x\ny\nx\n \nx"), (506, good(rng, 60_000)),
             (None, good(rng)), (507, "one two three"), (507, "one two three")]
    return rows


def test_counts_equal_plain_ones(spark, texts):
    found = quality.quality(documents(spark, texts)).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept").collect()
    want = Counter((i, *plain(t)) for i, t in texts)
    assert Counter(tuple(r)[:6] for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark, texts):
    kept = {r.doc_id for r in quality.quality(documents(spark, texts)).where("kept").collect()}
    assert {i for i, _ in texts if i is not None and i < 200} <= kept
    assert not [i for i in kept if i is not None and 200 <= i < 500]
    assert None in kept and 506 in kept


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 7, True)], "doc_id long, text string, n_words int, kept boolean")
    assert quality.quality(rows).count() == 1
    assert quality.quality(rows.where("false")).count() == 0


def test_em_finds_the_bad_kinds():
    import numpy as np

    codes = np.array([sum(3 ** i * v for i, v in enumerate(votes)) for votes in ([1] * 10, [2, 1, 1, 0, 2, 1, 1, 2, 1, 1], [1, 2, 2, 1, 1, 2, 1, 1, 1, 2], [1, 1, 0, 1, 1, 1, 2, 1, 2, 1])])
    share, model = quality.learn(codes, np.array([900, 40, 30, 30]))
    assert share[0] > 0.99 and (share[1:] < 0.01).all()
    assert abs(model["shares"].sum() - 1) < 1e-9

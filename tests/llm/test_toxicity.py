import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import documents

from leadloom.llm import toxicity

BAD = ["idiot", "moron", "worthless"]


def plain_kernel(a, b):
    def parts(x):
        out = defaultdict(float)
        for c in itertools.combinations(range(len(x)), 3):
            if c[-1] - c[0] < toxicity.SPAN:
                out["".join(x[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    def product(x, y):
        return sum(v * y[k] for k, v in x.items() if k in y)

    a, b = parts(a), parts(b)
    return product(a, b) / ((product(a, a) * product(b, b)) ** 0.5 or 1)


def test_kernel_equals_all_subsequences():
    rng = random.Random(1)
    words = ["^" + "".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    found = toxicity.Landmarks(toxicity._letters(words)).kernel(toxicity._letters(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(found[i, j] - plain_kernel(a, b)) < 1e-9


def clean_text(rng, n=40):
    parts = ["tha", "re", "on", "ing", "st", "er", "wh", "ou", "ble", "ti", "ea"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + "." * (i % 9 == 8) for i in range(n)) + "."


def toxic_text(rng, word):
    w = clean_text(rng).split()
    w.insert(rng.randrange(len(w)), word)
    return " ".join(w)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, clean_text(rng)) for i in range(120)] + [(200 + i, toxic_text(rng, rng.choice(BAD) + rng.choice(["", ",", "!"]))) for i in range(60)] + [(400, None)]
    labels = [(i, int(i >= 200)) for i, _ in rows] + [(None, 1), (5, None), (9999, 1)]
    return toxicity.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_texts(spark, model):
    rng = random.Random(3)
    rows = [(i, clean_text(rng)) for i in range(80)] + [(200 + i, toxic_text(rng, w)) for i, w in enumerate(BAD * 10)]
    found = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), model).collect()}
    assert all((found[i] >= 0.5) == (i >= 200) for i in found)


def test_gaps_and_inserted_characters(spark, model):
    rng = random.Random(4)
    forms = ["IDIOT", "idixot", "id-iot", "i.d.i.o.t", "i d i o t", "mor_on", "worthhless", "\"moron\"", "w-o-r-t-h-l-e-s-s", "idiots"]
    rows = [(i, toxic_text(rng, w)) for i, w in enumerate(forms)]
    low = [(forms[r.doc_id], r.score) for r in toxicity.score(documents(spark, rows), model).collect() if r.score < 0.5]
    assert not low


def test_table_equals_kernels_and_skips_change_no_score(model):
    rng = random.Random(5)
    words = ["^" + "".join(rng.choice("idotmrnwhles") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    letters = toxicity._letters(words)
    plain = toxicity.Landmarks(toxicity._letters(model.names)).kernel(letters) @ model.weights + model.offset
    assert np.abs(model.values(letters, -np.inf) - plain).max() < 1e-9
    for floor in (model.floor, model.offset, 0.5):
        assert np.abs(model.values(letters, floor) - np.maximum(plain, floor)).max() < 1e-9


def test_every_witness_is_covered():
    rng = random.Random(8)
    words = ["^" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    letters = toxicity._letters(words)
    chosen, kernel = toxicity.cover(letters, np.array([rng.randint(1, 9) for _ in words], float), toxicity._features(letters))
    assert np.abs(kernel - toxicity.Landmarks(letters[chosen]).kernel(letters)).max() < 1e-9
    assert (kernel.max(axis=1) >= toxicity.COVER - 1e-9).all() and len(chosen) < len(words)


def test_three_hundred_stems_in_four_scripts(spark):
    """Fresh texts with stems that were seen a few times each: nearly all are caught, hardly a clean one is flagged."""
    rng = random.Random(11)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"]

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))

    stems = [word(scripts[i % 4]) for i in range(300)]
    plain = [[word(s) for _ in range(1000)] for s in scripts]

    def text(stem=None):
        own = rng.choice(plain)
        out = [rng.choice(own) for _ in range(20)]
        if stem:
            out.insert(rng.randrange(len(out)), stem)
        return " ".join(out)

    train = [(i, text()) for i in range(1500)] + [(5000 + i, text(stems[i % 300])) for i in range(1500)]
    model = toxicity.learn(documents(spark, train), spark.createDataFrame([(i, int(i >= 5000)) for i, _ in train], "doc_id long, toxic int"))
    # a word that stands in a dozen toxic texts and in no clean one cannot be told from an insult: fresh clean texts are of words seen in clean ones
    seen = {w for i, t in train if i < 5000 for w in t.split()}
    plain = [[w for w in own if w in seen] for own in plain]
    assert min(map(len, plain)) > 990
    fresh = [(i, text()) for i in range(600)] + [(5000 + i, text(s)) for i, s in enumerate(stems)]
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(documents(spark, fresh), model).collect()}
    recall = sum(found[5000 + i] for i in range(300)) / 300
    flagged = sum(found[i] for i in range(600)) / 600
    print(f"recall {recall:.2f}, clean texts flagged {flagged:.2f}, landmarks {len(model.names)}")
    assert recall > 0.95 and flagged < 0.05


def test_awkward_rows(spark, model):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "..."), (None, toxic_text(rng, "moron")), (5, "ab" * 5000 + "moron"), (6, clean_text(rng, 40_000)), (6, "idiot"), (6, "idiot"), (7, "東 é \U0001F600")]
    found = [(r.doc_id, r.score) for r in toxicity.score(documents(spark, rows), model).collect()]
    assert len(found) == len(rows) and all(0 <= s <= 1 for _, s in found)
    assert {s >= 0.5 for i, s in found if i in (1, 2, 3, 4, 7)} == {False}
    assert [s for i, s in found if i is None][0] >= 0.5
    docs = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, toxic int")
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.learn(docs, docs.select("doc_id", "toxic").where("false"))
    assert none is None and toxicity.score(docs, none).first().score == 0.0

import random

import pytest
from helpers import DOCS, table
from pyspark.sql import functions as F

from leadloom.llm import langid

PARTS = {"aa": ["tha", "ing", "and", "ou"], "bb": ["ción", "que", "ado", "los"], "cc": ["keit", "ung", "sch", "ä"]}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(PARTS) * 40)] + [(None, "x", None), (900, None, "aa")]
    return langid.learn(spark.createDataFrame(rows, "key long, text string, label string"))


def test_held_out_accuracy(spark, model):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, 8), lang, "s", 0) for i, lang in enumerate(list(PARTS) * 30)]
    found = langid.identify(table(spark, rows, DOCS), model, keep=["doc_id", "lang"])
    assert found.where("lang <> lang_pred").count() == 0
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_texts_without_letters(spark, model):
    rows = [(1, None, None, None, 0), (2, "", "x", "s", 0), (3, "12 -- 34 _", "x", "s", 0), (None, "ä", "x", "s", 0), (4, text(random.Random(1), "bb", 50_000), "x", "s", 0)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table(spark, rows, DOCS), model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[None][0] == "cc" and found[4][0] == "bb"


def test_scores_equal_plain_bayes(model):
    import numpy as np
    import pyarrow as pa

    labels, logs = model
    texts = ["The ou que", "schung", "a"]
    names, scores = langid.score_texts(pa.array(texts), labels, logs)
    for t, name, score in zip(texts, names, scores):
        buckets, _ = langid._grams(pa.array([t]))
        total = logs[:, -1] + sum(logs[:, b] for b in buckets)
        p = np.exp(total - total.max())
        assert name == labels[int(total.argmax())] and abs(score - p.max() / p.sum()) < 1e-9


def test_nothing_to_learn_from(spark):
    none = langid.learn(spark.createDataFrame([(1, "a", None)], "key long, text string, label string"))
    rows = table(spark, [(1, "abc", "x", "s", 0)], DOCS)
    assert langid.identify(rows, none).first().lang_pred == "und"
    assert langid.identify(rows.where(F.lit(False)), none).count() == 0

import random
from collections import defaultdict

import pytest
from helpers import DOCS, words
from pyspark.sql import functions as F

from leadloom.llm import mixing


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        source = rng.choice(["big"] * 6 + ["a", "b", "é", "zz", None, ""])
        out.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "en", source, 0))
    out += [(900, None, "en", "blank", 0), (None, "x y", "en", "a", 0), (901, "p q", "en", "a", 0), (901, "p q", "en", "a", 0), (902, "w " * 40_000, "en", "long", 0)]
    return out


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 3 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **{s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}}
        capped.update({s: 3.0 * sizes[s] for s in over})


def test_mix_equals_plain(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.by_first_position(mixing.mix(docs)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    places = [r.position for r in found if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)


def test_reruns_and_partitions_agree(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(7, "text")))
    assert a == b


def test_positions_invert_the_demand(spark):
    knots = (0.5, 2.0, 0.0, 1.0)
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("share"), F.array(*map(F.lit, knots)).alias("knots"))
    rows = mixing.with_steps(rows).withColumn("time", mixing.time_at(F.col("share")))
    back = rows.select("share", mixing.share_at(F.col("time"), F.col("knots")).alias("again"), "time").collect()
    assert all(abs(r.share - r.again) < 1e-9 for r in back)
    assert all(a.time <= b.time for a, b in zip(back, back[1:]))


def test_training_order_has_every_pass(spark, rows):
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS))
    order = mixing.training_order(mixed).collect()
    assert sum(r.words for r in order) == mixed.agg(F.sum("taken")).first()[0]
    assert [r.position for r in order] == sorted(r.position for r in order)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, size int, target int")
    assert [(r["size"], r.taken) for r in mixing.mix(docs).collect()] == [(2, 2)]
    assert mixing.by_first_position(mixing.mix(docs.where("false"))).count() == 0


def test_no_python_in_the_plan(spark, rows, capsys):
    mixing.by_first_position(mixing.mix(spark.createDataFrame(rows, DOCS))).explain()
    assert "Python" not in capsys.readouterr().out

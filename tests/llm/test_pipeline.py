"""The pipeline against each stage by hand, and the registered queries against their SQL."""

import random

import pytest
from check_oracle import connect
from check_oracle import compare
from helpers import DOCS, linked_groups, words
from test_decontam import plain as plain_leaks
from test_mixing import plain_targets
from test_toxicity import BAD, clean_text, toxic_text

import __spark_entry__ as entry
import corpus_pipeline

NAMES = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] + ["pipeline"]


@pytest.fixture(scope="module")
def folder(spark, sf_copy):
    rng = random.Random(12)
    rows, labels = [], []

    def add(i, text, source="a"):
        rows.append((i, text, "en", source, len(text or ""), "kept"))

    items = [(k, " ".join(clean_text(rng, 30).split())) for k in range(6)]
    for i in range(150):
        add(i, clean_text(rng, rng.randint(60, 120)), rng.choice("abbb"))
        labels.append((i, 1, 0))
    for i in range(200, 260):
        add(i, toxic_text(rng, rng.choice(BAD)) + " " + clean_text(rng, 30))
        labels.append((i, 1, 1))
    for i in range(300, 310):
        add(i, " ".join(w + "%%%" for w in clean_text(rng, 80).split()))
    for i in range(400, 440):  # copies and near copies
        base = rows[rng.randrange(100)][1].split()
        if i % 2:
            base[rng.randrange(len(base))] = "changed"
        add(i, " ".join(base))
    for i in range(500, 512):
        add(i, clean_text(rng, 50) + " " + rng.choice(items)[1] + " " + clean_text(rng, 40), "c")
    add(600, None)
    add(601, "")
    add(None, clean_text(rng, 90), None)
    add(602, rows[3][1])
    add(602, rows[3][1])
    docs = spark.createDataFrame(rows, DOCS + ", score string")
    return sf_copy(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                   benchmark=spark.createDataFrame(items, "item_id long, text string"))


def test_stages_equal_plain_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "toxicity":
            want = [(i, t) for i, t in rows if i is None or not 200 <= i < 260]
        elif name == "quality":
            want = [(i, t) for i, t in rows if len(words(t)) >= 50 and "%%%" not in t]
        elif name == "near_duplicates":
            tops, _ = linked_groups([(-1 if i is None else i, t) for i, t in rows], 5, 80)
            want = {(i, t) for i, t in rows if tops[-1 if i is None else i] == (-1 if i is None else i)}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            bad = {d for d, *_ in plain_leaks(rows, items)}
            want = [(i, t) for i, t in rows if i not in bad]
        else:
            break
        docs = out.cache()
        kept[name] = sorted(map(str, ((r.doc_id, r.text) for r in docs.collect())))
        assert kept[name] == sorted(map(str, want)), name
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    mixed = out.collect()
    targets = plain_targets(sizes)
    assert len(mixed) == docs.count()
    for s in sizes:
        assert abs(sum(r.taken for r in mixed if r.source == s) - targets[s]) <= 1


def test_run_applies_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    assert sorted(map(str, out)) == sorted(map(str, docs.collect()))


def test_run_on_empty_documents(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in NAMES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_on_whole_tables(spark, sf, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert compare(spark, connect(sf), query, sql, sf) is None
    else:
        assert query(spark, sf).count() > 0

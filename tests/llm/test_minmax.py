import random

import numpy as np
import pytest
from helpers import documents, linked_groups
from test_jaccard import edited, text, texts  # noqa: F401  (a fixture)

from leadloom.llm import blocks, common, minmax


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, texts, size, percent):  # noqa: F811
    found = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in minmax.near_duplicates(documents(spark, texts), size, percent).collect()}
    tops, sizes = linked_groups(texts, size, percent)
    assert found == {i: (tops[i], sizes[i], tops[i] == i) for i in tops}


def test_large_groups_are_searched_in_slices(spark, texts, monkeypatch):  # noqa: F811
    rng = random.Random(18)
    base = text(rng, 60)
    rows = texts + [(8000 + k, edited(rng, base, rng.randint(0, 3))) for k in range(120)]
    monkeypatch.setattr(blocks, "SLICE", 8)
    monkeypatch.setattr(blocks, "CROWD", 5)
    monkeypatch.setattr(blocks, "FLUSH", 2000)
    found = {r.doc_id: r.component_id for r in minmax.near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert found == linked_groups(rows, 3, 85)[0]


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 2), (None, "a b c d", 3), (None, "z", 4), (2, "A b  c d", 5), (9, "q r s", 6), (9, "u v w", 7), (11, None, 8), (12, " \n", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    found = sorted((str(r.doc_id), str(r.component_id), r.n_shingles, r.kept) for r in minmax.near_duplicates(docs, 3, 85).collect())
    assert found == sorted([("3", "2", 2, False), ("3", "2", 2, False), ("None", "2", 2, False), ("None", "None", 1, True), ("2", "2", 2, True), ("9", "9", 1, True), ("9", "9", 1, True), ("11", "11", 0, True), ("12", "12", 0, True)])
    assert minmax.near_duplicates(docs.where("false"), 3, 85).count() == 0


def test_ends_equal_plain_ones_and_estimate_similarity():
    rng = random.Random(2)
    permutations = common.seeds(400, 40)
    base = [rng.getrandbits(64) for _ in range(5000)]
    a, b = (np.array(sorted(x), np.uint64) for x in (base, base[1000:] + [rng.getrandbits(64) for _ in range(500)]))
    found = minmax.ends(a, permutations)
    for k, p in enumerate(permutations[:5].tolist()):
        there = [x * p % (1 << 64) for x in base]
        assert (int(found[2 * k]), int(found[2 * k + 1])) == (min(there), max(there))
    assert abs(minmax.similarity(found, minmax.ends(b, permutations)) - 4000 / 5500) < 0.06


def test_similar_sets_share_a_band():
    rng = random.Random(3)
    permutations = common.seeds(minmax.bands_for(85) * minmax.ROWS // 2, 40)
    assert (1 - 0.85 ** minmax.ROWS) ** minmax.bands_for(85) <= minmax.MISS
    for n in (1, 2, 6, 7, 20, 100, 600):
        for _ in range(60):
            base = [rng.getrandbits(64) for _ in range(n)]
            other = base[n * 3 // 40:] + [rng.getrandbits(64) for _ in range(n * 3 // 40)]
            assert 100 * len(set(base) & set(other)) >= 85 * len(set(base) | set(other))
            a, b = (set(minmax.bands(minmax.ends(np.array(sorted(x), np.uint64), permutations)).tolist()) for x in (base, other))
            assert a & b

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def whole(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def plain(rows):
    """Integers, covariance and squared deviations by fractions."""
    fit = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if whole(v)]
    n, d = len(fit), len(fit[0][1])
    sums = [sum(x[k] for _, x in fit) for k in range(d)]
    v = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in fit), n ** 3) for j in range(d)] for i in range(d)]
    return fit, n, sums, v


def check(rows, found, most=32):
    fit, n, sums, v = plain(rows)
    d = len(sums)
    matrix = np.array([[float(c) for c in r] for r in v])
    values = np.linalg.eigvalsh(matrix)[::-1][:most]
    trace = float(sum(v[k][k] for k in range(d)))
    assert len(found) == n * min(d, most)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append(r)
    want = {}
    for i, x in fit:
        want.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
    for i, devs in want.items():
        assert sorted(int(r.deviation) for r in by[i] if r.component == 1) == sorted(devs)
        assert {r.n for r in by[i]} == {n}
    for r in found:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-6, abs=1e-12)
    k = len({r.component for r in found if r.whitened is not None})
    first = {}
    for r in found:
        first.setdefault((r.vec_id, r.component), []).append(r.whitened)
    white = np.array([[np.mean(first[i, c + 1]) for c in range(k)] for i, _ in fit])
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    assert max(r.identity_error for r in found) < 1e-9 and len({r.identity_error for r in found}) == 1
    # each component is an eigenvector: the covariance of x with the whitened column is the column's axis times its root
    x = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(xs, sums)] for _, xs in fit])
    axes = x.T @ white / n / np.sqrt(values[:k])
    assert np.abs(np.linalg.norm(axes, axis=0) - 1).max() < 1e-9
    assert np.abs(matrix @ axes - axes * values[:k]).max() < 1e-7 * values[0]


def test_equals_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7)) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 7), (503, [float("inf")] + [0.0] * 6), (3, rows[3][1]), (None, rows[4][1]), (504, [-0.001] * 7), (505, [3e2, -2e2] + [0.0] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("component", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    check(rows, whitening.whiten(docs).collect())
    assert {r.component for r in whitening.whiten(docs, 3).select("component").distinct().collect()} == {1, 2, 3}


def test_floats_and_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    base = np.float32(rng.normal(size=(90, 3)))
    rows = [(i, [float(v[0]), float(v[1]), float(v[2]), float(v[0]), 0.5]) for i, v in enumerate(base)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(docs).collect()
    check(rows, found)
    assert {r.component for r in found if r.whitened is None} == {4, 5}


def test_few_and_odd_rows(spark):
    def of(rows):
        return sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())

    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [])]) == []
    assert of([(1, [2.0, 3.0])]) == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0)]
    assert {r[0] for r in of([(1, [2.0]), (2, [3.0]), (3, [1.0, 2.0]), (4, []), (5, [1e300])])} == {1, 2}


def test_popcounts_equal_products():
    rng = random.Random(3)
    for n in (1, 63, 64, 65, 300):
        bits = [rng.choice([0, 1, 3, 9, 40]) for _ in range(6)]
        x = np.array([[rng.getrandbits(b) if b else 0 for b in bits] for _ in range(n)], np.int64)
        got = whitening.products(x, bits)
        assert all(got[i, j] == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for i in range(6) for j in range(i, 6))


def test_sums_of_any_size(spark):
    for v in (0, 1, -1, 2**31, -2**31, 2**63, -2**70, 12345678901234567890123):
        assert sum(p << 32 * i for i, p in enumerate(whitening._limbs(v))) == v
    rows = [(1, [2.0**40, 1.0]), (2, [-2.0**40, 3.0]), (3, [2.0**39, -2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    fit, n, sums, _ = plain(rows)
    assert {r.vec_id: int(r.deviation) for r in found} == {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in fit}
    far = whitening.whiten(spark.createDataFrame([(1, [2.0**55]), (2, [-2.0**55])] + [(i, [0.0]) for i in range(3, 7)], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in far} == {1: None, 2: None, 3: 0, 4: 0, 5: 0, 6: 0}

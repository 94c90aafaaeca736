"""Embedding whitening: exact cross-products from bit-sliced columns, then principal components of variance one.

An entry ``c`` counts as the integer ``x = floor(SCALE * c) + SHIFT``. Three passes over the vectors, each one
``mapInArrow`` without a shuffle of vectors:

1. *Ranges.* Per dimension the sum, the least and the largest ``x``; with the least, the values of a dimension
   are small numbers from 0 of as many bits as its range needs.
2. *Bit-sliced scatter.* A task holds ``BLOCK`` rows at a time and turns them into bit planes: for every bit of every
   dimension one row of 64-bit words, a bit a vector. The products of two dimensions, summed over the rows, are the
   popcounts of their planes' conjunctions, weighted by the bits' powers of two: integers, without rounding.
   Sums of tasks are added up in Spark, in limbs of 32 bits, so they are exact at every size.
3. *Projection.* The scatter is centred in integers (``n * P - s * s'``), divided once by ``n * n``, and given to
   ``eigh``; every vector is centred in integers as well, projected and divided by the root of the eigenvalue.

Only sums come to the driver, three a dimension and one a pair of dimensions; what is sent to the tasks is one
matrix of ``dimensions * components`` numbers.

Defined results: the dimension of the table is the length that most vectors have (of equally many, the greater).
No rows come from vectors that are null, hold a null, NaN or infinite entry or one beyond ``LARGEST`` (no long holds
its ``x``), or are of another length, empty ones included. Null ids are kept, repeated rows count as often as they
occur and each have their rows. A component whose eigenvalue is not above rounding (``dimension * eps`` of the
largest; all of them if the vectors are equal) cannot be scaled: its ``whitened`` is null and it takes no part in
``identity_error``. A ``deviation`` of more than 38 digits is null. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 55   # of an entry: 64 times it, shifted, is a long
BLOCK = 1 << 15       # vectors whose bits are counted at a time
LIMB = 32
COMPONENTS = 32
MOST = 10 ** 38      # a deviation beyond it fits in no decimal of Spark


# ------------------------------------------------------------------ reading vectors
def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``width`` whole entries, and their integers, one row a vector."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    at = np.flatnonzero(lengths == width)
    if not len(at) or not width:
        return at[:0], np.zeros((0, width), np.int64)
    flat = column.take(pa.array(at)).flatten()
    values = flat.to_numpy(zero_copy_only=False).reshape(len(at), width)  # a null entry is read as NaN
    whole = (np.isfinite(values) & (np.abs(values) <= LARGEST)).all(axis=1)
    return at[whole], np.floor(SCALE * values[whole]).astype(np.int64) + SHIFT


def _limbs(value: int) -> list[int]:
    """A sum in limbs, the last of them signed."""
    out = []
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(cells: dict[tuple, int], names: list[str]) -> pa.RecordBatch:
    rows = [(*key, i, part) for key, value in cells.items() for i, part in enumerate(_limbs(value))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def _added(sums: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Exact totals of limbs by key."""
    out: dict[tuple, int] = {}
    for r in sums.groupBy(*keys, "limb").agg(F.sum("part").alias("part")).collect():
        key = tuple(r[k] for k in keys)
        out[key] = out.get(key, 0) + (r["part"] << LIMB * r["limb"])
    return out


# ------------------------------------------------------------------ first pass: ranges
def _ranges(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(width, object), None, None
        for batch in batches:
            x = integers(batch.column(0), width)[1]
            if len(x):
                n += len(x)
                total += ((x >> LIMB).sum(axis=0).astype(object) << LIMB) + (x & ((1 << LIMB) - 1)).sum(axis=0).astype(object)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            rows = [(i, limb, part, n, int(low[i]), int(high[i])) for i in range(width) for limb, part in enumerate(_limbs(int(total[i])))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["i", "limb", "part", "n", "low", "high"])
    return run


class Ranges:
    """Rows, sums, least and largest integers of the dimensions."""

    def __init__(self, vectors: DataFrame, width: int):
        found = vectors.mapInArrow(_ranges(width), "i long, limb long, part long, n long, low long, high long") if width else None
        rows = found.groupBy("i", "limb").agg(F.sum("part").alias("part"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect() if width else []
        self.width, self.sums = width, [0] * width
        self.low, self.high = np.zeros(width, np.int64), np.zeros(width, np.int64)
        self.n = 0
        for r in rows:
            self.sums[r["i"]] += r["part"] << LIMB * r["limb"]
            if r["limb"] == 0:  # every task has a row of the lowest limb
                self.n, self.low[r["i"]], self.high[r["i"]] = r["n"], r["low"], r["high"]
        self.bits = [int(b - a).bit_length() for a, b in zip(self.low.tolist(), self.high.tolist())]


# ------------------------------------------------------------------ second pass: scatter
def planes(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of columns of small numbers: a row a bit, lowest first, dimension after dimension, in 64-bit words."""
    words = -(-len(x) // 64)
    out = np.zeros((sum(bits), words * 8), np.uint8)
    at = 0
    for i, n in enumerate(bits):
        column = x[:, i]
        for k in range(n):
            packed = np.packbits((column >> k & 1).astype(bool))
            out[at, :len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def products(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sum of products of every two dimensions (upper triangle), from popcounts of their planes."""
    sliced, wide = planes(x, bits), [i for i, n in enumerate(bits) if n]
    starts = np.cumsum([0, *bits])
    weight = np.array([1 << k for n in bits for k in range(n)], object)
    out = np.zeros((len(bits), len(bits)), object)
    for i in wide:
        later = [j for j in wide if j >= i]
        first = starts[i]
        for k in range(bits[i]):
            ones = np.bitwise_count(sliced[first:] & sliced[first + k]).sum(axis=1, dtype=np.int64).astype(object)
            out[i, later] += np.add.reduceat(ones * weight[first:], [starts[j] - first for j in later]) << k
    return out


def _scatter(width: int, low: np.ndarray, bits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, rows = np.zeros((width, width), object), [], 0
        for batch in batches:
            x = integers(batch.column(0), width)[1] - low
            held.append(x)
            rows += len(x)
            if rows >= BLOCK:
                total += products(np.concatenate(held), bits)
                held, rows = [], 0
        if rows:
            total += products(np.concatenate(held), bits)
        yield _sums({(i, j): int(total[i, j]) for i in range(width) for j in range(i, width) if total[i, j]}, ["i", "j", "limb", "part"])
    return run


def covariance(vectors: DataFrame, ranges: Ranges) -> np.ndarray:
    """Covariance of the integers, divisor ``n``: exact until its one division."""
    width, n = ranges.width, ranges.n
    found = _added(vectors.mapInArrow(_scatter(width, ranges.low, ranges.bits), "i long, j long, limb long, part long"), ["i", "j"])
    sums = [s - n * int(a) for s, a in zip(ranges.sums, ranges.low)]
    out = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = (n * found.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    return out


# ------------------------------------------------------------------ third pass: projection
class Components:
    """Principal components of a covariance, by falling eigenvalue."""

    def __init__(self, matrix: np.ndarray, most: int):
        values, vectors = np.linalg.eigh(matrix) if len(matrix) else (np.zeros(0), np.zeros((0, 0)))
        most = min(most, len(values))
        self.values, self.vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        trace = float(np.trace(matrix)) if len(matrix) else 0.0
        self.explained = np.maximum(self.values, 0) / trace if trace > 0 else np.zeros(most)
        top = float(values[-1]) if len(values) else 0.0
        self.scaled = self.values > max(len(values) * np.finfo(float).eps * top, 0.0)
        root = np.sqrt(np.where(self.scaled, self.values, 1.0))
        self.matrix = self.vectors / root
        exact = np.longdouble
        white = (self.matrix.astype(exact).T @ matrix.astype(exact) @ self.matrix.astype(exact))[np.ix_(self.scaled, self.scaled)]
        self.error = float(np.abs(white - np.eye(len(white))).max()) if len(white) else 0.0


def _deviations(x: np.ndarray, n: int, sums: list[int], spread: int) -> np.ndarray:
    """``n * x - sum`` of every entry: longs where these and the sum of their squares fit, else whole numbers of any size."""
    if x.shape[1] * (n * spread) ** 2 < 1 << 63:
        low = x - np.array([s // n for s in sums], np.int64)   # n * x - s = n * (x - s div n) - s mod n
        return n * low - np.array([s % n for s in sums], np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _project(ranges: Ranges, found: Components):
    n, sums, width, count = ranges.n, ranges.sums, ranges.width, len(found.values)
    spread = max((int(b) - int(a) for a, b in zip(ranges.low, ranges.high)), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                at, x = integers(part.column(0), width)
                if not len(at):
                    continue
                apart = _deviations(x, n, sums, spread)
                square = (apart * apart).sum(axis=1)
                white = (apart / n).astype(float) @ found.matrix
                ids = part.column(1).take(pa.array(np.repeat(at, count)))
                deviation = pa.array([Decimal(v) if v < MOST else None for v in map(int, square.tolist())], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), count)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))), deviation,
                    pa.array(white.ravel(), mask=np.tile(~found.scaled, len(at))), pa.array(np.tile(found.explained, len(at)))],
                    ["vec_id", "component", "deviation", "whitened", "explained"])
    return run


def _width(vectors: DataFrame, name: str) -> int:
    """The length that most vectors have."""
    sizes = vectors.where(F.col(name).isNotNull()).groupBy(F.size(name).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).limit(1).collect()
    return top[0]["size"] if top else 0


def whiten(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every whole vector and each of the
    first ``components`` components. ``deviation`` (decimal, exact): sum of ``(n * x - sum)`` squared."""
    rows = table.select(F.col(vector).alias("vector"), F.col(key).cast("long").alias("vec_id"))
    ranges = Ranges(rows.select("vector"), _width(rows, "vector"))
    found = Components(covariance(rows.select("vector"), ranges) if ranges.n else np.zeros((0, 0)), components)
    out = rows.mapInArrow(_project(ranges, found), "vec_id long, component int, deviation decimal(38,0), whitened double, explained double")
    return out.select("vec_id", "component", F.lit(ranges.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(found.error).alias("identity_error"))

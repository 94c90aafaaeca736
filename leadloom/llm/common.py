"""What the training-data operators share: words and shingles of whole texts as 64-bit numbers.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are read from the buffers of an Arrow column, a slice of a
batch at a time, so the memory of a task depends on ``CHUNK_BYTES`` and on its longest text only.

Words and shingles are compared by 64-bit numbers. For two texts of a thousand words the chance that
different shingles meet in one number is below 1e-12.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut, drop_cut, shared_path  # noqa: F401  (used by the operators)

CHUNK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a public finalizer: xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_LETTER = seeds(256, 11)
_STEP = int(seeds(1, 12)[0])
_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = seeds(16, 13)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; a null is an empty text."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = buffers(batch.column(batch.schema.get_field_index(text)))[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Words of the texts of a column: byte ranges, rows, and 64-bit numbers."""

    def __init__(self, texts: pa.Array, fold: bool = True, skip: np.ndarray | None = None):
        """``fold``: A-Z equal a-z. ``skip``: bytes (a table of 256) that part words besides white space."""
        self.raw, self.at = buffers(texts)
        n = len(self.raw)
        inside = ~(WHITE if skip is None else WHITE | skip)[self.raw]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[self.at[:-1][self.at[:-1] < n]] = False
            after[self.at[1:][self.at[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.at)  # words of row i: bounds[i] to bounds[i + 1]
        self.fold = fold

    def numbers(self) -> np.ndarray:
        n = len(self.raw)
        ahead, back = _power(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTER[(LOWER if self.fold else SAME)[self.raw]] * ahead[:n], out=sums[1:], dtype=np.uint64)
            return mix((sums[self.ends] - sums[self.starts]) * back[self.starts])

    def text(self, i: int) -> bytes:
        raw = self.raw[self.starts[i]:self.ends[i]]
        return (LOWER[raw] if self.fold else raw).tobytes()


def windows(numbers: np.ndarray, size: int) -> np.ndarray:
    """64-bit number of each run of ``size`` words, by its first word."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total += numbers[i:i + n] * _PLACE[i]
        return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct shingles; a text of fewer words is one shingle, without words none."""
    words = Words(texts)
    numbers = words.numbers()
    every = windows(numbers, size)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a:b - size + 1]))
        else:
            out.append(windows(numbers[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns, so that no name clashes with an operator's own, and the number of each name."""
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*place.values()), place


def renamed(docs: DataFrame, place: dict[str, str]) -> DataFrame:
    """The columns that ``numbered`` has numbered, under their names."""
    return docs.select(*[F.col(now).alias(name) for name, now in place.items()])


def crc_rest(key: str | Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key.cast("string").cast("binary")) % n


def let_go(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that Spark deletes the files of shuffles that nothing refers to any more.

    It does so by itself once the driver happens to collect; a long job with several large shuffles would
    hold the files of all of them until then. Drop the references first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def send(spark: SparkSession, value):
    """Give a value of bounded size to all tasks once per executor."""
    return spark.sparkContext.broadcast(value)

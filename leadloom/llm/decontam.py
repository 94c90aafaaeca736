"""Benchmark decontamination: short test items found inside long documents by containment.

Items are sets of word shingles (``SIZE`` words, letters folded). An item is in a document when at least
``percent`` of its shingles are. MinHash alone cannot compare a set of 30 with one of 20,000, so items are
partitioned by size: for the class of items of up to ``u`` shingles a document is read in windows of
``2 * u`` shingles every ``u``, so a passage lies whole in one window of nearly its own size, and
its MinHash values meet those of the item. ``HASHES`` values a window, one shared value is a candidate: at
containment 0.8 a pair is missed with a chance below 1e-5, in one window; then exact containment decides.

A window's values are tested against a Bloom filter of the items' values. It has ``SPARSE`` bits a value and ``2 ** BITS``
(32 MB) at most, so it may be sent to all tasks: full, it only lets more values pass. Values that pass are joined
with the items' (both plain rows; Spark picks the join), which gives candidate pairs; the shingles, as text, of
a document are only compared with those of its candidates, so a shingle that many documents and many items have
costs nothing. The documents are read once and never shuffled.

Defined results: null or empty items and documents match nothing. An item of fewer words than ``SIZE`` is
one shingle, of all its words, and is looked for as such. Rows equal in id and text, of documents or of
items, count as one; rows equal in id only stay apart. Null ids are kept as null. Other columns are ignored. Without items, or without documents, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.common import cut, signed

SIZE = 5
PERCENT = 80
HASHES = 64
BITS = 28       # places of a filter at most: their number as a power of two
SPARSE = 64     # places for each value, while there is room
TURNS = 4       # places of a value
#: Bytes that are no part of a word: white space and ASCII punctuation.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def _size_class(n: np.ndarray | int):
    """Class of an item: the exponent of the least power of two that holds its shingles."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _hashes(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` 32-bit values of every shingle, one row a hash function."""
    with np.errstate(over="ignore"):
        return ((shingles[None, :] * common.seeds(HASHES, 31)[:, None]) >> np.uint64(32)).astype(np.uint32)


def _keys(values: np.ndarray, level: int, length: int) -> np.ndarray:
    """Join keys of MinHash values: hash function, size class and words a shingle mixed in."""
    with np.errstate(over="ignore"):
        slots = np.arange(HASHES, dtype=np.uint64)[:, None] + np.uint64(HASHES * (level + 64 * length))
        return common.mix(values.astype(np.uint64) + (slots << np.uint64(32)))


def _texts(words: common.Words, starts: np.ndarray, length: int) -> list[str]:
    return [b" ".join(words.text(i + j) for j in range(length)).decode("utf-8", "replace") for i in starts.tolist()]


def _items(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            words = common.Words(batch.column(1), skip=BREAKS)
            numbers = words.numbers()
            rows = []
            for item, name, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                length = min(size, b - a)
                if not length:
                    continue
                shingles, first = np.unique(common.windows(numbers[a:b], length), return_index=True)
                level = int(_size_class(len(shingles)))
                values = _keys(_hashes(shingles).min(axis=1)[:, None], level, length)[:, 0]
                rows.append((item, name, length, level, len(shingles), signed(values).tolist(), _texts(words, first + a, length)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "item_id", "length", "level", "n_shingles", "keys", "shingles"])
    return run


def item_sets(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item; ``item`` numbers id and text, so that items with one id, or none, stay apart."""
    rows = items.select(F.xxhash64(key, text).alias("item"), F.col(text).alias("text"), F.col(key).cast("long").alias("item_id")).dropDuplicates(["item"])
    return rows.mapInArrow(_items(size), "item long, item_id long, length int, level int, n_shingles long, keys array<long>, shingles array<string>")


def _place(values: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """One of the places of 64-bit values in a filter of ``2 ** bits``; the values are scrambled as they come."""
    with np.errstate(over="ignore"):
        return (common.mix(values + np.uint64(turn)) if turn else values) & np.uint64((1 << bits) - 1)


def _bloom(values: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Bit table of 64-bit values and its size as a power of two: what comes to the driver are the table's own bytes."""
    n = values.count()
    bits = min(most, max(16, (SPARSE * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            places = np.unique(np.concatenate([_place(found, turn, bits) for turn in range(TURNS)]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(places))], ["p"])

    place = F.col("p") + 1
    parts = values.mapInArrow(run, "p long").groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(1 << max(bits - 3, 12), np.uint8)
    for r in parts.toLocalIterator():  # 4 KB a row
        cell = np.frombuffer(r["bits"], np.uint8)
        at = (r["part"] - 1) * len(cell)
        table[at:at + len(cell)] = cell
    return table, bits


def _holds(sent: tuple[np.ndarray, int], values: np.ndarray) -> np.ndarray:
    """Which values may be in the table: each place is only looked up for those that had the ones before."""
    (table, bits), flat = sent, np.ravel(values)
    left = np.arange(len(flat))
    for turn in range(TURNS):
        place = _place(flat[left], turn, bits)
        left = left[table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
    out = np.zeros(len(flat), bool)
    out[left] = True
    return out.reshape(np.shape(values))


def _scan(kinds: list[tuple[int, int]], sent):
    """Documents -> those with a value that passed: the values, and the shingles that may be an item's."""
    lengths = sorted({length for length, _ in kinds})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_table, shingles_table = sent.value
        for batch in common.chunks(batches, "text", 1 << 18):
            words = common.Words(batch.column(1), skip=BREAKS)
            numbers, bounds = words.numbers(), words.bounds
            n = batch.num_rows
            hits: list[list[np.ndarray]] = [[] for _ in range(n)]
            for length in lengths:
                shingles = common.windows(numbers, length)
                if not len(shingles):
                    continue
                hashes = _hashes(np.append(shingles, np.uint64(0)))
                hashes[:, -1] = np.iinfo(np.uint32).max
                last = np.maximum(bounds[:-1], bounds[1:] - length + 1)      # one past a document's last shingle
                for level in (lv for ln, lv in kinds if ln == length):
                    step = 1 << level
                    counts = -(-(last - bounds[:-1]) // step)
                    owner = np.repeat(np.arange(n), counts)
                    if not len(owner):
                        continue
                    starts = bounds[:-1][owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
                    ends = np.minimum(starts + step, last[owner])
                    # the least values of blocks of ``step`` shingles; every second run lies between documents
                    cuts = np.stack([starts, ends], axis=1).ravel()
                    low = np.minimum.reduceat(hashes, cuts, axis=1)[:, ::2]
                    pair = np.minimum(low[:, :-1], low[:, 1:])
                    same = owner[:-1] == owner[1:]
                    low[:, :-1][:, same] = pair[:, same]
                    keys = _keys(low, level, length)
                    slot, at = np.nonzero(_holds(values_table, keys))
                    for who in np.unique(owner[at]).tolist():
                        hits[who].append(np.unique(keys[slot, at][owner[at] == who]))
            rows = []
            for i in range(n):
                if not hits[i]:
                    continue
                a, b = int(bounds[i]), int(bounds[i + 1])
                found = set()
                for length in lengths:
                    own = common.windows(numbers[a:b], length)
                    # a document's shingles are looked up by number; the numbers of the items' are in the table
                    found.update(_texts(words, a + np.flatnonzero(_holds(shingles_table, own)), length))
                rows.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), signed(np.unique(np.concatenate(hits[i]))).tolist(), sorted(found)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], ["doc_id", "row", "keys", "shingles"])
    return run


def _numbers(size: int):
    """Shingle texts -> their 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(common.shingle_sets(batch.column(0), size))))], ["v"])
    return run


def find(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SIZE, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_common, n_item, containment`` of each item contained in each document, and ``row``,
    a number of id and text that tells repeated ids apart."""
    known = cut(item_sets(items, size))
    kinds = sorted((r["length"], r["level"]) for r in known.select("length", "level").distinct().collect())  # at most size * 64 rows
    values = known.select(F.explode("keys").alias("v"))
    texts = known.select(F.explode("shingles").alias("text")).distinct()
    sent = common.send(docs.sparkSession, (_bloom(values, bits), _bloom(texts.mapInArrow(_numbers(size), "v long"), bits)))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(key, text).alias("row"))
    scanned = cut(rows.mapInArrow(_scan(kinds, sent), "doc_id long, row long, keys array<long>, shingles array<string>"))
    ask = scanned.select("row", F.explode("keys").alias("v")).join(known.select("item", F.explode("keys").alias("v")), "v")
    candidates = cut(ask.select("row", "item").distinct())
    lists = scanned.select("doc_id", "row", F.explode("shingles").alias("shingle")).distinct()
    mine = known.select("item", "item_id", "n_shingles", F.explode("shingles").alias("shingle"))
    common_ = lists.join(candidates, "row").join(mine, ["item", "shingle"])
    counted = common_.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_common"), F.first("n_shingles").alias("n_item"))
    verified = counted.where(100 * F.col("n_common") >= percent * F.col("n_item"))
    return verified.select("doc_id", "item_id", "n_common", "n_item", (F.col("n_common") / F.col("n_item")).alias("containment"), "row")


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no test item."""
    found = find(docs, items, key=key, text=text, **options).select("row").distinct()
    rows, place = common.numbered(docs)
    return common.renamed(rows.withColumn("row", F.xxhash64(place[key], place[text])).join(found, "row", "left_anti"), place)

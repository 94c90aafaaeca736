"""Cross-entropy difference: how much more a text is like the target corpus than like the background.

Two word-bigram models of the same order, smoothing and vocabulary are learned, one from the target texts
and one from all texts. A text's score is the mean over its words of target loss minus background loss
(bits): the lower, the more like the target.

The vocabulary is every word of the target (or, with ``size``, the most frequent ones, ties by word), and one
unknown word. Words and bigrams are 64-bit numbers. Texts are kept in chunks of about ``FLUSH`` words, each
with a dictionary of its own. The distinct words of a chunk are sent, packed by ranges of their numbers, to be summed
over all chunks, and their sums are sent back; then its distinct bigrams likewise. Only the totals of 512 ranges
come to the driver and no table is broadcast: what is gathered follows the corpus, memory follows the chunk and the
range.

P(word | before) = (count(before, word) + STRENGTH * P(word)) / (count(before) + STRENGTH), and P(word) is
smoothed likewise with an even distribution over the vocabulary.

Defined results: a null text, or one without words, has no words and a null score. Texts equal in words have
equal scores. Without target texts both models are even there and only the background counts. Null ids are
kept, repeated rows count as often as they occur. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.common import cut, drop_cut

STRENGTH = 50.0
FLUSH = 1 << 20
START, UNKNOWN = 0, 1  # numbers before those of the vocabulary
WORD_BITS, PAIR_BITS = 9, 12  # words are summed in 512 ranges of their numbers, bigrams in 4096
SUMS = ("target", "background", "target_before", "background_before")
ENCODED = "chunk long, docs array<long>, target binary, lengths binary, ids binary, words binary"
CODED = ENCODED + ", target_n binary, background_n binary, target_base binary, background_base binary"
SCORED = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _word_lists(texts: pa.Array) -> Iterator[list[bytes]]:
    for raw in texts.cast(pa.binary()):
        yield raw.as_py().translate(_FOLD).split() if raw.is_valid else []


_FOLD = bytes(common.LOWER)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    seen = 0
    for batch in common.chunks(batches, "text"):
        for words in _word_lists(batch.column(0)):
            held.update(words)
            seen += len(words)
        if seen >= FLUSH:
            yield out(held)
            held, seen = Counter(), 0
    if held:
        yield out(held)


def vocabulary_of(texts: DataFrame, size: int) -> list[str]:
    """The most frequent words, ties by word."""
    counted = texts.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.col("n").desc(), "word").limit(size).collect()]


def _bytes(x: np.ndarray) -> pa.Array:
    """One cell of packed numbers: their first bytes, then their second ones and so on, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return pa.array([len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)], pa.binary())


def _read(row, name: str, kind) -> np.ndarray:
    raw = row.column(name)[0].as_py()
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts: distinct words as sorted numbers, and all words as places among them."""
    base, held, seen, n = TaskContext.get().partitionId() << 32, [], 0, 0

    def out() -> pa.RecordBatch:
        words, ids = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        docs = pa.concat_arrays([h[3] for h in held])
        return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), _bytes(np.concatenate([h[2] for h in held])),
                                           _bytes(np.concatenate([h[1] for h in held])), _bytes(ids.astype(np.int32)), _bytes(words)], ["chunk", "docs", "target", "lengths", "ids", "words"])

    for batch in common.chunks(batches, "text"):
        words = common.Words(batch.column(0))
        held.append((words.numbers(), np.diff(words.bounds).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), batch.column(1)))
        seen += len(words.starts)
        if seen >= FLUSH:
            yield out()
            held, seen, n = [], 0, n + 1
    if held:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _packed(x: np.ndarray, at: np.ndarray) -> pa.Array:
    width = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _steps(keys: np.ndarray, at: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Sorted numbers by ranges as steps from one to the next: six bytes each, and two that are nearly always zero."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[at[:-1]] = keys[at[:-1]] - starts
    raw = steps.view(np.uint8).reshape(-1, 8)
    return [_packed(np.ascontiguousarray(raw[:, a:b]), at) for a, b in ((0, 6), (6, 8))]


def _stepped(low: bytes, high: bytes, start: int) -> np.ndarray:
    raw = np.empty((len(high) // 2, 8), np.uint8)
    raw[:, :6], raw[:, 6:] = np.frombuffer(low, np.uint8).reshape(-1, 6), np.frombuffer(high, np.uint8).reshape(-1, 2)
    return np.cumsum(raw.view(np.uint64)[:, 0], dtype=np.uint64) + np.uint64(start)


def _halves(counts: list[np.ndarray], at: np.ndarray) -> list[pa.Array]:
    """Counts by ranges as their low bytes and the rest, which is mostly zeros and so takes no room once compressed."""
    return [a for x in counts for a in (_packed((x & 255).astype(np.uint8), at), _packed((x >> 8).astype(np.int64), at))]


def _whole(low: list[bytes], high: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(low), np.uint8) + (np.frombuffer(b"".join(high), np.int64) << 8)


def _names(n: int) -> list[str]:
    return [x for c in SUMS[:n] for x in (c, f"{c}_high")]


def _send(row, keys: np.ndarray, counts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Sorted numbers of a chunk and their counts, a row for each range of numbers."""
    ranges, at = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    at = np.append(at, len(keys))
    chunk = np.full(len(ranges), row.column("chunk")[0].as_py(), np.int64)
    cells = [*_steps(keys, at, ranges << np.uint64(64 - bits)), *_halves([x.astype(np.int64) for x in counts], at)]
    return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(chunk), *cells], ["range", "chunk", "keys", "keys_high", *_names(len(counts))])


def _sum(bits: int, totals=None):
    """Rows of one range after another -> for each chunk the sums of its numbers over all chunks; ``totals`` gives a range's
    totals from its numbers and sums, in a row of no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        for key, rows in groupby(cells, lambda x: x[0]):
            rows = list(rows)
            parts = [_stepped(r[2], r[3], key << (64 - bits)) for r in rows]
            found, place = np.unique(np.concatenate(parts), return_inverse=True)
            at = np.cumsum([0] + [len(p) for p in parts])
            sums = [np.bincount(place, _whole([r[i] for r in rows], [r[i + 1] for r in rows]), len(found)).astype(np.int64) for i in range(4, len(rows[0]), 2)]
            names = ["chunk", "range", *_names(len(sums))]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([key] * len(rows), pa.int32()), *_halves([x[place] for x in sums], at)], names)
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([key], pa.int32()), *[a for x in totals(found, sums) for a in _halves([x], np.array([0, len(x)]))]], names)

    return run


def _summed(sent: DataFrame, n: int, bits: int, totals=None) -> DataFrame:
    # counts are mostly small: bytes of little variety, which only an entropy coder makes smaller
    return cut(sent.repartition("range").sortWithinPartitions("range").mapInArrow(_sum(bits, totals), "chunk long, range int, " + _binaries(n)), "zstd")


def _sending(n: int) -> str:
    return "range int, chunk long, keys binary, keys_high binary, " + _binaries(n)


def _binaries(n: int) -> str:
    return ", ".join(f"{c} binary" for c in _names(n))


def _joined(right: pa.Table, n: int) -> list[np.ndarray]:
    """The sums of a chunk's numbers, in their order."""
    right = right.sort_by("range")
    return [_whole(right.column(c).to_pylist(), right.column(f"{c}_high").to_pylist()) for c in SUMS[:n]]


def _send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each chunk with how often they occur, and how often before another word; START too, before all others."""
    for row in _rows(batches):
        words, ids, lengths, target = _read(row, "words", np.uint64), _read(row, "ids", np.int32), _read(row, "lengths", np.int64), _read(row, "target", np.uint8)
        full = lengths > 0
        last, of_last = ids[(np.cumsum(lengths) - 1)[full]], target[full]
        n, n_target = np.bincount(ids, minlength=len(words)), np.bincount(ids, np.repeat(target, lengths), len(words))
        before, before_target = n - np.bincount(last, minlength=len(words)), n_target - np.bincount(last, of_last, len(words))
        counts = [np.append(x, y) for x, y in ((0, n_target), (0, n), (int(of_last.sum()), before_target), (len(last), before))]
        yield _send(row, np.append(np.uint64(START), words), counts, WORD_BITS)


def _known(numbers: np.ndarray, target: np.ndarray, top: np.ndarray | None) -> np.ndarray:
    """Which words are in the vocabulary."""
    return target > 0 if top is None else np.isin(numbers, top)


def _totals(top: np.ndarray | None):
    """Of a range, for each of ``SUMS``: of START, of unknown words, of all, and how many words are known."""

    def run(numbers: np.ndarray, sums: list[np.ndarray]) -> list[np.ndarray]:
        own, known = numbers == START, _known(numbers, sums[0], top)
        return [np.array([x[own].sum(), x[~own & ~known].sum(), x.sum(), known.sum()], np.int64) for x in sums]

    return run


def _before(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each one, START at the beginning of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return out


def _by_doc(bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths), bits, len(lengths))


def _code(unknown: list[int], top: np.ndarray | None):
    """A chunk and the sums of its words -> the chunk over words of the vocabulary, and per text the bits of the words before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, ids, lengths = _read(left, "words", np.uint64), _read(left, "ids", np.int32), _read(left, "lengths", np.int64)
        found = _joined(right, 4)
        known = _known(words, found[0][1:], top)
        place = np.full(len(words), UNKNOWN, np.int32)
        place[known] = np.arange(known.sum(), dtype=np.int32) + 2
        ids = place[ids]
        sums = [np.concatenate([[x[0], n], x[1:][known]]) for x, n in zip(found, unknown)]
        before = _before(ids, lengths)
        bases = [_by_doc(np.log2(x + STRENGTH)[before], lengths) for x in sums[2:]]
        numbers = np.concatenate([np.array([START, UNKNOWN], np.uint64), words[known]])
        cells = [left.column(c).combine_chunks() for c in ("chunk", "docs", "target", "lengths")]
        return pa.Table.from_arrays(cells + [_bytes(x) for x in (ids, numbers, *sums[:2], *bases)], [x.split()[0] for x in CODED.split(", ")])

    return run


_PAIR = common.seeds(2, 14)


def _pairs(row) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams of a chunk as sorted numbers, and the place of each word's bigram among them."""
    ids, words = _read(row, "ids", np.int32), _read(row, "words", np.uint64)
    with np.errstate(over="ignore"):
        keys = common.mix(common.mix(words * _PAIR[0])[_before(ids, _read(row, "lengths", np.int64))] + (words * _PAIR[1])[ids])
    return np.unique(keys, return_inverse=True)


def _send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        keys, place = _pairs(row)
        target = np.bincount(place, np.repeat(_read(row, "target", np.uint8), _read(row, "lengths", np.int64)), len(keys))
        yield _send(row, keys, [target, np.bincount(place, minlength=len(keys))], PAIR_BITS)


def _score(totals: list[int], even: float):
    """A chunk and the sums of its bigrams -> its texts with their losses."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, ids = _read(left, "lengths", np.int64), _read(left, "ids", np.int32)
        place = _pairs(left)[1]
        n = np.maximum(lengths, 1)
        found = []
        for name, total, counts in zip(SUMS, totals, _joined(right, 2)):
            word = (_read(left, f"{name}_n", np.int64) + STRENGTH * even) / (total + STRENGTH)
            found.append((_read(left, f"{name}_base", np.float64) - _by_doc(np.log2(counts[place] + STRENGTH * word[ids]), lengths)) / n)
        empty = lengths == 0
        return pa.Table.from_arrays([left.column("docs")[0].values, pa.array(lengths)] + [pa.array(x, mask=empty) for x in (*found, found[0] - found[1])], [x.split()[0] for x in SCORED.split(", ")])

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, size: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` (bits a word) of every row of ``docs``; the target are
    those whose key is in ``target_ids`` (one column). ``size``: only so many words of the target, None: all."""
    spark = docs.sparkSession
    name = target_ids.columns[0]
    ids = target_ids.select(F.col(name).cast("long").alias("at")).where(F.col("at").isNotNull()).distinct().select("at", F.lit(False).alias("blank"), F.lit(True).alias("_in"))
    # always a shuffle, never a broadcast of the ids: the target grows with the corpus; rows without an id are spread by their text
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.xxhash64("text")), "blank": F.col("doc_id").isNull()})
    marked = rows.join(ids.hint("merge"), ["at", "blank"], "left")
    texts = marked.select("text", "doc_id", F.coalesce("_in", F.lit(False)).alias("target"))
    encoded = cut(texts.mapInArrow(_encode, ENCODED))
    top = None if size is None else common.Words(pa.array(vocabulary_of(texts.where("target"), size), pa.string())).numbers()
    del marked, texts
    common.let_go(spark)  # the shuffled texts
    words = _summed(encoded.select("chunk", "target", "lengths", "ids", "words").mapInArrow(_send_words, _sending(4)), 4, WORD_BITS, _totals(top))
    common.let_go(spark)
    # a row for each range of words
    sums = np.array([[_whole([r[c]], [r[f"{c}_high"]]) for c in SUMS] for r in words.where("chunk is null").collect()]).reshape(-1, 4, 4).sum(axis=0)
    coded = cut(encoded.groupBy("chunk").cogroup(words.where("chunk is not null").groupBy("chunk")).applyInArrow(_code(sums[:, 1].tolist(), top), CODED))
    drop_cut(encoded, words)
    common.let_go(spark)
    pairs = _summed(coded.select("chunk", "target", "lengths", "ids", "words").mapInArrow(_send_pairs, _sending(2)), 2, PAIR_BITS)
    common.let_go(spark)  # the packed bigrams
    return coded.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_score(sums[:2, 2].tolist(), 1.0 / (int(sums[0, 3]) + 1)), SCORED)

"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams of a bounded sample of labelled texts (``sample_per_label`` texts a label,
chosen by a hash of the key) with a map-side combined aggregation; the model is one matrix of log
probabilities, labels x ``BUCKETS``, so its size is bounded by the number of labels. It is broadcast, and
batches of whole texts are scored as a sparse matrix (row, bucket, count) against it in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With nothing to learn
from, every text is ``und``. Ties go to the label first in order. Null keys are never learned from.
Repeated rows are judged alike. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.3
UNKNOWN = "und"
LETTER = r"\p{L}"


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the row of each. Runs of other characters count as one blank."""
    clean = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\p{L}]+", " "))
    clean = pc.binary_join_element_wise(" ", clean, " ", "")
    lengths = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(clean.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = common.seeds(len(ORDERS) * max(ORDERS), 21).reshape(len(ORDERS), -1)
    buckets, owners = [], []
    for k, order in enumerate(ORDERS):
        n = len(points) - order + 1
        if n <= 0:
            continue
        total = np.full(n, order, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(order):
                total += points[i:i + n] * place[k, i]
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = rows[:n] == rows[order - 1:]
        buckets.append((total >> np.uint64(50)).astype(np.int64)[whole])
        owners.append(rows[:n][whole])
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int32)


def _learn_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in common.chunks(batches, "text"):
        buckets, owners = _grams(batch.column(0))
        labels = np.array(batch.column(1).to_pylist(), object)
        for label in set(labels.tolist()):
            got = np.bincount(buckets[(labels == label)[owners]], minlength=BUCKETS)
            held[label] = held.get(label, 0) + got
    for label, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "bucket", "n"])


def _threshold(wanted: int, size: int) -> int:
    """Largest 64-bit hash of a text that is drawn, so that about ``wanted`` of ``size`` are, whatever the size."""
    return (1 << 63) - 1 if wanted >= size else (wanted << 64) // size - (1 << 63)


def learn(labelled: DataFrame, sample_per_label: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Labels and log probabilities (labels x ``BUCKETS`` + 1, the last column the prior) from ``key``, ``text``, ``label``."""
    rows = labelled.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    if not sizes:
        return [], np.zeros((0, BUCKETS + 1))
    labels = sorted(sizes)
    rate = F.create_map(*[x for name in labels for x in (F.lit(name), F.lit(_threshold(sample_per_label, sizes[name])).cast("long"))])
    chosen = rows.where(F.xxhash64(F.col("key").cast("string"), F.lit(7)) <= rate[F.col("label")])
    counted = chosen.select("text", "label").mapInArrow(_learn_counts, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((len(labels), BUCKETS), SMOOTHING)
    place = {name: i for i, name in enumerate(labels)}
    matrix[counted["label"].map(place).to_numpy(int), counted["bucket"].to_numpy(int)] += counted["n"].to_numpy(float)
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in labels], float) / sum(sizes.values()))
    return labels, np.concatenate([logs, prior[:, None]], axis=1)


def score_texts(texts: pa.Array, labels: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best label and its posterior for each text."""
    texts = texts.cast(pa.string()).fill_null("")
    known = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False).astype(bool)
    n = len(texts)
    if not labels:
        return [UNKNOWN] * n, np.zeros(n)
    buckets, owners = _grams(texts)
    cells, counts = np.unique(owners.astype(np.int64) * BUCKETS + buckets, return_counts=True)  # the sparse batch
    rows, columns = cells // BUCKETS, cells % BUCKETS
    weights = np.ascontiguousarray(model[:, :-1].T)[columns] * counts[:, None]
    starts = np.searchsorted(rows, np.arange(n))
    total = np.add.reduceat(np.concatenate([weights, np.zeros((1, len(labels)))]), starts, axis=0) if len(rows) else np.zeros((n, len(labels)))
    total[starts == np.append(starts[1:], len(rows))] = 0
    total += model[:, -1]
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [labels[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, score, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` beside the columns ``keep`` (default ``doc_id``) of every row."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*dict.fromkeys([*keep, text]))
    sent = common.send(docs.sparkSession, (model[0], model[1].astype(np.float32)))

    def run(batches):
        labels, logs = sent.value
        for batch in common.chunks(batches, text):
            names, scores = score_texts(batch.column(batch.schema.get_field_index(text)), labels, logs)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, fields)

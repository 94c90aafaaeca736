"""Ranked lexical search: many queries at once over one plan of shared term sets.

Scores are sums over terms, so queries (``items``) that share terms share work:

1. *Terms.* Documents become their counts of the terms that any item of a block asks for, and those counts are
   written. Corpus figures (documents, words, documents with a term) cover all documents.
2. *Plan.* Terms found in exactly the same items are one set. Then the two sets that the most items hold
   together become one, again and again, until no two are in two items: a graph in which every node is a
   set of terms, made of one or two others, and every item is a few nodes.
3. *Accumulators.* For a slice of documents every node's partial scores are made once, from its postings or as the
   sum of two others, and every item adds up its nodes. A task keeps the ``top`` best documents per item, so
   what leaves it depends on the items, not on the documents.
4. *Best of all tasks*, per item: first in salted groups, then of those.

Items are taken in blocks of at most ``BLOCK`` terms (or one longer item): that bounds what is sent to the tasks and what
the driver holds, whatever the number of items. Every document is read for every block.

Terms are compared by 64-bit numbers (see ``common``).

Defined results: a document that is null or has no term counts nowhere and is never ranked. An item that is null, has no
term, or only terms of no weight has no rows. Rows of ``items`` with one id are ranked each by itself.
Repeated documents are ranked each, one after the other. Equal scores go by ascending id, null ids last. Very long texts
are read whole. An empty table on either side gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.common import cut, drop_cut, signed
from leadloom.llm.decontam import BREAKS

TOP = 50
BLOCK = 1 << 18       # terms of the items that are searched for together
NEIGHBOURS = 32       # sets of an item that each of its sets is paired with, the most frequent first
CELLS = 1 << 22       # partial scores that a task holds at a time
SALTS = 16


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "text"):
        words = common.Words(batch.column(0), skip=BREAKS)
        numbers = signed(words.numbers())
        sets = [np.unique(numbers[a:b]) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "terms"])


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Items with terms, ``BLOCK`` terms at a time."""
    held, n = [], 0
    for row in items.toLocalIterator():
        if held and n + len(row["terms"]) > BLOCK:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row["terms"])
    if held:
        yield held


# ------------------------------------------------------------------ plan
class Plan:
    """Shared term sets of a few items: ``leaf`` of every term, ``sums`` (pairs of nodes that make further ones) and ``items``
    (the nodes that make up each)."""

    def __init__(self, items: list[list[int]], terms: int):
        holders: list[list[int]] = [[] for _ in range(terms)]
        for i, own in enumerate(items):
            for t in own:
                holders[t].append(i)
        number: dict[tuple, int] = {}
        self.leaf = np.array([number.setdefault(tuple(h), len(number)) for h in holders], np.int64)
        self.leaves = len(number)
        self.items: list[set[int]] = [set() for _ in items]
        for own, node in number.items():
            for i in own:
                self.items[i].add(node)
        self.sums: list[tuple[int, int]] = []
        self._share(Counter({node: len(own) for own, node in number.items()}))
        self.nodes = self.leaves + len(self.sums)

    def _share(self, support: Counter) -> None:
        """Replace the pair of nodes in the most items by its sum, as long as one is in two items."""
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, nodes in enumerate(self.items):
            order = sorted((n for n in nodes if support[n] > 1), key=lambda n: (-support[n], n))
            for k, a in enumerate(order):
                for b in order[k + 1:k + 1 + NEIGHBOURS]:
                    where[min(a, b), max(a, b)].add(i)
        heap = [(-len(own), pair) for pair, own in where.items() if len(own) > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            own = {i for i in where.get(pair, ()) if pair[0] in self.items[i] and pair[1] in self.items[i]}
            if len(own) < 2:
                continue
            if len(own) < -n:  # some of its items hold a larger set by now
                heapq.heappush(heap, (-len(own), pair))
                where[pair] = own
                continue
            node = self.leaves + len(self.sums)
            self.sums.append(pair)
            fresh: dict[tuple[int, int], set[int]] = defaultdict(set)
            for i in own:
                self.items[i] -= set(pair)
                for other in sorted((x for x in self.items[i] if support[x] > 1), key=lambda x: (-support[x], x))[:NEIGHBOURS]:
                    fresh[other, node].add(i)
                self.items[i].add(node)
            support[node] = len(own)
            for key, at in fresh.items():
                if len(at) > 1:
                    where[key] = at
                    heapq.heappush(heap, (-len(at), key))

    def scores(self, places: np.ndarray, docs: np.ndarray, values: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Scores of ``n`` documents for every item, from term values: the accumulators of all nodes are made once."""
        held = np.zeros((self.nodes, n), np.int64)
        cells = self.leaf[places] * n + docs
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else cells
        if len(cells):
            held.ravel()[cells[first]] = np.add.reduceat(values[order], first)
        for k, (a, b) in enumerate(self.sums):
            np.add(held[a], held[b], out=held[self.leaves + k])
        for nodes in self.items:
            yield held[sorted(nodes)].sum(axis=0)


# ------------------------------------------------------------------ passes over the documents
def _counts(sent):
    """Documents with a term -> how many terms they have, and which of the block's terms how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in common.chunks(batches, "text"):
            words = common.Words(batch.column(0), skip=BREAKS)
            numbers = words.numbers()
            n = np.diff(words.bounds)
            at = np.minimum(np.searchsorted(vocabulary, numbers), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == numbers)
            owner = np.repeat(np.arange(len(n)), n)[hit]
            cells, times = np.unique(owner * len(vocabulary) + at[hit], return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(n) + 1) * len(vocabulary))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((cells % len(vocabulary), pa.int32()), (times, pa.int64()))]
            full = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([x.take(full) for x in (batch.column(1), pa.array(n, pa.int64()), *lists)], ["doc_id", "n", "places", "times"])
    return run


def lengths(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Length factor of texts of ``n`` terms, in whole numbers of any size on the way."""
    sizes, at = np.unique(n, return_inverse=True)
    return np.array([100 - 50 + (50 * k * documents) // words for k in sizes.tolist()], np.int64)[at]


class Best:
    """The best documents so far of one item."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.ids, self.blank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        scores, ids, blank = (np.concatenate(x) for x in ((self.scores, scores[at]), (self.ids, ids[at]), (self.blank, blank[at])))
        order = np.lexsort((ids, blank, -scores))[:self.top]
        self.scores, self.ids, self.blank = scores[order], ids[order], blank[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def _ranked(sent, top: int):
    """Counts of documents -> the best documents of the task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, documents, words, names = sent.value
        best = [Best(top) for _ in names]
        step = max(64, CELLS // max(1, plan.nodes))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                blank = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy()
                m = lengths(part.column(1).to_numpy(), documents, words)
                places, times = (part.column(k).flatten().to_numpy() for k in (2, 3))
                docs = np.repeat(np.arange(len(ids)), part.column(2).value_lengths().to_numpy())
                values = weights[places] * ((1_000_000_000 * times) // (1000 * times + 20 * m[docs]))
                for one, scores in zip(best, plan.scores(places, docs, values, len(ids))):
                    one.add(scores, ids, blank)
        for i, one in enumerate(best):
            if len(one.scores):
                n = len(one.scores)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([names[i]] * n, pa.int64()), pa.array(one.ids, mask=one.blank), pa.array(one.scores)], ["item", "item_id", "doc_id", "score"])
    return run


def _search(docs: DataFrame, rows: list[Row], top: int) -> DataFrame:
    """Ranks of one block of items."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64))
    items = [np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64)).tolist() for r in rows]
    counted = cut(docs.mapInArrow(_counts(common.send(spark, vocabulary)), "doc_id long, n long, places array<int>, times array<long>"))
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).collect()[0]
    found = counted.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in found:
        weights[r["place"]] = math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * r["df"] + 1)))
    sent = common.send(spark, (Plan(items, len(vocabulary)), weights, total["documents"], total["words"], [r["item_id"] for r in rows]))
    best = counted.mapInArrow(_ranked(sent, top), "item int, item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranks = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    out = cut(ranks.select("item_id", "rank", "doc_id", "score"))
    drop_cut(counted)
    return out


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item, by rank from 1."""
    rows = docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"))
    asked = items.select(F.col(item_text).alias("text"), F.col(item_key).cast("long").alias("item_id"))
    asked = asked.mapInArrow(_item_terms, "item_id long, terms array<long>").where(F.size("terms") > 0)
    out = None
    for block in _blocks(asked):
        found = _search(rows, block, top)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

"""Connected components of an edge table: contraction of parts, then stars, every round on written tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import cut, drop_cut

PART = 1 << 18  # edges that one task contracts


class Forest:
    """Nodes joined so far, each under the smallest node of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, i: int) -> int:
        get = self.parent.get
        while (j := get(i, i)) != i:
            self.parent[i] = i = get(j, j)
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """Each node with its top."""
        pairs = [(i, self.top(i)) for i in list(self.parent)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> each node with the smallest node it is joined with by ``PART`` of them at a time."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.parent) >= PART:
            yield forest.edges()
            forest = Forest()
    if forest.parent:
        yield forest.edges()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to its smallest one: the larger ones (large star) or the smaller ones and itself.

    The smallest neighbours are written before they are joined, so both sides of the join come straight
    from an exchange and adaptive execution can split the rows of a node with very many neighbours.
    """
    rows = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = cut(rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
    near = rows.join(least, "a")
    if large:
        done = cut(near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")))
    else:
        out = near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        done = cut(out.where(F.col("a") != F.col("b")).distinct())
    drop_cut(least)
    return done


def _finished(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or edges from larger ones, not both: the edges are stars."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("low"), F.lit(0).alias("top")).union(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("low"), F.lit(1).alias("top")))
    seen = ends.groupBy("node").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.max("top").alias("top"))
    return seen.where((F.col("low") != F.col("high")) | F.col("low").isNotNull() & (F.col("top") == 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (columns ``a, b``, longs), component: the smallest node.

    A round contracts the edges in parts of about ``PART``, then links neighbours by a large and a small star,
    until the edges are stars: rounds grow with the logarithm of the longest path. Edges that fit in one part
    are stars after one contraction. A node without an edge to another is left out. Parts may name an edge
    each, so equal rows are removed at the end: each node is one row at every size.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        parts = max(1, math.ceil(now.count() / PART))
        small = cut(now.repartition(parts).mapInArrow(contract, "a long, b long"))
        drop_cut(now)
        now = small
        if parts == 1 or _finished(now):
            break
        wide = _star(now, large=True)
        after = _star(wide, large=False)
        drop_cut(now, wide)
        now = after
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return ends.distinct()

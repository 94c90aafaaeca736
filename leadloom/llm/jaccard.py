"""Exact n-gram Jaccard self-join: links between texts whose shingle sets are similar, and their components.

1. Every text becomes the set of its shingles. Equal sets are one node, so copies cost nothing further.
2. *Signatures.* Two sets of similarity ``t`` differ in at most ``k = (1 - t) / (1 + t) * (|x| + |y|)`` shingles.
   Cut the range of shingle numbers into ``k + 1`` parts: in one part at least the two sets are the same.
   So a set sends out one signature per part, for its own size class and for the class below, and similar sets
   have a signature in common. That loses no link. (A part empty on both sides is no signature; see
   ``signatures``.) A signature covers few shingles, so texts with a passage in common often share one too: sets
   only form a block if their odd sketches are near as well, which loses no link either (see ``blocks``).
3. *T-occurrence search in each block* (DivideSkip): a query set must occur on ``T`` of the inverted lists
   of its shingles. The longest lists are set aside, the short ones merged with a heap that skips ahead,
   and what is left is looked up by binary search in the long ones until ``T`` is reached or out of reach.

Defined results: a null or empty text has no shingles, links with nothing and is its own component; a text
of fewer words than a shingle is one shingle. Repeated rows have equal sets, so they are one component. Very long
texts are read whole. The component is named by the smallest ``doc_id`` in it, null only if all its ids are null.
Other columns of the input are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import blocks, common
from leadloom.llm.blocks import Groups, required
from leadloom.llm.common import cut, drop_cut

SHORT_TIMES = 2  # occurrences that the short lists must hold


# ------------------------------------------------------------------ sizes
class Classes:
    """Size classes: a set of a class is similar to sets of its own class and the two beside it only."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]

    def at(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, (self.tops[-1] + 1) * 100 // self.percent))
        return bisect_left(self.tops, size)

    def parts(self, level: int) -> tuple[int, int]:
        """Parts of a level (pairs inside the class, and with the class above), and how many of them may be empty.

        ``m - 1`` is the most shingles in which two similar sets of the level can differ. The spare parts
        make up for empty ones, of which a set of the level has about as many.
        """
        top = self.tops[level]
        m = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent) + 1
        spare = 0
        for _ in range(4):
            spare = math.ceil(1.3 * (m + spare) * (1 - 1 / (m + spare)) ** (self.tops[level - 1] + 1) - 1e-3)
        return m + spare, spare


def signatures(members: np.ndarray, classes: Classes) -> list[np.ndarray]:
    """Signatures of a set (sorted, distinct) for its size class and the one below.

    With ``m + s`` parts, at most ``m - 1`` of them differing, two similar sets share a part that is not
    empty unless more than ``s`` are empty in both. A set with more than ``s`` empty parts therefore sends
    the signatures of further divisions as well, up to the first that has no more than ``s``: two similar
    sets both send the first division in which either has so few.
    """
    out = []
    level = classes.at(len(members))
    with np.errstate(over="ignore"):
        for at in (level, level - 1):
            if at < 1:
                continue
            n, spare = classes.parts(at)
            turn = 0
            while True:
                own = members if not turn else np.sort(common.mix(members + np.uint64(turn)))
                part = ((own >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                sums = np.add.reduceat(common.mix(own ^ np.uint64(0x5851F42D4C957F2D)), starts)
                key = np.uint64((at << 40) + (turn << 32)) + part[starts]
                out.append(common.mix(sums + common.mix(key)))
                if n - len(starts) <= spare:
                    break
                turn += 1
    return out


# ------------------------------------------------------------------ search in a block
class Index:
    """Inverted lists over a few sets, searched by T-occurrence."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.lexsort((owners, every))
        every, self.owners = every[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        self.keys, self.starts = every[first], first
        self.ends = np.append(first[1:], len(every))

    def search(self, query: np.ndarray, skip: np.ndarray | None = None) -> list[int]:
        """Sets that reach the required overlap with ``query``. ``skip``: sets not asked for."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.keys, query), max(0, len(self.keys) - 1))
        at = at[self.keys[at] == query] if len(self.keys) else at[:0]
        need = required(n, -(-n * self.percent // 100), self.percent)  # with the smallest set that can be similar
        if len(at) < need:
            return []
        lengths = self.ends[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        long = need - min(need, SHORT_TIMES)                   # lists set aside: the others must hold the rest of the occurrences
        short, aside = at[:len(at) - long], at[len(at) - long:]
        found = self._merge([self.owners[self.starts[i]:self.ends[i]].tolist() for i in short], need - long)
        found = {k: v for k, v in found.items() if (skip is None or not skip[k]) and self._fits(n, int(self.sizes[k]))}
        if not found:
            return []
        candidates = np.array(sorted(found), np.int64)
        counts = np.array([found[k] for k in candidates.tolist()], np.int64)
        wanted = -(-self.percent * (n + self.sizes[candidates]) // (100 + self.percent))
        left = len(aside)
        for i in aside[::-1]:                                  # the longest lists first: they hold nearly every candidate
            one = self.owners[self.starts[i]:self.ends[i]]
            place = np.minimum(np.searchsorted(one, candidates), len(one) - 1)
            counts += one[place] == candidates
            left -= 1
            if left % 16 == 0:
                open_ = counts + left >= wanted
                if not open_.all():
                    candidates, counts, wanted = candidates[open_], counts[open_], wanted[open_]
                    if not len(candidates):
                        return []
        return candidates[counts >= wanted].tolist()

    def _fits(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    @staticmethod
    def _merge(lists: list[list[int]], times: int) -> dict[int, int]:
        """Ids on at least ``times`` of the sorted lists, with how often: a heap merge that skips ids that cannot get there."""
        heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
        heapq.heapify(heap)
        found = {}
        while len(heap) >= times:
            one = heap[0][0]
            taken = []
            while heap and heap[0][0] == one:
                taken.append(heapq.heappop(heap))
            if len(taken) >= times:
                found[one] = len(taken)
                after = one + 1
            else:
                while heap and len(taken) < times - 1:
                    taken.append(heapq.heappop(heap))
                after = heap[0][0] if heap else None
            if after is None:
                break
            for _, i, j in taken:
                j = bisect_left(lists[i], after, j)
                if j < len(lists[i]):
                    heapq.heappush(heap, (lists[i][j], i, j))
        return found


def link_sets(nodes: list[int], sets: list[np.ndarray], indexed: list[bool], percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Each set linked with an indexed one, directly or through others, and the smallest node it is joined with.

    ``labels``: components known before; they are not searched again, but their names are joined with what is found.
    """
    inside = [i for i, x in enumerate(indexed) if x]
    index = Index([sets[i] for i in inside], percent)
    groups = Groups(len(nodes))
    if labels:
        seen: dict[int, int] = {}
        for i, label in enumerate(labels):
            groups.join(seen.setdefault(label, i), i)
    for i in range(len(nodes)):
        own = groups.top(i)
        skip = np.array([groups.top(j) == own for j in inside], bool)
        if not skip.all():
            for k in index.search(sets[i], skip):
                groups.join(i, inside[k])
    return [(node, nodes[top]) for i, node in enumerate(nodes) if (top := groups.top(i)) != i]  # nodes are in order: the top is the least


# ------------------------------------------------------------------ the join
def _signer(percent: int) -> Callable[[], blocks.Signer]:
    def start() -> blocks.Signer:
        classes = Classes(percent)
        return lambda members: signatures(members, classes)
    return start


def similar_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``rid, doc_id, tid, node, n_shingles, component`` of every row of ``docs`` (see ``blocks.similar_sets``)."""
    return blocks.similar_sets(docs, size, percent, _signer(percent), link_sets)


def join(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents linked at ``percent`` similarity of their
    sets of ``size``-word shingles, and the smallest id of their component."""
    return blocks.named_components(similar_sets(blocks.rows_of(docs, key, text), size, percent))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with the smallest id, once. Texts without
    words are linked with nothing and all stay. Columns may have any names."""
    every = similar_sets(blocks.rows_of(docs, key, text), size, percent)
    found = every.where(F.col("component").isNotNull())
    best = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "rid", "tid")).alias("best")
    kept = cut(found.groupBy("component").agg(best).select(F.col("best.rid").alias("r"), F.col("best.tid").alias("t")))
    drop_cut(every)
    rows = docs.select(F.struct(*docs.columns).alias("row"), blocks.row_id(key, text).alias("r"), F.xxhash64(text).alias("t"),
                       (~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).alias("blank"))
    one = rows.where(~F.col("blank")).join(kept.hint("merge"), ["r", "t"], "left_semi").dropDuplicates(["r", "t"])
    return one.select("row").union(rows.where("blank").select("row")).select("row.*")

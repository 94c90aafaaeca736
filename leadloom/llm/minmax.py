"""Near duplicates by min-max hashing: of every permutation both ends are kept, so half as many are computed.

A permutation of the shingle numbers gives a set's least and its largest number there. Two sets agree in either with
a chance equal to their Jaccard similarity, and as one set's two ends are drawn without replacement, their mean has a
smaller variance than that of two permutations' minima; it is unbiased. ``ROWS`` ends of ``ROWS / 2`` permutations make a
band, its number is one signature. There are as many bands as it takes for sets at the threshold to have none in
common with a chance of ``MISS`` (44 bands, 132 permutations at 0.85): that is the only way a link is lost, and a
link whose ends are joined through other sets is not lost even then.

Sets with a band in common are candidates: first their odd sketches are compared, which loses nothing, then their
whole sets, which decides every link (see ``blocks``). Inside a block a set is compared with those that
are not yet joined with it, so a group of near copies costs about one comparison a set, not one a pair.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its own
component. A text of fewer words than a shingle is one shingle. Repeated rows have equal sets, so they are one
component. Very long texts are read whole. A component is named by the smallest id in it, null only if all its ids are
null; of several rows with that id each is kept. Other columns of the input are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import blocks, common
from leadloom.llm.blocks import Groups, required

ROWS = 6        # ends in a band: least and largest numbers of half as many permutations
MISS = 1e-9     # chance that two sets at the threshold share no band
STRETCH = 4096  # shingles that are permuted at a time


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands it takes at a threshold."""
    same = (percent / 100) ** rows
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def ends(members: np.ndarray, permutations: np.ndarray) -> np.ndarray:
    """Least and largest number of a set under each permutation, side by side."""
    low = high = None
    with np.errstate(over="ignore"):
        for at in range(0, len(members), STRETCH):
            there = members[None, at:at + STRETCH] * permutations[:, None]
            least, most = there.min(axis=1), there.max(axis=1)
            low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
    return np.stack([low, high], axis=1).ravel()


def bands(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Numbers of the bands of a set's ends."""
    cells = found.reshape(-1, rows)
    with np.errstate(over="ignore"):
        place = common.seeds(rows, 41)
        return common.mix((common.mix(cells) * place[None, :]).sum(axis=1, dtype=np.uint64) + common.seeds(len(cells), 42))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Unbiased estimate of the Jaccard similarity from the ends of two sets."""
    return float((a == b).mean())


def _signer(percent: int) -> Callable[[], blocks.Signer]:
    def start() -> blocks.Signer:
        permutations = common.seeds(bands_for(percent) * ROWS // 2, 40)
        return lambda members: [bands(ends(members, permutations))]
    return start


def confirm(nodes: list[int], sets: list[np.ndarray], indexed: list[bool], percent: int, labels: list[int]) -> list[tuple[int, int]]:
    """Each set linked with an indexed one, directly or through others, and the smallest node it is joined with.

    ``labels``: components known before. A set is compared with all indexed ones not yet joined with it, at once.
    """
    groups, seen = Groups(len(nodes)), {}
    for i, label in enumerate(labels):
        groups.join(seen.setdefault(label, i), i)
    inside = np.flatnonzero(np.array(indexed, bool))
    sizes = np.array([len(sets[i]) for i in inside], np.int64)
    flat, starts = np.concatenate([sets[i] for i in inside]), np.cumsum(sizes) - sizes

    def linked(i: int, among: np.ndarray) -> np.ndarray:
        """Which of the indexed sets ``among`` are similar to set ``i``."""
        one = sets[i]
        n = sizes[among]
        among = among[100 * np.minimum(n, len(one)) >= percent * np.maximum(n, len(one))]
        if not len(among):
            return among
        n = sizes[among]
        bounds = np.cumsum(n) - n
        cells = np.repeat(starts[among] - bounds, n) + np.arange(n.sum())
        place = np.minimum(np.searchsorted(one, flat[cells]), len(one) - 1)
        common_ = np.add.reduceat((one[place] == flat[cells]).astype(np.int64), bounds)
        return among[common_ >= required(n, len(one), percent)]

    for i in _near_first(nodes, inside):
        own = groups.top(i)
        apart = np.array([k for k, j in enumerate(inside.tolist()) if groups.top(j) != own], np.int64)
        if len(apart):
            for k in linked(i, apart).tolist():
                groups.join(i, int(inside[k]))
    return [(node, nodes[top]) for i, node in enumerate(nodes) if (top := groups.top(i)) != i]  # nodes are in order: the top is the least


def _near_first(nodes: list[int], inside: np.ndarray) -> list[int]:
    """The order in which sets are compared: the indexed ones, which may join many, before the others."""
    first = inside.tolist()
    return first + sorted(set(range(len(nodes))) - set(first))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: documents linked at ``percent`` similarity of their
    sets of ``size``-word shingles, the smallest id of their component, and whether it is their own."""
    found = blocks.similar_sets(blocks.rows_of(docs, key, text), size, percent, _signer(percent), confirm)
    return blocks.named_components(found).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

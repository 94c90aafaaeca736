"""Blocks of sets that may be similar, and the components of those that are: what the similarity joins share.

A join brings two things: ``signer`` gives the signatures of a set, of which similar sets have one in common, and
``link`` finds the similar ones among sets held in memory. Between them stand, for any threshold:

1. *Names.* Texts become sets of shingles; equal sets are one node, so copies cost nothing further. With its name a set
   leaves its size and an *odd sketch*: one bit for each class of shingle numbers, the parity of how many fall there.
2. *Shared signatures.* Signatures are sent packed, each once per stretch of texts; those that one node alone has are
   forgotten. What is left are rows of signature and node.
3. *Odd sketches.* Two sketches differ in at most as many bits as their sets differ in shingles, so pairs whose
   sketches are too far apart are no links, for certain. Sets with a common signature and sketches near enough are in
   one block. A passage in common makes no block, as a signature alone would. A signature of very many
   sets is compared in pairs of slices, each a group of its own.
4. *Search.* The sets themselves are only made for members of blocks. A large block is cut into slices of
   about ``SLICE`` sets. Its first slice is searched against all others; what that leaves outside the block's largest
   component is searched against all, too. Every pair of sets is then either searched or known to be in one
   component, and no task holds more than two slices.

Nodes are 64-bit numbers of whole sets, shingles 64-bit numbers of word runs (see ``common``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.common import cut, drop_cut
from leadloom.llm.components import PART, Forest, components

SLICE = 512
CROWD = 4096      # sets with one signature whose sketches are compared in one group
FLUSH = 1 << 20   # signatures that are combined before they leave a task

Signer = Callable[[np.ndarray], list[np.ndarray]]


def required(a, b, percent: int):
    """Least common shingles of sets of ``a`` and ``b`` with ``100 * common >= percent * union``."""
    return -(-percent * (a + b) // (100 + percent))


def node_of(members: np.ndarray) -> int:
    """64-bit number of a set of shingles."""
    with np.errstate(over="ignore"):
        return int(common.mix(common.mix(members).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


# ------------------------------------------------------------------ sketches
def sketch(members: np.ndarray) -> np.ndarray:
    """Odd sketch of a set, in 64-bit words: about two bits a shingle, a power of two."""
    bits = max(64, 1 << (2 * len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one a row) as ``words`` words: what the set's sketch of that width would be."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sketches (rows) and sizes that may be similar sets."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (apart <= n + m - 2 * required(n, m, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def near_links(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the places of sets whose sketches are near: as many links as it takes to join them."""
    left, links = np.arange(len(nodes)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = _near(sketches[left], sketches[one], sizes[left], sizes[one], percent)
            found = left[near].tolist()
            links += [(one, k) for k in found]
            todo += found
            left = left[~near]
    return links


def _near_groups(percent: int):
    """Rows sorted by (key, part): node, size and sketch -> links of nodes that are near in a group, less those that close a ring."""

    def links(rows: pa.Table, forest: Forest) -> None:
        key, part, node, size = (rows.column(k).to_numpy() for k in range(4))
        cells = rows.column(4).combine_chunks()
        widths = pc.binary_length(cells).to_numpy() // 8
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        counts = np.diff(np.append(first, len(key)))
        least = np.minimum.reduceat(widths, first)
        flat, at = _words(cells)
        for width in np.unique(least[counts > 1]).tolist():
            groups = np.flatnonzero((least == width) & (counts > 1))
            rows_of = np.concatenate([np.arange(first[g], first[g] + counts[g]) for g in groups])
            heads = np.repeat(np.cumsum(counts[groups]) - counts[groups], counts[groups])
            held = np.empty((len(rows_of), width), np.uint64)
            for wide in np.unique(widths[rows_of]).tolist():
                own = np.flatnonzero(widths[rows_of] == wide)
                held[own] = folded(flat[at[rows_of[own]][:, None] + np.arange(wide)], width)
            n, names = size[rows_of], node[rows_of]
            near = _near(held, held[heads], n, n[heads], percent)
            for a, b in np.unique(np.stack([names[near], names[heads[near]]], axis=1), axis=0).tolist():
                if a != b:
                    forest.join(a, b)
            starts = np.cumsum(counts[groups]) - counts[groups]
            for start, count in zip(starts.tolist(), counts[groups].tolist()):
                if count > 2 and not near[start:start + count].all():  # not all are near the first one
                    span = slice(start, start + count)
                    for i, k in near_links(names[span], n[span], held[span], percent):
                        forest.join(int(names[start + i]), int(names[start + k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = Forest(), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            key, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if len(key) and not (key[0] == key[-1] and part[0] == part[-1]) else 0
            kept = table.slice(last)
            if last:
                links(table.slice(0, last), forest)
            if len(forest.parent) >= PART:
                yield forest.edges()
                forest = Forest()
        if kept is not None and kept.num_rows:
            links(kept, forest)
        if forest.parent:
            yield forest.edges()
    return run


def _words(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed 64-bit words of a binary column, and where each row begins."""
    _, offsets, data = cells.buffers()
    at = np.frombuffer(offsets, np.int32, len(cells) + 1, cells.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(np.uint64) if at[-1] > at[0] else np.zeros(0, np.uint64), (at[:-1] - at[0]) // 8


# ------------------------------------------------------------------ passes over the texts
def _name_sets(size: int):
    def run(batches):
        for batch in common.chunks(batches, "text"):
            sets = common.shingle_sets(batch.column(1), size)
            found = [pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *found], ["rid", "doc_id", "tid", "node", "n_shingles", "sketch"])
    return run


PACKETS = "bucket long, signatures binary, places binary, nodes binary"


def _packet(bucket: int | None, keys: np.ndarray, nodes: np.ndarray) -> tuple:
    """Signatures less their lowest 16 bits, the place of each one's node, and the nodes."""
    names, place = np.unique(nodes, return_inverse=True)
    high = np.ascontiguousarray(keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
    return bucket, high.tobytes(), place.astype(np.uint32).tobytes(), names.tobytes()


def _unpacked(high: bytes, places: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(high) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(high, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64)[:, 0], np.frombuffer(names, np.int64)[np.frombuffer(places, np.uint32)]


def _shared_keys(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, which of them are a key's first, and which have a key of several nodes."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
    keys, nodes = keys[new], nodes[new]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    counts = np.diff(np.append(np.flatnonzero(first), len(keys)))
    return keys, nodes, first, np.repeat(counts > 1, counts)


def _send_signatures(size: int, signer: Callable[[], Signer], buckets: int):
    """Packets of signatures, for each flush and bucket one.

    A signature that several sets of one flush have is sent with one of them only; all of them go to packets of no
    bucket, as it is known to be shared. So what meets in a bucket follows the flushes, not the sets that have a
    signature. Packets keep 48 bits of a signature beside its bucket: should two meet in them, sets are
    compared in vain, no link is lost. A row a signature would be thrice the bytes.
    """
    columns = [x.split() for x in PACKETS.split(", ")]

    def packets(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node, first, several = _shared_keys(np.concatenate(keys), np.concatenate(nodes))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.flatnonzero(first)[np.argsort(bucket[first], kind="stable")]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True])))
        rows = [_packet(int(bucket[order[a]]), key[order[a:b]], node[order[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        if several.any():
            shared = np.flatnonzero(several)
            shared = shared[np.argsort(bucket[shared], kind="stable")]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[shared][1:] != bucket[shared][:-1], [True])))
            rows += [_packet(-1 - int(bucket[shared[a]]), key[shared[a:b]], node[shared[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(zip(*rows), columns)], [name for name, _ in columns])

    def run(batches):
        sign = signer()
        keys, nodes, held = [], [], 0
        for batch in common.chunks(batches, "text"):
            for members in common.shingle_sets(batch.column(1), size):
                if not len(members):
                    continue
                node = node_of(members)
                for got in sign(members):
                    keys.append(got)
                    nodes.append(np.full(len(got), node, np.int64))
                    held += len(got)
            if held >= FLUSH:
                yield packets(keys, nodes)
                keys, nodes, held = [], [], 0
        if held:
            yield packets(keys, nodes)
    return run


def _named(high: np.ndarray, bucket: int) -> np.ndarray:
    """Signatures of a bucket under one number, for packets of both kinds."""
    return (high | np.uint64((bucket & 0xFFFF) << 48)).view(np.int64)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets sorted by bucket -> signatures that several nodes have, with each of these. One bucket is held at a time."""

    def close(bucket: int, keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node, _, several = _shared_keys(np.concatenate(keys), np.concatenate(nodes))
        return pa.RecordBatch.from_arrays([pa.array(_named(key[several], bucket)), pa.array(node[several])], ["key", "node"])

    now, keys, nodes = None, [], []
    for batch in batches:
        for bucket, *packet in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != now and keys:
                yield close(now, keys, nodes)
                keys, nodes = [], []
            now = bucket
            key, node = _unpacked(*packet)
            keys.append(key)
            nodes.append(node)
    if keys:
        yield close(now, keys, nodes)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets of signatures known to be shared -> one row each."""
    for batch in batches:
        for bucket, *packet in zip(*(batch.column(i).to_pylist() for i in range(4))):
            key, node = _unpacked(*packet)
            yield pa.RecordBatch.from_arrays([pa.array(_named(key, -1 - bucket)), pa.array(node)], ["key", "node"])


def shared_signatures(docs: DataFrame, size: int, signer: Callable[[], Signer]) -> DataFrame:
    """``key, node``: signatures that several nodes have, with each of these."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = cut(docs.mapInArrow(_send_signatures(size, signer, buckets), PACKETS))
    met = sent.where(F.col("bucket") >= 0).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across, "key long, node long")
    out = cut(met.union(sent.where(F.col("bucket") < 0).mapInArrow(_inside, "key long, node long")).distinct())
    drop_cut(sent)
    return out


def candidate_blocks(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, block`` of nodes that have a signature in common and sketches near enough, directly or through others.

    ``sets``: ``node, n_shingles, sketch``. The sketches go to the signatures, not the sets.
    """
    crowds = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    parts = _slices(F.coalesce("n", F.lit(1)), CROWD)
    own = F.pmod(F.xxhash64("node"), F.col("slices"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda i: F.least(i, F.col("slice")) * F.col("slices") + F.greatest(i, F.col("slice")))
    dealt = shared.join(crowds, "key", "left").withColumn("slices", parts).withColumn("slice", own).select("key", "node", F.explode(pairs).alias("part"))
    rows = dealt.join(sets, "node").select("key", "part", "node", "n_shingles", "sketch")
    near = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_near_groups(percent), "a long, b long")
    return components(near).withColumnRenamed("component", "block")


# ------------------------------------------------------------------ search in blocks
class Groups:
    """Which sets are known to be linked, directly or through others."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


Linker = Callable[[list[int], list[np.ndarray], list[bool], int, list[int]], list[tuple[int, int]]]


def _search_blocks(percent: int, link: Linker):
    """Rows sorted by (block, part): (node, indexed, keep, label, set) of one part at a time -> links, and the sets to keep."""

    def close(rows: list) -> pa.RecordBatch:
        links = []
        unique, kept = {}, {}
        for node, indexed, keep, label, members in rows:
            if node not in unique or indexed:
                unique[node] = (indexed, label, members)
            if keep:
                kept[node] = members
        if len(unique) > 1 and any(x[0] for x in unique.values()):
            nodes = sorted(unique)
            known = [unique[x][1] for x in nodes]
            links = link(nodes, [np.frombuffer(unique[x][2], np.uint64) for x in nodes], [unique[x][0] for x in nodes], percent, known)
        blank = [None] * len(links)
        return pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in links] + [None] * len(kept), pa.int64()), pa.array([x[1] for x in links] + [None] * len(kept), pa.int64()),
            pa.array(blank + list(kept), pa.int64()), pa.array(blank + list(kept.values()), pa.binary())], ["a", "b", "node", "members"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for block, part, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (block, part) != now and rows:
                    yield close(rows)
                    rows = []
                now = (block, part)
                rows.append(row)
        if rows:
            yield close(rows)
    return run


def _member_sets(size: int):
    """(text, node, block, label, parts) -> (node, block, label, parts, set), where the text is the node's."""

    def run(batches):
        for batch in common.chunks(batches, "text"):
            sets = common.shingle_sets(batch.column(0), size)
            wanted = batch.column(1).to_pylist()
            own = [i for i, (members, node) in enumerate(zip(sets, wanted)) if len(members) and node_of(members) == node]
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(1, 5)] + [pa.array([sets[i].tobytes() for i in own], pa.binary())], ["node", "block", "label", "parts", "members"])
    return run


def _slices(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")


PARTS = "parts array<struct<part:long,indexed:boolean,keep:boolean>>"


def _searched(sets: DataFrame, percent: int, link: Linker) -> DataFrame:
    """Search the parts of blocks. ``sets`` (``node, block, label, parts, members``) says in which parts of its block a set
    takes part, where it is indexed, and where it is kept.

    Returns links (``a``, and ``b``, the smallest node it is linked with in its part) and kept sets (``node, members``).
    """
    dealt = sets.select("block", "node", "label", "members", F.explode("parts").alias("p")).select("block", "p.part", "node", "p.indexed", "p.keep", "label", "members")
    dealt = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "node")
    return cut(dealt.mapInArrow(_search_blocks(percent, link), "a long, b long, node long, members binary"))


def _links(searched: DataFrame) -> DataFrame:
    return searched.where(F.col("a").isNotNull()).select("a", "b")


def _parts(numbers: Column, part, indexed: bool | Column, keep) -> Column:
    flag = indexed if isinstance(indexed, Column) else F.lit(indexed)
    return F.transform(numbers, lambda i: F.struct(part(i).cast("long").alias("part"), flag.alias("indexed"), keep(i).alias("keep")))


def similar_sets(docs: DataFrame, size: int, percent: int, signer: Callable[[], Signer], link: Linker) -> DataFrame:
    """``rid, doc_id, tid, node, n_shingles, component`` of every row of ``docs`` (``rid, text, doc_id, tid``): equal sets
    are one node, ``component`` the smallest node reachable by links; both null for rows without shingles."""
    spark = docs.sparkSession
    named = cut(docs.mapInArrow(_name_sets(size), "rid long, doc_id long, tid long, node long, n_shingles long, sketch binary"))
    shared = shared_signatures(docs, size, signer)
    common.let_go(spark)  # the packets, before the sketches are shuffled
    alike = named.where(F.col("node").isNotNull()).join(shared.select("node").distinct(), "node", "left_semi")
    sets = cut(alike.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    blocks = cut(candidate_blocks(shared, sets, percent))
    drop_cut(shared, sets)
    common.let_go(spark)  # the sketches, before the texts are shuffled
    sizes = cut(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("block_size")))
    heads = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("rid").alias("rid"))
    n = _slices(F.col("block_size"), SLICE)
    members = heads.join(blocks, "node").join(sizes, "block").withColumn("slices", n).withColumn("slice", F.pmod(F.xxhash64("node"), n))
    members = cut(members.select("rid", "node", "block", "slices", "slice"))
    many = F.col("slices") > 1
    own = _parts(F.array("slice"), lambda i: i, ~many, lambda i: many)
    first = _parts(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: i, True, lambda i: i == 0)
    asked = members.select("rid", "node", "block", F.col("node").alias("label"), F.when(many & (F.col("slice") == 0), first).otherwise(own).alias("parts"))
    # the texts are always shuffled to the members of blocks, which grow with the corpus, never the other way round;
    # sets are made from them there, and only those of large blocks are kept for a second search
    texts = docs.select("rid", "text").join(asked.hint("merge"), "rid").select("text", "node", "block", "label", "parts")
    searched = _searched(texts.mapInArrow(_member_sets(size), f"node long, block long, label long, {PARTS}, members binary"), percent, link)
    del texts
    common.let_go(spark)  # the texts and sets
    found = _links(searched)
    large = members.where(many)
    if not large.isEmpty():
        again = _second_search(large.drop("rid"), searched.where(F.col("node").isNotNull()).select("node", "members"), found, percent, link)
        found = cut(components(found.union(_links(again))).select(F.col("node").alias("a"), F.col("component").alias("b")))
        drop_cut(again, searched)
    out = named.drop("sketch").join(found.withColumnRenamed("a", "node"), "node", "left").withColumn("component", F.coalesce("b", "node"))
    out = cut(out.select("rid", "doc_id", "tid", "node", "n_shingles", "component"))
    drop_cut(named, blocks, sizes, members, searched, found)
    return out


def _second_search(large: DataFrame, sets: DataFrame, links: DataFrame, percent: int, link: Linker) -> DataFrame:
    """Search the sets outside the largest component of their block against the whole block."""
    known = cut(large.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    groups = known.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    main = cut(main.where(F.col("outside") > 0))
    rest = known.join(main, "block")
    rest = rest.withColumn("turns", _slices(F.col("outside"), SLICE)).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")))
    no = lambda i: F.lit(False)
    asking = _parts(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: t * F.col("slices") + F.col("slice"), False, no)
    asked = _parts(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: F.col("turn") * F.col("slices") + i, True, no)
    parts = F.when(F.col("label") != F.col("main"), F.concat(asking, asked)).otherwise(asking)
    out = _searched(rest.select("node", "block", "label", parts.alias("parts")).join(sets, "node"), percent, link)
    drop_cut(known, main)
    return out


# ------------------------------------------------------------------ results by document
def row_id(key: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text))


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_id(key, text).alias("rid"), F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"))


def named_components(found: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the component's smallest id."""
    named = cut(found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = found.select("doc_id", "n_shingles", "component").join(named, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

"""Keys of an append-only table, kept beside it, so an append need not read the table for its keys.

Every append leaves one *part*: its distinct keys in hash buckets, and a Bloom filter for each bucket. To ask for a few keys,
the filters of their buckets are read, and then only those buckets whose filter may hold one. A part also names
the files of the table that it covers and the table's columns; files that no part names (a writer died before it came
to them, or someone else wrote them) are found by their names and read first. Parts at the end that have grown as
large as the one before become one, so there are about as many parts as the table's size has doublings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut, drop_cut

BUCKETS = 16
PIECE = 32768          # bits of one row of a filter
KEYS_A_PIECE = 4096    # keys that a bucket may have for each of its filter's pieces
HASHES = 2
FANOUT = 4


@dataclass
class Part:
    number: int
    keys: int
    pieces: int
    files: list[str]
    columns: list[str]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names in a folder that begin with ``prefix``; none if there is no folder."""
    files, where = _folder(spark, path)
    found = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(n for n in found if n.startswith(prefix))


def parts(spark: SparkSession, path: str) -> list[Part]:
    """Finished parts, oldest first."""
    folders = [f"{path}/{n}/meta" for n in names(spark, path, "part=")]
    done = [f for f in folders if names(spark, f, "_SUCCESS")]
    return sorted((Part(**r.asDict()) for r in spark.read.parquet(*done).collect()), key=lambda p: p.number) if done else []  # a row a part


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def _places(pieces: int) -> Column:
    """Bits of a key in its bucket's filter."""
    return F.array(*[F.pmod(F.xxhash64("key", F.lit(h + 1)), F.lit(pieces * PIECE)) for h in range(HASHES)])


def _write(spark: SparkSession, path: str, keys: DataFrame, files: list[str], columns: list[str]) -> Part:
    number = max([0, *(int(n.removeprefix("part=")) for n in names(spark, path, "part="))]) + 1
    folder = f"{path}/part={number}"
    keys = cut(keys.select("key").distinct())
    n = keys.count()
    pieces = -(-n // (BUCKETS * KEYS_A_PIECE)) or 1
    if n:
        rows = keys.withColumn("bucket", _bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/keys")
        bits = rows.select("bucket", F.explode(_places(pieces)).alias("at")).select("bucket", F.floor(F.col("at") / PIECE).cast("int").alias("piece"), (F.col("at") % PIECE).alias("bit"))
        filters = bits.groupBy("bucket", "piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
        filters.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/filters")
    drop_cut(keys)
    part = Part(number, n, pieces, files, columns)
    fields = "number long, keys long, pieces long, files array<string>, columns array<string>"
    spark.createDataFrame([(part.number, part.keys, part.pieces, part.files, part.columns)], fields).coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return part


def add(spark: SparkSession, path: str, keys: DataFrame, files: list[str], columns: list[str], done: list[Part] | None = None) -> list[Part]:
    """Add the keys (``key``) of some files of the table, which has these ``columns``; the parts after it. ``done``: those before."""
    done = [*(parts(spark, path) if done is None else done), _write(spark, path, keys, files, columns)]
    first, total = len(done) - 1, done[-1].keys
    while first > 0 and done[first - 1].keys <= 2 * total:
        first -= 1
        total += done[first].keys
    chosen = done[first:]
    if len(chosen) >= FANOUT:
        every = [spark.read.parquet(f"{path}/part={p.number}/keys").select("key") for p in chosen if p.keys]
        merged = every[0] if every else keys.select("key").limit(0)
        for part in every[1:]:
            merged = merged.union(part)
        done = [*done[:first], _write(spark, path, merged, sorted({f for p in chosen for f in p.files}), chosen[-1].columns)]
        for p in chosen:  # until they are gone both are read, which changes nothing
            where_files, where = _folder(spark, f"{path}/part={p.number}")
            where_files.delete(where, True)
    return done


def _buckets(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame | None:
    there = set(names(spark, folder, "bucket="))
    found = [f"{folder}/bucket={b}" for b in wanted if f"bucket={b}" in there]
    return spark.read.option("basePath", folder).parquet(*found) if found else None


def _numbers(rows: DataFrame) -> list[int]:
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most BUCKETS


def _possible(spark: SparkSession, folder: str, asked: DataFrame, pieces: int) -> DataFrame | None:
    """Those of ``asked`` (``key, bucket``) that the filters of a part may hold."""
    filters = _buckets(spark, f"{folder}/filters", _numbers(asked))
    if filters is None:
        return None
    probes = asked.select("key", "bucket", F.explode(_places(pieces)).alias("at"))
    probes = probes.select("key", "bucket", F.floor(F.col("at") / PIECE).cast("int").alias("piece"), (F.col("at") % PIECE).cast("int").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)).cast("int") % 2 == 1
    return probes.join(filters, ["bucket", "piece"]).where(hit).groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES)


def known(spark: SparkSession, path: str, keys: DataFrame, done: list[Part] | None = None) -> DataFrame:
    """Those of ``keys`` (``key``) that the table has. ``done``: its parts, if known."""
    asked = cut(keys.select("key").distinct().withColumn("bucket", _bucket()))
    out = asked.select("key").limit(0)
    for part in parts(spark, path) if done is None else done:
        folder = f"{path}/part={part.number}"
        possible = _possible(spark, folder, asked, part.pieces) if part.keys else None
        if possible is not None:
            possible = cut(possible.select("key", "bucket"))
            held = _buckets(spark, f"{folder}/keys", _numbers(possible))
            if held is not None:
                out = out.union(held.select("key").join(possible.select("key"), "key", "left_semi"))
    return out.distinct()

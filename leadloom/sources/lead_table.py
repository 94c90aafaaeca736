"""The stored leads: a merge-on-read table in buckets, with an index from match keys to leads.

A batch writes one *part*: whole rows of the leads it founded or changed, the ids of those among them that earlier
parts hold (``replaced``), and the match keys of its rows. Nothing stored before is rewritten. A reader takes every
row that no later part replaces.

``leads`` are hash-bucketed by ``lead_id`` and ``keys`` by the key, one folder a bucket, so a batch opens the buckets
its keys hash to, finds the leads that hold them, and opens those leads' buckets: what it reads and writes follows
the batch. ``merge_parts`` keeps parts few: those at the end that together outgrow the one before become one (each
row is rewritten about once per doubling of the table), and all of them once half of the rows are replaced.

``version=N`` names the parts that make up the table, with their sizes, the highest id, and the last batch of every writer. It
is written last; readers take the newest finished one, so a run that dies leaves the table as it was. The version
before stays for readers that have begun; parts that neither names are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.operators.resolve import fold_batch, key_columns
from leadloom.session import cut, drop_cut

VERSION, PART = "version=", "part="
KEPT_VERSIONS = 2
BUCKETS = 16   # of a new table; choose so that a bucket of the grown table is some hundred MB
FANOUT = 4     # parts at the end that are merged together
KEYS = {"phone": "p", "domain": "d", "name": "n"}
RUN_ONLY = ("created", "sightings")


@dataclass
class Version:
    """What a finished version names."""

    number: int = 0
    buckets: int = BUCKETS
    top: int = 0                                               # highest lead id
    parts: dict[int, int] = field(default_factory=dict)        # number -> rows
    replaced: dict[int, int] = field(default_factory=dict)     # number -> ids of earlier rows it replaces
    writers: dict[str, int] = field(default_factory=dict)      # writer -> its last batch

    def rows(self) -> list[tuple[str, str, int]]:
        out = [("buckets", "", self.buckets), ("top", "", self.top)]
        for kind, found in (("part", self.parts), ("replaced", self.replaced), ("writer", self.writers)):
            out += [(kind, str(k), v) for k, v in found.items()]
        return out


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in _names(spark, path) if n.startswith(prefix))


def _finished(spark: SparkSession, path: str) -> list[int]:
    return [v for v in _numbers(spark, path, VERSION) if "_SUCCESS" in _names(spark, f"{path}/{VERSION}{v}")]


def _version(spark: SparkSession, path: str, number: int) -> Version:
    out = Version(number)
    for r in spark.read.parquet(f"{path}/{VERSION}{number}").collect():  # a row a part and writer
        if r.kind in ("buckets", "top"):
            setattr(out, r.kind, r.value)
        elif r.kind == "writer":
            out.writers[r.name] = r.value
        else:
            (out.parts if r.kind == "part" else out.replaced)[int(r.name)] = r.value
    out.parts = dict(sorted(out.parts.items()))
    return out


def newest_version(spark: SparkSession, path: str) -> Version | None:
    done = _finished(spark, path)
    return _version(spark, path, done[-1]) if done else None


def _finish(spark: SparkSession, path: str, version: Version) -> None:
    """Write the version after ``version.number``, and delete what only versions before the kept ones name."""
    number = version.number + 1
    spark.createDataFrame(version.rows(), "kind string, name string, value long").coalesce(1).write.mode("overwrite").parquet(f"{path}/{VERSION}{number}")
    done = _finished(spark, path)
    kept = done[-KEPT_VERSIONS:]
    named = {p for v in kept for p in (version if v == number else _version(spark, path, v)).parts}
    for folder in [f"{VERSION}{v}" for v in done if v not in kept] + [f"{PART}{p}" for p in _numbers(spark, path, PART) if p not in named]:
        files, where = _path(spark, f"{path}/{folder}")
        files.delete(where, True)
    version.number = number


# ------------------------------------------------------------------ reading
def _bucket(buckets: int, *columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """A bucketed folder, or only those of its buckets that are wanted."""
    if wanted is None:
        return spark.read.parquet(folder)
    there = {int(n.removeprefix("bucket=")) for n in _names(spark, folder) if n.startswith("bucket=")}
    found = [f"{folder}/bucket={b}" for b in wanted if b in there]
    if not found:
        return spark.createDataFrame([], spark.read.parquet(folder).schema)
    return spark.read.option("basePath", folder).parquet(*found)


def _live(spark: SparkSession, path: str, version: Version, numbers: list[int], wanted: list[int] | None = None) -> DataFrame:
    """Rows of some parts that none of these replaces later."""
    rows, gone = None, None
    for p in numbers:
        part = _read(spark, f"{path}/{PART}{p}/leads", wanted).withColumn("_part", F.lit(p))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if version.replaced.get(p) and p != numbers[0]:
            ids = _read(spark, f"{path}/{PART}{p}/replaced", wanted).select("lead_id", F.lit(p).alias("_by"))
            gone = ids if gone is None else gone.union(ids)
    if gone is not None:
        last = gone.groupBy("lead_id").agg(F.max("_by").alias("_by"))
        rows = rows.join(last, "lead_id", "left").where(F.col("_by").isNull() | (F.col("_part") >= F.col("_by"))).drop("_by")
    return rows.drop("_part", "bucket")


def lead_table(spark: SparkSession, path: str) -> DataFrame | None:
    """All leads as last written, or None before the first write."""
    version = newest_version(spark, path)
    return None if version is None else _live(spark, path, version, list(version.parts))


def read_leads(spark: SparkSession, path: str, with_quarantined: bool = False) -> DataFrame:
    """Lead table without quarantined records unless asked for."""
    leads = lead_table(spark, path)
    if leads is None:
        raise ValueError(f"no lead table at {path}")
    return leads if with_quarantined else leads.where(~F.col("status").eqNullSafe(rules.QUARANTINED))


def leads_by_id(spark: SparkSession, path: str, ids: DataFrame, version: Version | None = None) -> DataFrame:
    """Stored leads with an id in ``ids`` (``lead_id``): only their buckets are opened."""
    version = version or newest_version(spark, path)
    wanted = sorted(r.b for r in ids.select(_bucket(version.buckets, "lead_id").alias("b")).distinct().collect())
    return _live(spark, path, version, list(version.parts), wanted).join(ids.select("lead_id").distinct(), "lead_id", "left_semi")


def match_keys(leads: DataFrame, id_column: str = "lead_id") -> DataFrame:
    """``lead_id, kind, key`` of every match key that a lead or sighting holds."""
    held = key_columns(leads.withColumnRenamed(id_column, "pos") if id_column != "pos" else leads)
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for c, kind in KEYS.items()])
    return held.select(F.col("pos").alias("lead_id"), F.explode(each).alias("k")).select("lead_id", "k.*").where(F.col("key").isNotNull())


def leads_holding(spark: SparkSession, path: str, asked: DataFrame, version: Version | None = None) -> DataFrame:
    """Ids of the stored leads that hold one of ``asked`` (``kind, key``, distinct): only the keys' buckets are opened.

    A lead keeps the keys it has, so what an earlier part says of it still holds.
    """
    version = version or newest_version(spark, path)
    wanted = sorted(r.b for r in asked.select(_bucket(version.buckets, "kind", "key").alias("b")).distinct().collect())
    known = None
    for p in version.parts:
        part = _read(spark, f"{path}/{PART}{p}/keys", wanted).select("kind", "key", "lead_id")
        known = part if known is None else known.union(part)
    return known.join(asked.select("kind", "key"), ["kind", "key"], "left_semi").select("lead_id").distinct()


# ------------------------------------------------------------------ writing
def _write_part(path: str, version: Version, leads: DataFrame, replaced: DataFrame | None, keys: DataFrame | None = None) -> None:
    """Add a part to ``version``: ``leads`` (written tables, read several times), ids they replace, and their keys."""
    spark = leads.sparkSession
    number = max([0, *_numbers(spark, path, PART), *version.parts]) + 1
    folder = f"{path}/{PART}{number}"

    def put(rows: DataFrame, name: str, *by: str) -> None:
        if leads.isEmpty():  # no bucket has rows: one with none tells the columns
            rows.limit(0).write.mode("overwrite").parquet(f"{folder}/{name}/bucket=0")
            return
        rows = rows.withColumn("bucket", _bucket(version.buckets, *by))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")

    put(leads, "leads", "lead_id")
    put(match_keys(leads).distinct() if keys is None else keys, "keys", "kind", "key")
    if replaced is not None:
        put(replaced.select("lead_id"), "replaced", "lead_id")
    size = leads.agg(F.count(F.lit(1)).alias("n"), F.max("lead_id").alias("top")).first()
    version.parts[number] = size.n
    version.replaced[number] = 0 if replaced is None else replaced.count()
    version.top = max(version.top, size.top or 0)


def write_leads(leads: DataFrame, path: str, writer: str | None = None, batch: int | None = None, buckets: int = BUCKETS) -> None:
    """Write a whole table in place of the present one, if there is one."""
    spark = leads.sparkSession
    version = newest_version(spark, path) or Version(buckets=buckets)
    version.parts, version.replaced = {}, {}
    rows = cut(leads)
    _write_part(path, version, rows, None)
    drop_cut(rows)
    _close(spark, path, version, writer, batch)


def replace_leads(changed: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Write new rows for some leads; ``created`` (if there) marks those that the table lacks yet."""
    spark = changed.sparkSession
    version = newest_version(spark, path)
    rows = cut(changed)
    before = rows.where(~F.col("created")) if "created" in rows.columns else rows
    if not rows.isEmpty():
        kept = rows.drop(*RUN_ONLY)
        _write_part(path, version, kept, before.select("lead_id"))
    drop_cut(rows)
    merge_parts(spark, path, version)
    _close(spark, path, version, writer, batch)


def _close(spark: SparkSession, path: str, version: Version, writer: str | None, batch: int | None) -> None:
    if writer is not None:
        version.writers[writer] = batch
    _finish(spark, path, version)


def merge_parts(spark: SparkSession, path: str, version: Version, everything: bool = False) -> None:
    """Make one part of those at the end of ``version`` that have grown as large as the one before, or of all of them."""
    numbers = list(version.parts)
    first = len(numbers) - 1
    total = version.parts[numbers[first]]
    while first > 0 and version.parts[numbers[first - 1]] <= 2 * total:
        first -= 1
        total += version.parts[numbers[first]]
    if everything or 2 * sum(version.replaced.values()) > sum(version.parts.values()):
        first = 0
    elif len(numbers) - first < FANOUT:
        return
    chosen = numbers[first:]
    if len(chosen) < 2:
        return
    rows = cut(_live(spark, path, version, chosen))
    replaced, keys = None, None
    for p in chosen:
        if first and version.replaced[p]:
            ids = spark.read.parquet(f"{path}/{PART}{p}/replaced").select("lead_id")
            replaced = ids if replaced is None else replaced.union(ids)
        part = spark.read.parquet(f"{path}/{PART}{p}/keys").select("lead_id", "kind", "key")
        keys = part if keys is None else keys.union(part)
    replaced = None if replaced is None else cut(replaced.distinct())
    _write_part(path, version, rows, replaced, keys.distinct())
    for p in chosen:
        del version.parts[p], version.replaced[p]
    drop_cut(rows, *([] if replaced is None else [replaced]))


def compact(spark: SparkSession, path: str) -> None:
    """Make one part of the whole table."""
    version = newest_version(spark, path)
    merge_parts(spark, path, version, everything=True)
    _finish(spark, path, version)


def folded_batches(spark: SparkSession, path: str) -> dict[str, int]:
    """Last batch that each writer has folded into the table; one row per streaming job."""
    version = newest_version(spark, path)
    return {} if version is None else dict(version.writers)


def fold_into_table(rated: DataFrame, path: str, writer: str | None = None, batch: int | None = None, **options) -> DataFrame:
    """Fold a rated batch into the lead table at ``path`` and return the lead of every sighting.

    Stored leads that hold a key of the batch are looked up and take part; the others are neither read nor
    written. ``writer`` and ``batch`` are recorded with the new version (see ``folded_batches``).
    """
    spark = rated.sparkSession
    version = newest_version(spark, path)
    if version is None:
        leads, placed = fold_batch(rated, **options)
        placed = cut(placed)
        write_leads(leads.drop(*RUN_ONLY), path, writer, batch)
        return placed
    rated = cut(rated.where("outcome <> 'drop'"))
    asked = cut(match_keys(rated, "pos").select("kind", "key").distinct())
    ids = cut(leads_holding(spark, path, asked, version))
    stored = cut(leads_by_id(spark, path, ids, version))
    leads, placed = fold_batch(rated, stored, top=version.top, **options)
    placed = cut(placed)
    replace_leads(leads.where(F.col("created") | (F.col("sightings") > 1)), path, writer, batch)
    drop_cut(rated, asked, ids, stored)
    return placed

"""Source catalogue, its gate, and the registry of extractors."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadloom import rules
from leadloom.functions import text as tx
from leadloom.session import cut

Extractor = Callable[[DataFrame], DataFrame]
_EXTRACTORS: dict[str, Extractor] = {}


def catalogue(spark: SparkSession, sources: dict = rules.SOURCES) -> DataFrame:
    rows = [(key, label, tier, bool(on), flag) for key, (label, tier, on, flag) in sources.items()]
    return spark.createDataFrame(rows, "source string, label string, tier string, enabled boolean, flag string")


def allowed(flags_on: list[str]):
    """Condition on the required flag: none needed, or switched on."""
    return F.col("flag").isNull() | F.col("flag").isin(flags_on or [""])


def available(cat: DataFrame, flags_on: list[str]) -> DataFrame:
    """Enabled sources whose flag permits them."""
    return cat.where(F.col("enabled") & allowed(flags_on))


def requested(cat: DataFrame, wanted: DataFrame, flags_on: list[str]) -> DataFrame:
    """Asked-for sources that exist and are permitted; unknown keys simply drop out."""
    return cat.where(allowed(flags_on)).join(wanted.select("source").distinct(), "source", "left_semi")


def category_table(spark: SparkSession) -> DataFrame:
    """Categories with their keywords as one text."""
    table = tx.lookup({name: ", ".join(words) for name, words in rules.CATEGORIES.items()})
    return spark.range(1).select(F.explode(table).alias("category", "keywords"))


def flag_table(cat: DataFrame, flags_on: list[str]) -> DataFrame:
    """Flags of deferred sources, with a warning column set when any of them is on."""
    flags = cat.where("flag is not null").select("flag", F.col("flag").isin(flags_on or [""]).alias("enabled"))
    return flags.withColumn("warning", F.max("enabled").over(W.partitionBy()))


def register_extractor(key: str) -> Callable[[Extractor], Extractor]:
    """Decorator: make ``fn(pages) -> listings`` available under ``key``."""

    def put(fn: Extractor) -> Extractor:
        _EXTRACTORS[key] = fn
        return fn

    return put


def extractors() -> dict[str, Extractor]:
    return dict(_EXTRACTORS)


def known_sources(keys: list[str] | None = None) -> list[str]:
    """The named sources that have an extractor (all of them by default); others are skipped with a warning."""
    for key in keys or []:
        if key not in _EXTRACTORS:
            warnings.warn(f"unknown source {key!r} skipped", stacklevel=3)
    return [k for k in (keys if keys is not None else _EXTRACTORS) if k in _EXTRACTORS]


def extract_each(pages: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(listings of all named sources, ``source, error`` of those that failed).

    Every source is read by a job of its own and written to the shared folder, so one that fails leaves the
    others' listings whole; ``run_search`` takes both tables.
    """
    from leadloom.operators.qualify import RAW_FIELDS, conform

    spark = pages.sparkSession
    out, failed = None, []
    for key in known_sources(keys):
        try:
            rows = cut(conform(_EXTRACTORS[key](pages.where(F.col("source") == key))))
        except Exception as exc:
            failed.append((key, f"{type(exc).__name__}: {exc}"[:500]))
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        out = conform(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in RAW_FIELDS.items())))
    return out, spark.createDataFrame(failed, "source string, error string")


def extract_all(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Listings of all named sources, each extractor reading only its own source's pages.

    ``pages`` carries ``source``, so a source laid out as a partition is pruned to its files.
    Unknown keys are skipped with a warning.
    """
    from leadloom.operators.qualify import conform

    out = None
    for key in known_sources(keys):
        rows = conform(_EXTRACTORS[key](pages.where(F.col("source") == key)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no known source asked for")
    return out

"""Order-bound row picks: keep first, cap, newest, top, nearest preceding.

Rank filters below are written as ``row_number() <= n``, which Spark turns into a limit per
group before the shuffle, so one busy key sends at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """First row per key in arrival order."""
    return top_per(df, keys, [F.col(order).asc()], 1)


def cap_per_source(df: DataFrame, n: int, order: str = "pos", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """First ``n`` listings of each source (or of each of ``keys``), in arrival order, before any gate."""
    return top_per(df, list(keys), [F.col(order).asc()], n)


def newest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Newest row per key."""
    return top_per(df, keys, [F.col(at).desc(), F.col(tie).desc()], 1)


def pair_with_preceding(links: DataFrame, page: str = "page_id", pos: str = "pos", carried: list[str] | None = None) -> DataFrame:
    """Attach each phone link to the nearest company link before it on the same page.

    ``links`` has ``is_company``, ``is_phone``, ``name``, ``url`` and ``phone``. A company takes
    its first phone only, and a later company replaces one still waiting. A window group is one
    page, which is one input row, so groups are bounded by the page. ``carried`` columns belong to the page.
    """
    in_order = W.partitionBy(page).orderBy(pos)
    islands = links.where(F.col("is_company") | F.col("is_phone")).withColumn(
        "_island", F.sum(F.col("is_company").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    )
    return (
        islands.where(F.col("_island") > 0)
        .groupBy(page, "_island")
        .agg(
            F.max(F.when(F.col("is_company"), F.struct(pos, "name", "url"))).alias("company"),
            F.min_by("phone", F.when(F.col("is_phone"), F.col(pos))).alias("phone_raw"),
            *[F.max(c).alias(c) for c in carried or []],
        )
        .where(F.col("phone_raw").isNotNull())
        .select(
            page,
            F.col(f"company.{pos}").alias(pos),
            F.col("company.name").alias("company_name"),
            F.col("company.url").alias("source_url"),
            "phone_raw",
            *(carried or []),
        )
    )

"""Search plan: request matrix, rotating daily slice, request de-duplication.

The matrix comes from rule lists, so its size is fixed by the configuration. It is generated
from array literals on one row; nothing is joined crosswise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions.intel import search_text
from leadloom.functions.text import lookup, words

SUB_LIST = "\u0003"
Request = tuple[str | None, str | None, str | None]


def plan_requests(plan: dict = rules.PLAN) -> list[Request]:
    """(category, role, place) of the whole plan: categories by role by place, then the role-less ones."""
    with_role = [(c, r, p) for c in plan["categories"] for r in plan["roles"] for p in plan["places"]]
    return with_role + [(c, None, p) for c in plan["roleless_categories"] for p in plan["places"]]


def plan_size(plan: dict = rules.PLAN) -> int:
    per_place = len(plan["categories"]) * len(plan["roles"]) + len(plan["roleless_categories"])
    return per_place * len(plan["places"])


def matrix(spark: SparkSession, plan: dict = rules.PLAN) -> DataFrame:
    """Plan as a table with its running index."""
    one = spark.range(1)
    lists = {k: words(plan[k]) for k in ("categories", "roles", "places", "roleless_categories")}
    n_roles, n_places = len(plan["roles"]), len(plan["places"])
    with_role = (
        one.select(F.posexplode(lists["categories"]).alias("i", "category"))
        .select("*", F.posexplode(lists["roles"]).alias("j", "role"))
        .select("*", F.posexplode(lists["places"]).alias("k", "place"))
        .select(((F.col("i") * n_roles + F.col("j")) * n_places + F.col("k")).alias("idx"), "category", "role", "place")
    )
    offset = len(plan["categories"]) * n_roles * n_places
    without = (
        one.select(F.posexplode(lists["roleless_categories"]).alias("i", "category"))
        .select("*", F.posexplode(lists["places"]).alias("k", "place"))
        .select((F.lit(offset) + F.col("i") * n_places + F.col("k")).alias("idx"), "category", F.lit(None).cast("string").alias("role"), "place")
    )
    return with_role.unionByName(without).withColumn("country", F.lit(plan["country"]))


def days_per_sweep(size: int, limit: int) -> int:
    return math.ceil(size / limit) if 0 < limit < size else 1


def in_daily_slice(idx: Column, day: Column, size: int, limit: int) -> Column:
    """True when request ``idx`` is due on day number ``day`` of the rotation."""
    if not 0 < limit < size:
        return F.lit(True)
    start = F.pmod(day, F.lit(days_per_sweep(size, limit))) * limit
    return (idx >= start) & (idx < start + limit)


def slice_of(idx: Column, size: int, limit: int) -> Column:
    """Rotation day on which request ``idx`` is due."""
    return F.floor(idx / limit) if 0 < limit < size else F.lit(0)


def with_query(requests: DataFrame) -> DataFrame:
    return requests.withColumn(
        "query", search_text(F.col("category"), F.col("role"), F.col("place"), F.col("country"))
    )


def distinct_requests(requests: DataFrame) -> DataFrame:
    """First request of each search text."""
    firsts = requests.groupBy("query").agg(F.min_by(F.struct(*requests.columns), "idx").alias("r"))
    return firsts.select("r.*")


def daily_requests(spark: SparkSession, day: int, plan: dict = rules.PLAN, limit: int | None = None) -> DataFrame:
    limit = plan["daily_limit"] if limit is None else limit
    due = matrix(spark, plan).where(in_daily_slice(F.col("idx"), F.lit(day), plan_size(plan), limit))
    return distinct_requests(with_query(due))


def interactive_requests(
    spark: SparkSession, countries: list[str], places: list[str], categories: list[str], roles: list[str]
) -> DataFrame:
    """Product of the chosen fields, a blank field standing for "any"; too many are refused."""
    fields = {"country": countries or [rules.DEFAULT_COUNTRY], "place": places or [None],
              "category": categories or [None], "role": roles or [None]}
    size = math.prod(len(v) for v in fields.values())
    if size > rules.INTERACTIVE_LIMIT:
        raise ValueError(f"{size} combinations asked, at most {rules.INTERACTIVE_LIMIT} allowed")
    out = spark.range(1)
    for name, values in fields.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast("string") for v in values])))
    return out.drop("id")


def keywords_of(df: DataFrame, category: str = "category") -> DataFrame:
    """Add the keyword list of the category, empty for an unknown one."""
    table = lookup({c: SUB_LIST.join(w) for c, w in rules.CATEGORIES.items()})
    found = F.split(F.try_element_at(table, F.col(category)), SUB_LIST)
    return df.withColumn("keywords", F.coalesce(found, F.array().cast("array<string>")))


def category_rule(name: Column, keywords: Column) -> Column:
    """New category rule from a name and a comma-separated keyword text."""
    words = F.filter(F.transform(F.split(keywords, ","), lambda w: F.trim(w)), lambda w: w != "")
    return F.struct(F.trim(name).alias("name"), words.alias("keywords"))

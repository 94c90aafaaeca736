"""Queries of the search plan, joined with the listings and requests the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.plans import matrix as mx
from leadloom.plans.run import swept_listings
from leadloom.queries import sqltext as s
from leadloom.queries.base import RAW_SQL, processed_events, raw_listings, table
from leadloom.sources import catalogue as cat

PLAN = rules.PLAN
SIZE = mx.plan_size()
LIMIT = PLAN["daily_limit"]
FLAGS_ON = ["FEATURE_LINKEDIN"]
KEYS = [*rules.SOURCES, "nobody", "noone"]


SWEEP = {**PLAN, "max_results_per_source": 3, "council_sources": ["src0"], "directory_sources": ["src1", "src2", "src3"]}
SWEEP_DAY = 1  # requests 12 to 23


def daily_sweep(spark, d):
    """Listings that a day's run takes: council members, and directory rows by the request they answer, not by their own category or city."""
    rows = raw_listings(spark, d).withColumn("request_no", F.when(F.col("source") != "src0", F.col("pos") % 40))
    return swept_listings(rows, SWEEP_DAY, SWEEP).select("pos", "source", "request_no", "city", "category")


def placed_listings(spark, d) -> DataFrame:
    """Listings with the plan's place: companies are spread over the places by number."""
    places = F.split(F.lit("|".join(PLAN["places"])), r"\|")
    return raw_listings(spark, d).select("pos", "category", F.get(places, (F.floor(F.col("pos") / 3) % len(PLAN["places"])).cast("int")).alias("place"))


def plan_yield(spark, d):
    """Requests of the plan with the listings each one would find, and its day of the rotation."""
    found = placed_listings(spark, d).groupBy("category", "place").agg(F.count(F.lit(1)).alias("listings"))
    rows = mx.with_query(mx.matrix(spark)).join(found, ["category", "place"], "left")
    return rows.select("idx", "category", "role", "place", "query", mx.slice_of(F.col("idx"), SIZE, LIMIT).alias("day"), F.coalesce("listings", F.lit(0)).alias("listings"))


def requests_due(spark, d):
    """Requests due on each day that has events, with that day's events as workload."""
    days = processed_events(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("events"))
    days = days.withColumn("slice", F.pmod(F.unix_date("day"), F.lit(mx.days_per_sweep(SIZE, LIMIT))).cast("bigint"))
    plan = mx.matrix(spark).withColumn("slice", mx.slice_of(F.col("idx"), SIZE, LIMIT))
    return days.join(plan, "slice").where(mx.in_daily_slice(F.col("idx"), F.unix_date("day"), SIZE, LIMIT)).select("day", "events", "idx", "category", "role", "place")


def logged_requests(spark, d) -> DataFrame:
    """Every event as one search request."""
    return table(spark, d, "events").selectExpr(
        "event_id AS idx",
        "CASE user_id % 4 WHEN 0 THEN 'Cosmetics' WHEN 1 THEN 'Textiles' WHEN 2 THEN 'Food Suppliers' END AS category",
        "CASE event_id % 5 WHEN 0 THEN 'Manufacturer' WHEN 1 THEN 'Factory' WHEN 2 THEN 'Agent' WHEN 3 THEN 'Importer' END AS role",
        "CASE WHEN user_id % 7 > 0 THEN concat('City', user_id % 7) END AS place", "IF(user_id % 9 = 0, '', 'Egypt') AS country",
    )


def request_texts(spark, d):
    return mx.with_query(logged_requests(spark, d)).select("idx", "query")


def distinct_requests(spark, d):
    return mx.distinct_requests(mx.with_query(logged_requests(spark, d))).select("idx", "query", "category", "place")


def interactive_matrix(spark, d):
    """Chosen combinations with the listings on file for each; an empty field means any."""
    asked = mx.interactive_requests(spark, ["Egypt"], ["Cairo", "Giza", "Port Said"], ["Furniture", "Home Appliances"], [])
    found = placed_listings(spark, d).groupBy("category", "place").agg(F.count(F.lit(1)).alias("listings"))
    return asked.join(found, ["category", "place"], "left").select("country", "place", "category", "role", F.coalesce("listings", F.lit(0)).alias("listings"))


def asked_keys(spark, d) -> DataFrame:
    keys = F.split(F.lit("|".join(KEYS)), r"\|")
    return table(spark, d, "events").select(F.get(keys, (F.col("user_id") % len(KEYS)).cast("int")).alias("source"))


def source_gate(spark, d):
    """Permitted sources among those asked for; unknown keys drop out."""
    rows = cat.requested(cat.catalogue(spark), asked_keys(spark, d), FLAGS_ON)
    return rows.select("source", "tier", "enabled", "flag")


def source_demand(spark, d):
    """Requests per available source."""
    shown = cat.available(cat.catalogue(spark), FLAGS_ON)
    return asked_keys(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("requests")).join(shown, "source").select("source", "label", "requests")


def category_view(spark, d):
    """Categories with their keywords and the listings on file."""
    n = raw_listings(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("listings"))
    return cat.category_table(spark).join(n, "category", "left").select("category", "keywords", F.coalesce("listings", F.lit(0)).alias("listings"))


def flag_view(spark, d):
    """Flags of deferred sources with the requests that wait behind each."""
    n = asked_keys(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("requests"))
    flags = cat.flag_table(cat.catalogue(spark), FLAGS_ON).join(cat.catalogue(spark).select("flag", "source"), "flag")
    return flags.join(n, "source", "left").select("flag", "enabled", "warning", F.coalesce("requests", F.lit(0)).alias("requests"))


def category_rules(spark, d):
    """New category rules from names and comma-separated keyword texts."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat(' ', p_brand, ' ') AS name", "concat(replace(p_name, ' ', ' , '), ',, ', lower(p_type), ' ') AS keywords")
    rows = rows.select("p_partkey", mx.category_rule(F.col("name"), F.col("keywords")).alias("r"))
    return rows.select("p_partkey", F.col("r.name").alias("name"), F.array_join("r.keywords", "|").alias("keywords"))


def _matrix_sql() -> str:
    arrays = {k: "[" + ", ".join(s.q(v) for v in PLAN[k]) + "]" for k in ("categories", "roles", "places", "roleless_categories")}
    return f"""m AS (SELECT ((i * {len(PLAN['roles'])} + j) * {len(PLAN['places'])} + k) AS idx, {arrays['categories']}[i + 1] AS category, {arrays['roles']}[j + 1] AS role, {arrays['places']}[k + 1] AS place
      FROM range({len(PLAN['categories'])}) a(i), range({len(PLAN['roles'])}) b(j), range({len(PLAN['places'])}) c(k)
      UNION ALL SELECT {len(PLAN['categories']) * len(PLAN['roles']) * len(PLAN['places'])} + i * {len(PLAN['places'])} + k, {arrays['roleless_categories']}[i + 1], NULL, {arrays['places']}[k + 1]
      FROM range({len(PLAN['roleless_categories'])}) a(i), range({len(PLAN['places'])}) c(k))"""


PLACES_SQL = "[" + ", ".join(s.q(v) for v in PLAN["places"]) + "]"
FOUND_SQL = f"fo AS (SELECT category, {PLACES_SQL}[CAST((pos // 3) % {len(PLAN['places'])} + 1 AS INT)] AS place, count(*) AS listings FROM raw GROUP BY 1, 2)"
ROLE_CASE = "CASE role " + " ".join(f"WHEN {s.q(k)} THEN {s.q(v)}" for k, v in rules.ROLE_WORDS.items()) + " ELSE lower(role) END"
QUERY_SQL = f"trim(coalesce(nullif(concat_ws(' ', nullif(category, ''), nullif({ROLE_CASE}, '')), ''), 'companies') || CASE WHEN coalesce(place, '') <> '' THEN ' in ' || place ELSE '' END || CASE WHEN country <> '' THEN ' ' || country ELSE '' END)"
LOG_SQL = """lg AS (SELECT event_id AS idx, CASE user_id % 4 WHEN 0 THEN 'Cosmetics' WHEN 1 THEN 'Textiles' WHEN 2 THEN 'Food Suppliers' END AS category,
  CASE event_id % 5 WHEN 0 THEN 'Manufacturer' WHEN 1 THEN 'Factory' WHEN 2 THEN 'Agent' WHEN 3 THEN 'Importer' END AS role,
  CASE WHEN user_id % 7 > 0 THEN 'City' || (user_id % 7) END AS place, CASE WHEN user_id % 9 = 0 THEN '' ELSE 'Egypt' END AS country FROM events)"""
CATALOGUE_SQL = "ct AS (SELECT * FROM (VALUES " + ", ".join(
    f"({s.q(k)}, {s.q(v[0])}, {s.q(v[1])}, {str(v[2]).lower()}, {s.q(v[3]) if v[3] else 'NULL'})" for k, v in rules.SOURCES.items()
) + ") v(source, label, tier, enabled, flag))"
ASKED_SQL = f"ak AS (SELECT {'[' + ', '.join(s.q(k) for k in KEYS) + ']'}[CAST(user_id % {len(KEYS)} + 1 AS INT)] AS source FROM events)"
OPEN_SQL = f"(flag IS NULL OR flag IN {s.in_list(FLAGS_ON)})"

QUERIES = {
    "daily_sweep": (daily_sweep, f"""WITH {RAW_SQL}, lr AS (SELECT *, CASE WHEN source <> 'src0' THEN pos % 40 END AS request_no FROM raw),
        tk AS (SELECT * FROM lr WHERE source = 'src0' OR source IN ('src1', 'src2', 'src3') AND request_no BETWEEN {LIMIT * SWEEP_DAY} AND {LIMIT * SWEEP_DAY + LIMIT - 1})
        SELECT pos, source, request_no, city, category FROM tk QUALIFY row_number() OVER (PARTITION BY request_no, source ORDER BY pos) <= 3"""),
    "plan_yield": (plan_yield, f"WITH {RAW_SQL}, {_matrix_sql()}, {FOUND_SQL}, mc AS (SELECT *, 'Egypt' AS country FROM m) SELECT idx, category, role, place, {QUERY_SQL} AS query, idx // {LIMIT} AS day, coalesce(listings, 0) AS listings FROM mc LEFT JOIN fo USING (category, place)"),
    "requests_due": (requests_due, f"WITH {_matrix_sql()}, dy AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1) SELECT day, events, idx, category, role, place FROM dy JOIN m ON idx // {LIMIT} = date_diff('day', DATE '1970-01-01', day) % {mx.days_per_sweep(SIZE, LIMIT)}"),
    "request_texts": (request_texts, f"WITH {LOG_SQL} SELECT idx, {QUERY_SQL} AS query FROM lg"),
    "distinct_requests": (distinct_requests, f"WITH {LOG_SQL}, t AS (SELECT *, {QUERY_SQL} AS query FROM lg) SELECT idx, query, category, place FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY idx) = 1"),
    "interactive_matrix": (interactive_matrix, f"WITH {RAW_SQL}, {FOUND_SQL}, mc AS (SELECT unnest(['Cairo', 'Giza', 'Port Said']) AS place, c AS category FROM (SELECT unnest(['Furniture', 'Home Appliances']) AS c)) SELECT 'Egypt' AS country, place, category, CAST(NULL AS VARCHAR) AS role, coalesce(listings, 0) AS listings FROM mc LEFT JOIN fo USING (category, place)"),
    "source_gate": (source_gate, f"WITH {CATALOGUE_SQL}, {ASKED_SQL} SELECT source, tier, enabled, flag FROM ct WHERE {OPEN_SQL} AND source IN (SELECT source FROM ak)"),
    "source_demand": (source_demand, f"WITH {CATALOGUE_SQL}, {ASKED_SQL} SELECT source, label, count(*) AS requests FROM ak JOIN ct USING (source) WHERE enabled AND {OPEN_SQL} GROUP BY ALL"),
    "category_view": (category_view, f"WITH {RAW_SQL}, ca AS (SELECT * FROM (VALUES " + ", ".join(f"({s.q(c)}, {s.q(', '.join(w))})" for c, w in rules.CATEGORIES.items()) + ") v(category, keywords)) SELECT category, keywords, (SELECT count(*) FROM raw WHERE raw.category = ca.category) AS listings FROM ca"),
    "flag_view": (flag_view, f"WITH {CATALOGUE_SQL}, {ASKED_SQL} SELECT flag, flag IN {s.in_list(FLAGS_ON)} AS enabled, true AS warning, (SELECT count(*) FROM ak WHERE ak.source = ct.source) AS requests FROM ct WHERE flag IS NOT NULL"),
    "category_rules": (category_rules, "SELECT p_partkey, p_brand AS name, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ') || ',, ' || lower(p_type) || ' ', ','), lambda w: trim(w)), lambda w: w <> ''), '|') AS keywords FROM part"),
}

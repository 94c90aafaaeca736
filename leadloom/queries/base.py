"""Inputs of the registered queries: the given tables, and listings derived from them.

The tables hold no companies, so listings are derived from ``customer`` (with the latest order
of each), three sightings per company; sales-stage rows from ``orders``; run records from
``events``. The same rules are given as SQL for the checks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules

AS_OF = dt.date(2001, 8, 2)
CUTOFF_YEAR = 1999
FILTERS = {**rules.FILTERS, "activity": {"enabled": True, "drop_if_year_at_or_before": CUTOFF_YEAR}}

DESCRIPTIONS = [
    "We export ready-made goods to the GCC and Europe. International shipping on request.",
    "Importer of raw material from China and India, customs handled in house.",
    "Our factory runs a production line and offers delivery in Cairo.",
    "Licensed freight forwarder with customs clearance and bill of lading service.",
    "Online store: add to cart and checkout today, delivery across Egypt.",
    "Digital marketing and advertising consultancy for small firms.",
    "A family business since 1980.",
    None,
]
SEGMENT_CATEGORY = {
    "FURNITURE": "Furniture", "MACHINERY": "Engineering Industries", "AUTOMOBILE": "Import & Export",
    "BUILDING": "Freight Forwarder", "HOUSEHOLD": "Home Appliances",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over two tasks for each core, by ``keys`` where some are named, else evenly.

    A table's file may be one row group, which a single task reads. Listings and pages are built from a few short columns, and
    reading them costs far more than their bytes tell, so these columns are dealt out before anything is built from them.
    The number is given, else Spark would join the small parts again; it is low, as every task unpacks the long expressions anew.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def txt(c: Column) -> Column:
    return c.cast("string")


def pad(c: Column, n: int) -> Column:
    return F.lpad(txt(c), n, "0")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings, ``pos`` = customer key = order of arrival."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    c = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = spread(c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "latest")).selectExpr("*", "c_custkey AS k", "c_custkey div 3 AS e").selectExpr(
        "*", "CASE WHEN e % 50 = 0 AND k % 3 = 2 THEN e + 1 ELSE e END AS d",
        "lpad(string(e), 8, '0') AS e8",
    )
    sentences = " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(DESCRIPTIONS))
    segments = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SEGMENT_CATEGORY.items())
    return c.selectExpr(
        "k AS pos",
        "CASE WHEN k % 53 = 0 THEN '' WHEN k % 47 = 0 THEN '--' ELSE concat('  Company  ', e, ' & Co! ') END AS company_name",
        "concat('src', c_nationkey % 5) AS source",
        "concat('https://directory.example/c/', k) AS source_url",
        "CASE WHEN k % 3 = 2 AND e % 4 = 0 THEN NULL WHEN e % 6 = 1 THEN concat('010', e8) WHEN e % 6 = 2 THEN concat('+20 11 ', e8) "
        "WHEN e % 6 = 3 THEN concat('0020 12', e8) WHEN e % 6 = 4 THEN '123' WHEN e % 6 = 5 THEN concat('02 2', lpad(string(e), 7, '0')) END AS phone_raw",
        "IF(k % 6 = 0, array(concat('012', lpad(string(k), 8, '0')), 'call us'), cast(array() AS array<string>)) AS extra_phones",
        "CASE k % 7 WHEN 0 THEN concat('INFO@SITE', d, '.NET') WHEN 1 THEN concat('%20info@site', d, '.net') "
        "WHEN 2 THEN concat('sales@site', d, '.com.com') WHEN 3 THEN concat('cs@site', d, '.org | info@site', d, '.net') "
        "WHEN 4 THEN concat('noreply@site', d, '.net') END AS email",
        "CASE k % 5 WHEN 1 THEN concat('www.Site', d, '.example') WHEN 2 THEN concat('https://www.site', d, '.example/p?x=1') "
        "WHEN 3 THEN concat('HTTP://site', d, '.example:8080/') END AS website",
        "CASE WHEN k % 4 <> 0 THEN concat('Street ', k % 17, ', City', e % 9, ', Gov', e % 3, '.') END AS address",
        "CASE WHEN k % 11 <> 0 THEN concat('City', e % 9) END AS city",
        "CASE WHEN k % 3 = 0 THEN concat('Gov', e % 3) END AS governorate",
        "CASE WHEN k % 13 <> 0 THEN 'Egypt' END AS country",
        f"CASE c_mktsegment {segments} END AS category",
        f"CASE k % 8 {sentences} END AS description",
        "CASE k % 10 WHEN 0 THEN map('facebook', concat('https://facebook.com/site', d)) "
        "WHEN 5 THEN map('linkedin', concat('https://linkedin.com/company/site', d, '-', k % 3)) "
        "WHEN 7 THEN map('whatsapp', concat('https://wa.me/2010', e8)) ELSE cast(map() AS map<string,string>) END AS social_links",
        "CASE WHEN k % 9 <> 0 THEN int(c_acctbal) END AS followers",
        "date(latest) AS last_activity_date",
        "CASE WHEN k % 2 = 0 THEN (k % 50) / double(10) END AS rating",
        "int(k % 4) AS branches",
        "cast(NULL AS boolean) AS has_online_store",
    )


def _case(key: str, pairs: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs.items()) + " END"


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


RAW_SQL = f"""
raw0 AS (
  SELECT c.*, o.latest, c_custkey AS k, c_custkey // 3 AS e,
    CASE WHEN (c_custkey // 3) % 50 = 0 AND c_custkey % 3 = 2 THEN c_custkey // 3 + 1 ELSE c_custkey // 3 END AS d
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) o ON c_custkey = o_custkey),
raw AS (
  SELECT k AS pos, e, d,
    CASE WHEN k % 53 = 0 THEN '' WHEN k % 47 = 0 THEN '--' ELSE '  Company  ' || e || ' & Co! ' END AS company_name,
    'src' || (c_nationkey % 5) AS source,
    'https://directory.example/c/' || k AS source_url,
    CASE WHEN k % 3 = 2 AND e % 4 = 0 THEN NULL WHEN e % 6 = 1 THEN '010' || lpad(e::VARCHAR, 8, '0')
      WHEN e % 6 = 2 THEN '+20 11 ' || lpad(e::VARCHAR, 8, '0') WHEN e % 6 = 3 THEN '0020 12' || lpad(e::VARCHAR, 8, '0')
      WHEN e % 6 = 4 THEN '123' WHEN e % 6 = 5 THEN '02 2' || lpad(e::VARCHAR, 7, '0') END AS phone_raw,
    CASE WHEN k % 6 = 0 THEN ['012' || lpad(k::VARCHAR, 8, '0'), 'call us'] ELSE [] END AS extra_raw,
    CASE k % 7 WHEN 0 THEN 'INFO@SITE' || d || '.NET' WHEN 1 THEN '%20info@site' || d || '.net'
      WHEN 2 THEN 'sales@site' || d || '.com.com' WHEN 3 THEN 'cs@site' || d || '.org | info@site' || d || '.net'
      WHEN 4 THEN 'noreply@site' || d || '.net' END AS email_raw,
    CASE k % 5 WHEN 1 THEN 'www.Site' || d || '.example' WHEN 2 THEN 'https://www.site' || d || '.example/p?x=1'
      WHEN 3 THEN 'HTTP://site' || d || '.example:8080/' END AS website_raw,
    CASE WHEN k % 4 <> 0 THEN 'Street ' || (k % 17) || ', City' || (e % 9) || ', Gov' || (e % 3) || '.' END AS address,
    CASE WHEN k % 11 <> 0 THEN 'City' || (e % 9) END AS city,
    CASE WHEN k % 3 = 0 THEN 'Gov' || (e % 3) END AS governorate,
    CASE WHEN k % 13 <> 0 THEN 'Egypt' END AS country_raw,
    {_case("c_mktsegment", {_quoted(a): _quoted(b) for a, b in SEGMENT_CATEGORY.items()})} AS category,
    {_case("k % 8", {i: _quoted(s) for i, s in enumerate(DESCRIPTIONS)})} AS description,
    CASE WHEN k % 10 = 0 THEN 'https://facebook.com/site' || d END AS facebook,
    CASE WHEN k % 10 = 5 THEN 'https://linkedin.com/company/site' || d || '-' || (k % 3) END AS linkedin,
    CASE WHEN k % 10 = 7 THEN 'https://wa.me/2010' || lpad(e::VARCHAR, 8, '0') END AS whatsapp_link,
    CASE WHEN k % 9 <> 0 THEN trunc(c_acctbal)::INT END AS followers,
    latest::DATE AS last_activity_date,
    CASE WHEN k % 2 = 0 THEN (k % 50) / 10.0 END AS rating,
    (k % 4)::INT AS branches
  FROM raw0)"""


def norm_sql() -> str:
    """CTE ``norm``: normalized and classified listings with blank enrichment columns."""
    from leadloom.queries import sqltext as s

    low = "lower(coalesce(description, ''))"
    return f"""{RAW_SQL},
norm0 AS (
  SELECT pos, e, d, trim(company_name) AS company_name, {s.name_key('company_name')} AS company_name_norm, source, source_url,
    phone_raw, {s.valid_phones("list_concat(CASE WHEN phone_raw IS NULL THEN [] ELSE [phone_raw] END, extra_raw)")} AS phones,
    {s.cell_email('email_raw')} AS email,
    CASE WHEN website_raw IS NOT NULL AND NOT contains(website_raw, '://') THEN 'https://' || website_raw ELSE website_raw END AS website,
    {s.domain('website_raw')} AS domain, address, city, governorate, coalesce(country_raw, 'Egypt') AS country, category, description,
    facebook, linkedin, whatsapp_link, followers, last_activity_date, rating, branches,
    {s.company_type(low, 'category')} AS company_type,
    CASE WHEN {s.has_store(low)} THEN true END AS has_online_store
  FROM raw),
norm AS (
  SELECT *, phones[1] AS phone_e164, phones[2:] AS extra_phones, {s.intent(low, 'company_type')} AS shipping_intent,
    CAST(NULL AS VARCHAR) AS store_platform, CAST(NULL AS VARCHAR[]) AS target_markets, CAST(NULL AS VARCHAR) AS contact_name,
    CAST(NULL AS VARCHAR) AS contact_role, category AS product_type, false AS enriched
  FROM norm0)"""


def rate_sql(source: str = "norm", out: str = "rated") -> str:
    """CTE ``rated`` (or ``out``) on top of a CTE shaped like ``norm``."""
    from leadloom.queries import sqltext as s

    parts = s.band_parts()
    return f"""
{out}0 AS (SELECT *, {s.invalid_reason()} AS broken, {s.filter_reason(CUTOFF_YEAR, 1000)} AS poor, {s.segment()} AS segment FROM {source}),
{out}1 AS (SELECT *, CASE WHEN broken IS NOT NULL THEN 'quarantine' WHEN poor IS NOT NULL THEN 'drop' ELSE 'keep' END AS outcome,
    coalesce(broken, poor) AS reason, {s.band()} AS band FROM {out}0),
{out} AS (SELECT * EXCLUDE (segment), CASE WHEN outcome = 'keep' THEN segment END AS segment,
    CASE WHEN outcome = 'keep' THEN {s.score_of(parts)} ELSE 0 END AS score,
    CASE WHEN outcome = 'keep' THEN {s.tier(s.score_of(parts), rules.SCORING['tiers'])} ELSE 'Weak' END AS tier,
    CASE WHEN outcome = 'keep' THEN {s.reasons_of(parts)} ELSE '' END AS reasons FROM {out}1)"""


def rated_sql() -> str:
    return f"WITH {norm_sql()},{rate_sql()}\n"


def reasons_plain(c: str = "score_reasons") -> Column:
    """Breakdown as text ``factor=points`` for comparing."""
    return F.array_join(F.transform(c, lambda r: F.concat(r["factor"], F.lit("="), txt(r["points"]))), ",")


# ------------------------------------------------------------------ sales-stage rows
TYPES = ["Manufacturer", "Exporter", "Importer", "Distributor", "Unknown", "Freight Forwarder"]
PEOPLE = ["Amr Adel", "Mona", "Sara (team B)"]


def crm_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored leads as the sales team sees them, one per order."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "*", "o_orderkey AS k", "o_custkey AS c", "int(left(o_orderpriority, 1)) AS u", "lpad(string(o_custkey), 8, '0') AS c8",
        "int(least(floor(o_totalprice / 5000), 100)) AS score",
        "concat('src', o_custkey % 5) AS source",
    )
    kinds = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))
    people = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PEOPLE))
    rows = o.selectExpr(
        "k AS lead_id", "concat('Company ', c, IF(c % 5 = 0, ' Trading', ' Co')) AS company_name", "concat('company ', c) AS company_name_norm",
        "CASE WHEN k % 3 <> 0 THEN concat('+2010', c8) END AS phone_e164",
        "CASE WHEN k % 5 <> 0 THEN concat('site', c, '.example') END AS domain",
        "CASE WHEN k % 5 <> 0 THEN concat('https://site', c, '.example') END AS website",
        "CASE WHEN k % 4 <> 0 THEN concat('Buyer', c, '@Mail.net') END AS email",
        "CASE WHEN k % 6 <> 0 THEN concat('City', c % 9) END AS city", "'Egypt' AS country",
        "CASE WHEN k % 8 <> 0 THEN concat('Street ', k % 99) END AS address",
        "CASE WHEN k % 10 <> 0 THEN 'Furniture' END AS category",
        f"CASE k % 7 {kinds} END AS company_type",
        "CASE WHEN k % 6 <> 0 THEN int(k % 101) END AS shipping_intent", "score",
        "CASE WHEN score >= 65 THEN 'Hot' WHEN score >= 40 THEN 'Medium' ELSE 'Weak' END AS tier",
        "array(named_struct('factor', 'band:trader', 'points', 52), named_struct('factor', IF(k % 2 = 0, 'has_phone', 'extra_rule'), 'points', 6)) AS score_reasons",
        "CASE WHEN o_orderstatus = 'F' AND u <= 2 THEN 'won' WHEN o_orderstatus = 'F' AND u = 3 THEN 'lost' "
        "WHEN o_orderstatus = 'F' AND u = 4 THEN 'negotiation' WHEN o_orderstatus = 'F' THEN 'quotation_sent' "
        "WHEN o_orderstatus = 'O' AND u = 1 THEN 'interested' WHEN o_orderstatus = 'O' AND u = 2 THEN 'contacted' "
        "WHEN o_orderstatus = 'P' AND u = 1 THEN 'quarantined' ELSE 'new' END AS status",
        f"CASE c % 4 {people} END AS assigned_to", "cast(NULL AS string) AS notes", "cast(NULL AS date) AS last_contact_date",
        "CASE WHEN k % 4 <> 0 THEN date_add(date(o_orderdate), int(k % 20)) END AS next_followup_date", "source",
        "IF(k % 3 = 0, array_sort(array_distinct(array(source, 'src0'))), cast(array() AS array<string>)) AS sources_seen",
        "concat('https://directory.example/o/', k) AS source_url",
        "IF(k % 5 = 0, array(concat('+2011', c8), '+20222222222'), cast(array() AS array<string>)) AS extra_phones",
        "CASE WHEN k % 9 = 0 THEN array('GCC', 'Europe') END AS target_markets",
        "IF(k % 9 = 0, map('whatsapp', concat('https://wa.me/2010', c8)), cast(map() AS map<string,string>)) AS social_links",
        "CASE WHEN k % 7 = 0 THEN concat('facebook.com/c', c) END AS facebook",
        "CASE WHEN k % 7 = 1 THEN concat('https://linkedin.com/company/c', c) END AS linkedin",
        "CASE WHEN k % 2 = 0 THEN 'P1' END AS segment", "'Furniture' AS product_type",
        "CASE WHEN k % 11 = 0 THEN 'Shopify' END AS store_platform", "cast(NULL AS string) AS contact_name",
        "CASE WHEN k % 13 = 0 THEN 'Export Manager' END AS contact_role", "cast(NULL AS string) AS contact_email",
        "k % 17 = 0 AS pushed_to_sheet", "cast(NULL AS timestamp_ntz) AS sheet_synced_at", "cast(o_orderdate AS timestamp_ntz) AS updated_at",
    )
    return rows.withColumn("quarantine_reason", F.when(F.col("status") == rules.QUARANTINED, "no_contact"))


CRM_SQL = f"""
crm0 AS (SELECT *, o_orderkey AS k, o_custkey AS c, CAST(left(o_orderpriority, 1) AS INT) AS u,
    CAST(least(floor(o_totalprice / 5000), 100) AS INT) AS sc FROM orders),
crm AS (SELECT k AS lead_id, 'Company ' || c || CASE WHEN c % 5 = 0 THEN ' Trading' ELSE ' Co' END AS company_name,
    CASE WHEN k % 3 <> 0 THEN '+2010' || lpad(c::VARCHAR, 8, '0') END AS phone_e164,
    CASE WHEN k % 5 <> 0 THEN 'site' || c || '.example' END AS domain,
    CASE WHEN k % 5 <> 0 THEN 'https://site' || c || '.example' END AS website,
    CASE WHEN k % 4 <> 0 THEN 'Buyer' || c || '@Mail.net' END AS email,
    CASE WHEN k % 6 <> 0 THEN 'City' || (c % 9) END AS city, 'Egypt' AS country,
    CASE WHEN k % 8 <> 0 THEN 'Street ' || (k % 99) END AS address,
    CASE WHEN k % 10 <> 0 THEN 'Furniture' END AS category,
    {_case("k % 7", {i: _quoted(t) for i, t in enumerate(TYPES)})} AS company_type,
    CASE WHEN k % 6 <> 0 THEN CAST(k % 101 AS INT) END AS shipping_intent, sc AS score,
    CASE WHEN sc >= 65 THEN 'Hot' WHEN sc >= 40 THEN 'Medium' ELSE 'Weak' END AS tier,
    CASE WHEN k % 2 = 0 THEN 'has_phone' ELSE 'extra_rule' END AS second_factor,
    CASE WHEN o_orderstatus = 'F' AND u <= 2 THEN 'won' WHEN o_orderstatus = 'F' AND u = 3 THEN 'lost'
      WHEN o_orderstatus = 'F' AND u = 4 THEN 'negotiation' WHEN o_orderstatus = 'F' THEN 'quotation_sent'
      WHEN o_orderstatus = 'O' AND u = 1 THEN 'interested' WHEN o_orderstatus = 'O' AND u = 2 THEN 'contacted'
      WHEN o_orderstatus = 'P' AND u = 1 THEN 'quarantined' ELSE 'new' END AS status,
    {_case("c % 4", {i: _quoted(t) for i, t in enumerate(PEOPLE)})} AS assigned_to,
    CASE WHEN k % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(k % 20 AS INT) AS DATE) END AS next_followup_date,
    'src' || (c % 5) AS source,
    CASE WHEN k % 3 = 0 THEN CASE WHEN c % 5 = 0 THEN ['src0'] ELSE ['src0', 'src' || (c % 5)] END ELSE [] END AS sources_seen,
    'https://directory.example/o/' || k AS source_url,
    CASE WHEN k % 5 = 0 THEN ['+2011' || lpad(c::VARCHAR, 8, '0'), '+20222222222'] ELSE [] END AS extra_phones,
    CASE WHEN k % 9 = 0 THEN ['GCC', 'Europe'] END AS target_markets,
    CASE WHEN k % 9 = 0 THEN '2010' || lpad(c::VARCHAR, 8, '0') END AS whatsapp,
    CASE WHEN k % 7 = 0 THEN 'facebook.com/c' || c END AS facebook,
    CASE WHEN k % 7 = 1 THEN 'https://linkedin.com/company/c' || c END AS linkedin,
    CASE WHEN k % 2 = 0 THEN 'P1' END AS segment, 'Furniture' AS product_type,
    CASE WHEN k % 11 = 0 THEN 'Shopify' END AS store_platform,
    CASE WHEN k % 13 = 0 THEN 'Export Manager' END AS contact_role,
    k % 17 = 0 AS pushed_to_sheet, o_orderdate AS updated_at FROM crm0)"""


# ------------------------------------------------------------------ run records
def processed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one processed listing: source, outcome, reason, error text, run day and hour."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "concat('src', user_id % 5) AS source",
        "CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 'keep' WHEN event_type = 'click' THEN 'drop' ELSE 'quarantine' END AS outcome",
        "CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'inactive' WHEN 1 THEN 'low_followers' END "
        "WHEN event_type = 'error' THEN IF(event_id % 2 = 0, 'no_contact', 'junk_name') END AS reason",
        "CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 1 THEN 'connection reset' END END AS error",
        "date(ts) AS day", "(unix_date(date(ts)) * 24 + hour(ts)) AS run_id", "event_id % 4 <> 0 AS created",
    )


EVENTS_SQL = """
ev AS (SELECT event_id, ts, 'src' || (user_id % 5) AS source,
    CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 'keep' WHEN event_type = 'click' THEN 'drop' ELSE 'quarantine' END AS outcome,
    CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'inactive' WHEN 1 THEN 'low_followers' END
      WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'no_contact' ELSE 'junk_name' END END AS reason,
    CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 1 THEN 'connection reset' END END AS error,
    CAST(ts AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS run_id, event_id % 4 <> 0 AS created FROM events)"""
COUNTS_SQL = """count(*) AS found, count(*) FILTER (outcome = 'keep') AS kept, count(*) FILTER (outcome = 'drop') AS dropped,
    count(*) FILTER (outcome = 'quarantine') AS quarantined"""

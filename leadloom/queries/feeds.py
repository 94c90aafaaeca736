"""Queries of the export table and the append-only contact feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import text as tx
from leadloom.operators import sync
from leadloom.queries.base import CRM_SQL, crm_leads, table
from leadloom.session import shared_path
from leadloom.sources.sinks import add_missing_columns

DAY = "2002-01-01"
HEADER = ["Company", "Phone", "Sales Name", "Status", "Email", "Status", "Website", "Notes", "Extra Phones", "Intent", "Score", "Markets", "WhatsApp"]


def export_table(spark, d):
    return sync.export_table(crm_leads(spark, d)).withColumn("Next Follow-up", F.col("Next Follow-up").cast("string"))


def export_preview(spark, d):
    """Export ordered by score, first twenty rows."""
    rows = crm_leads(spark, d).orderBy(F.col("score").desc(), "lead_id").limit(20)
    return sync.export_table(rows).select("Company", "Score", "Tier", "Source URL")


def export_links(spark, d):
    rows = sync.export_links(sync.export_table(crm_leads(spark, d)))
    return rows.select("Source URL", "Website Link", "WhatsApp Link", "Facebook Link", "LinkedIn Link", F.col("Source URL Link").alias("own"))


def overwrite_rows(spark, d):
    rows = sync.overwrite_rows(sync.export_table(crm_leads(spark, d)))
    return rows.select("Company", "Phone", "Intent", "Score", "Assigned To", F.col("`Next Follow-up`").alias("next"), "Source URL", "Contact Name")


def aligned_rows(spark, d):
    """Leads laid out along a team header with a repeated and two manual columns."""
    return sync.aligned_rows(crm_leads(spark, d), sync.full_header(HEADER), F.lit(DAY).cast("date"))


def master_tab(spark, d) -> DataFrame:
    """Contacts the team already has, from customers, written in many ways."""
    return table(spark, d, "customer").where("c_custkey % 4 = 0").selectExpr(
        "CASE WHEN c_custkey % 8 = 0 THEN concat('010 ', lpad(string(c_custkey), 8, '0')) ELSE 'none' END AS Phone",
        "CASE WHEN c_custkey % 12 = 0 THEN concat('https://www.Site', c_custkey, '.example/home') END AS Website",
    )


def second_tab(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 10 = 7").selectExpr("concat(' BUYER', c_custkey, '@mail.net ') AS Email")


def known_contacts(spark, d) -> DataFrame:
    return sync.known_keys([master_tab(spark, d), second_tab(spark, d)])


def lead_key_counts(spark, d):
    return crm_leads(spark, d).select("lead_id", F.array_join(sync.lead_keys(), "|").alias("keys"))


def new_contacts(spark, d):
    return sync.new_leads(crm_leads(spark, d), known_contacts(spark, d)).select("lead_id", "phone_e164", "domain", "email")


def append_counts(spark, d):
    return sync.append_counts(sync.flag_new(crm_leads(spark, d), known_contacts(spark, d)))


def appended_feed(spark, d):
    """Feed after two appends of the same leads: the second one adds nothing with a known contact."""
    path = shared_path(spark, "feed")
    leads = crm_leads(spark, d)
    tabs = [master_tab(spark, d), second_tab(spark, d)]
    for _ in range(2):
        sync.append_new(leads, path, tabs, F.lit(DAY).cast("date"), HEADER)
    return spark.read.parquet(path).select("lead_id", "Company", "Phone", "Email", "Added Date")


def whatsapp_numbers(spark, d):
    return crm_leads(spark, d).select("lead_id", tx.whatsapp_number("social_links").alias("number"), tx.list_text("extra_phones").alias("extras"), tx.list_text("target_markets").alias("markets"))


def migrated_columns(spark, d):
    """Old three-column lead table brought to the present columns, twice."""
    wanted = {"score_reasons": "array<string>", "assigned_to": "string", "pushed_to_sheet": "boolean", "company_name": "string"}
    old = crm_leads(spark, d).select("lead_id", "company_name", "score")
    new = add_missing_columns(add_missing_columns(old, wanted), wanted)
    return new.select("lead_id", "company_name", "score", "assigned_to", "pushed_to_sheet")


C = f"WITH {CRM_SQL}"


def _export_sql() -> str:
    special = {"extra_phones": "array_to_string(extra_phones, ', ')", "target_markets": "array_to_string(target_markets, ', ')",
               "sources_seen": "array_to_string(sources_seen, ',')", "contact_name": "CAST(NULL AS VARCHAR)", "contact_email": "CAST(NULL AS VARCHAR)",
               "next_followup_date": "CAST(next_followup_date AS VARCHAR)"}
    return f"{C} SELECT " + ", ".join(f'{special.get(f, f)} AS "{h}"' for f, h in rules.EXPORT_COLUMNS.items()) + " FROM crm"


def _aligned_sql() -> str:
    b = {"Company": "company_name", "Phone": "coalesce(phone_e164, '')", "Status": "'new'", "Email": "coalesce(email, '')", "Website": "coalesce(website, '')",
         "Extra Phones": "array_to_string(extra_phones, ', ')", "Intent": "CASE WHEN shipping_intent <> 0 THEN CAST(shipping_intent AS VARCHAR) ELSE '' END",
         "Score": "CAST(score AS VARCHAR)", "Markets": "coalesce(array_to_string(target_markets, ', '), '')", "WhatsApp": "coalesce(whatsapp, '')",
         "Facebook": "coalesce(facebook, '')", "LinkedIn": "coalesce(linkedin, '')", "Product Type": "product_type", "Store Platform": "coalesce(store_platform, '')",
         "Contact Role": "coalesce(contact_role, '')", "Segment": "coalesce(segment, '')", "Source": "source", "Added Date": "'2002-01-01'"}
    cols, used = [], set()
    for i, h in enumerate(HEADER + rules.FEED_ADDED):
        cols.append(f"""{b.get(h, "''") if h not in used else "''"} AS "{h if h not in used else f'{h}_{i + 1}'}\"""")
        used.add(h)
    return f"{C} SELECT lead_id, {', '.join(cols)} FROM crm"


KNOWN_SQL = """kn AS (SELECT '+2010' || lpad(c_custkey::VARCHAR, 8, '0') AS key FROM customer WHERE c_custkey % 8 = 0
  UNION SELECT 'site' || c_custkey || '.example' FROM customer WHERE c_custkey % 12 = 0 UNION SELECT 'buyer' || c_custkey || '@mail.net' FROM customer WHERE c_custkey % 10 = 7)"""
NEW_SQL = "NOT pushed_to_sheet AND (phone_e164 IS NULL OR phone_e164 NOT IN (SELECT key FROM kn)) AND (domain IS NULL OR domain NOT IN (SELECT key FROM kn)) AND (email IS NULL OR lower(email) NOT IN (SELECT key FROM kn))"
WEB = "CASE WHEN {0} LIKE 'http%' THEN {0} ELSE 'https://' || {0} END"

QUERIES = {
    "export_table": (export_table, _export_sql()),
    "export_preview": (export_preview, f'{C} SELECT company_name AS "Company", score AS "Score", tier AS "Tier", source_url AS "Source URL" FROM crm ORDER BY score DESC, lead_id LIMIT 20'),
    "export_links": (export_links, f"""{C} SELECT source_url AS "Source URL", {WEB.format('website')} AS "Website Link", 'https://wa.me/' || whatsapp AS "WhatsApp Link", {WEB.format('facebook')} AS "Facebook Link", {WEB.format('linkedin')} AS "LinkedIn Link", source_url AS own FROM crm"""),
    "overwrite_rows": (overwrite_rows, f"""{C} SELECT company_name AS "Company", coalesce(phone_e164, '') AS "Phone", coalesce(shipping_intent::VARCHAR, '') AS "Intent", score::VARCHAR AS "Score", coalesce(assigned_to, '') AS "Assigned To", coalesce(next_followup_date::VARCHAR, '') AS next, source_url AS "Source URL", '' AS "Contact Name" FROM crm"""),
    "aligned_rows": (aligned_rows, _aligned_sql()),
    "known_contacts": (known_contacts, f"WITH {KNOWN_SQL} SELECT key FROM kn"),
    "lead_key_counts": (lead_key_counts, f"{C} SELECT lead_id, concat_ws('|', phone_e164, domain, lower(email)) AS keys FROM crm"),
    "new_contacts": (new_contacts, f"{C}, {KNOWN_SQL} SELECT lead_id, phone_e164, domain, email FROM crm WHERE {NEW_SQL}"),
    "append_counts": (append_counts, f"{C}, {KNOWN_SQL} SELECT count(*) FILTER ({NEW_SQL}) AS appended, count(*) FILTER (NOT ({NEW_SQL})) AS skipped, count(*) AS seen FROM crm"),
    "appended_feed": (appended_feed, f"""{C}, {KNOWN_SQL}, f AS (SELECT * FROM crm WHERE {NEW_SQL}), f2 AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE phone_e164 IS NULL AND domain IS NULL AND email IS NULL)
        SELECT lead_id, company_name AS "Company", coalesce(phone_e164, '') AS "Phone", coalesce(email, '') AS "Email", '2002-01-01' AS "Added Date" FROM f2"""),
    "whatsapp_numbers": (whatsapp_numbers, f"{C} SELECT lead_id, whatsapp AS number, array_to_string(extra_phones, ', ') AS extras, coalesce(array_to_string(target_markets, ', '), '') AS markets FROM crm"),
    "migrated_columns": (migrated_columns, f"{C} SELECT lead_id, company_name, score, CAST(NULL AS VARCHAR) AS assigned_to, CAST(NULL AS BOOLEAN) AS pushed_to_sheet FROM crm"),
}

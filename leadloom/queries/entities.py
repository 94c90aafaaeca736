"""Queries of entity resolution and website enrichment over the whole customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import enrich as en
from leadloom.operators import report as rp
from leadloom.operators import resolve as rs
from leadloom.operators.qualify import qualify
from leadloom.queries import sqltext as s
from leadloom.queries.base import AS_OF, FILTERS, norm_sql, rate_sql, raw_listings, rated_sql, reasons_plain, table
from leadloom.queries.leads import classified, normalized
from leadloom.session import cut, shared_path
from leadloom.sources.lead_table import compact, fold_into_table, folded_batches, read_leads


def rated(spark, d) -> DataFrame:
    return qualify(raw_listings(spark, d), filters=FILTERS, as_of=AS_OF)


def links_text():
    entries = F.array_sort(F.map_entries("social_links"))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit(""))


def existing_matches(spark, d):
    """Every listing matched against the first sightings of all companies as stored leads."""
    rows = normalized(spark, d)
    stored = rows.where("pos % 3 = 0").withColumnRenamed("pos", "lead_id")
    return rs.match_existing(rows, stored)


def entity_assignment(spark, d):
    """Lead of every listing when all are folded in order of arrival."""
    keys = rs.key_columns(normalized(spark, d)).withColumn("seed", F.lit(False))
    return rs.assign(keys)


def entity_hot_keys(spark, d):
    """Fold of one record per customer where a third of all share a phone and half of all a domain."""
    keys = table(spark, d, "customer").selectExpr(
        "c_custkey AS pos", "CASE WHEN c_custkey % 3 = 0 THEN '+201000000000' END AS phone", "CASE WHEN c_custkey % 2 = 0 THEN 'hot.example' END AS domain",
        "concat('company ', c_custkey) AS name", "cast(NULL AS string) AS city", "false AS seed",
    )
    return rs.assign(keys)


HOT_SQL = """WITH c AS (SELECT c_custkey AS k FROM customer), first AS (SELECT min(k) FILTER (k % 3 = 0) AS p, min(k) FILTER (k % 2 = 0) AS h FROM c)
    SELECT k AS pos, CASE WHEN k % 3 = 0 THEN p WHEN k % 2 = 0 THEN h ELSE k END AS lead FROM c, first"""


def _lead_columns(leads: DataFrame) -> DataFrame:
    return leads.select(
        "sightings", "company_name", "company_name_norm", "phone_e164", "email", "website", "domain", "address", "city", "governorate", "country",
        "category", "source", "source_url", "followers", F.col("last_activity_date").cast("string").alias("last_activity"), "branches", "has_online_store",
        "facebook", "linkedin", "score", "tier", F.coalesce(reasons_plain(), F.lit("")).alias("reasons"), "company_type", "product_type", "segment",
        "shipping_intent", F.array_join("sources_seen", ",").alias("sources_seen"), "status", "quarantine_reason",
        F.coalesce(F.array_join("extra_phones", ","), F.lit("")).alias("extras"), links_text().alias("links"),
    )


def entity_leads(spark, d):
    """Stored leads after one batch of all listings."""
    leads = rs.upsert(rated(spark, d))
    return _lead_columns(leads)


def incremental_leads(spark, d):
    """Stored leads after five batches, one of them sent twice and a compaction between; same as one batch."""
    rows = cut(rated(spark, d))
    fifth = (rows.agg(F.max("pos")).first()[0] or 0) // 5 + 1
    path = shared_path(spark, "leads")
    for batch in (0, 1, 1, 2, 3, 4):
        if folded_batches(spark, path).get("listings", -1) < batch:
            fold_into_table(rows.where((F.col("pos") >= batch * fifth) & (F.col("pos") < (batch + 1) * fifth)), path, "listings", batch)
        if batch == 2:
            compact(spark, path)
    return _lead_columns(read_leads(spark, path, with_quarantined=True).withColumn("sightings", F.lit(0))).drop("sightings")


def upsert_counts(spark, d):
    """Run totals of the batch with leads created and sightings that updated one."""
    rows = rated(spark, d)
    pairs = rs.assign(rs.key_columns(rows.where("outcome <> 'drop'")).withColumn("seed", F.lit(False)))
    flagged = rows.join(pairs, "pos", "left").withColumn("created", F.col("pos") == F.col("lead"))
    return rp.run_totals(flagged)


# ------------------------------------------------------------------ websites of the listings
SENTENCES = [
    "We export furniture to Saudi Arabia, the UAE and Europe.", "Our factory manufactures steel parts in Cairo.",
    "Add to cart, checkout online.", "Freight forwarder and customs broker.", "We import from China.", "Welcome.", "Wholesale distributor of textile.",
]
ABOUT = [
    "Ahmed Hassan - Export Manager, ahmed@firm.net", "General Manager: Sara Nabil", "Our owner", "Call the Logistics Manager",
]


def web_pages(spark, d) -> DataFrame:
    """Landed pages of the listings' websites: home, contact and about pages; some never landed."""
    sites = cut(normalized(spark, d).where("website IS NOT NULL AND pos % 4 <> 3").selectExpr(
        "pos AS k", "lpad(string(pos), 8, '0') AS k8", "website AS url", "regexp_extract(website, '^([^:/?#]+://[^/?#]*)', 1) AS root"
    ))  # read for each kind of page
    sentence = " ".join(f"WHEN {i} THEN {s.q(t)}" for i, t in enumerate(SENTENCES))
    about = " ".join(f"WHEN {i} THEN {s.q(t)}" for i, t in enumerate(ABOUT))
    home = sites.selectExpr(
        "url", f"concat('<html><head><script src=\"x.js\"></script></head><body><a href=\"/about\">About us</a><a href=\"/contact\">Contact</a><p>', CASE k % 7 {sentence} END, '</p>', "
        "IF(k % 9 = 0, '<img src=\"https://cdn.shopify.com/i.png\">', ''), IF(k % 2 = 1, concat('<a href=\"https://facebook.com/firm', k, '\">f</a>'), ''), '</body></html>') AS html",
    )
    contact = sites.where("k % 2 = 0").selectExpr(
        "concat(root, '/contact') AS url", "concat('<p>Office</p><a href=\"tel:+2010', k8, '\">call</a>', IF(k % 3 = 0, concat('<a href=\"https://wa.me/2011', k8, '\">chat</a>'), ''), "
        "'<a href=\"mailto:info@firm', k, '.net\">mail</a><a href=\"https://linkedin.com/company/firm', k, '\">in</a>') AS html",
    )
    more = sites.where("k % 3 <> 1").selectExpr("concat(root, '/about') AS url", f"concat('<div>', CASE k % 4 {about} END, '</div>') AS html")
    return home.unionByName(contact).unionByName(more)


def landed_pages(spark, d) -> DataFrame:
    """The web pages as a landed table."""
    path = shared_path(spark, "pages")
    web_pages(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def site_profiles(spark, d):
    """What each landed website says about its company."""
    rows = en.crawl_intel(cut(classified(spark, d)), landed_pages(spark, d))
    return rows.select(
        "site", "asked_category", "pages_read", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"),
        F.array_join("whatsapp", ",").alias("whatsapp"), "facebook", "linkedin", F.array_join("markets", ",").alias("markets"), "site_type", "site_platform",
        "site_intent", "site_store", "site_contact_name", "site_contact_role", "site_contact_email",
    )


def _enriched(spark, d) -> DataFrame:
    return en.rate_before_and_after(cut(classified(spark, d)), landed_pages(spark, d), filters=FILTERS, as_of=AS_OF)


def enriched_listings(spark, d):
    """Listings after reading their websites: merged fields, outcome and score."""
    return _enriched(spark, d).select(
        "pos", "enriched", "company_type", "shipping_intent", "has_online_store", "store_platform", F.coalesce(F.array_join("target_markets", ","), F.lit("")).alias("markets"),
        "email", "facebook", "linkedin", "contact_name", "contact_role", "contact_email", "phone_e164",
        F.coalesce(F.array_join("extra_phones", ","), F.lit("")).alias("extras"), links_text().alias("links"), "outcome", "segment", "score", "tier", "tier_before",
    )


def source_coverage(spark, d):
    return rp.coverage(_enriched(spark, d))


def coverage_drops(spark, d):
    return rp.reason_histogram(_enriched(spark, d), "source")


def enrichment_effect(spark, d):
    return rp.enrichment_effect(_enriched(spark, d))


# ------------------------------------------------------------------ SQL
def fold_sql(source: str) -> str:
    """The fold as a recursion over arrival numbers: one step per record, state = list of leads.

    Phones, domains and names of the derived listings never cross blocks of 50 companies, so all
    blocks step side by side.
    """
    lead = "STRUCT(id BIGINT, p VARCHAR, d VARCHAR, n VARCHAR, c VARCHAR)"
    return f"""
seq AS (SELECT e // 50 AS blk, row_number() OVER (PARTITION BY e // 50 ORDER BY pos) AS i, pos, nullif(phone_e164, '') AS p, nullif(domain, '') AS d, nullif(company_name_norm, '') AS n, nullif(city, '') AS c FROM {source}),
fold AS (
  SELECT DISTINCT blk, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS lead, CAST([] AS {lead}[]) AS leads FROM seq
  UNION ALL
  SELECT blk, i, pos, coalesce(hit, pos) AS lead,
    CASE WHEN hit IS NULL THEN list_append(leads, CAST({{'id': pos, 'p': p, 'd': d, 'n': n, 'c': c}} AS {lead}))
      ELSE list_transform(leads, lambda l: CASE WHEN l.id = hit THEN CAST({{'id': l.id, 'p': coalesce(l.p, p), 'd': coalesce(l.d, d), 'n': l.n, 'c': coalesce(l.c, c)}} AS {lead}) ELSE l END) END AS leads
  FROM (SELECT seq.blk, seq.i, seq.pos, seq.p, seq.d, seq.n, seq.c, f.leads,
      coalesce(list_filter(f.leads, lambda l: l.p = seq.p)[1].id, list_filter(f.leads, lambda l: l.d = seq.d)[1].id,
        list_filter(f.leads, lambda l: l.n = seq.n AND l.c IS NOT DISTINCT FROM seq.c)[1].id) AS hit
    FROM fold f JOIN seq ON seq.blk = f.blk AND seq.i = f.i + 1)),
assigned AS (SELECT pos, lead FROM fold WHERE pos IS NOT NULL)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _filled_first(c: str) -> str:
    known = f"{c} IS NOT NULL" if c in ("followers", "last_activity_date", "branches", "has_online_store") else s.filled(c)
    return f"arg_min({c}, pos) FILTER ({known})"


def leads_sql(with_count: bool) -> str:
    fills = [c for c in rs.FILL_FIELDS if c not in ("phone_raw", "description", "rating", "store_platform", "contact_name", "contact_role", "contact_email", "last_activity_date")]
    cols = ", ".join(f"{_filled_first(c)} AS {c}" for c in fills)
    networks = {"facebook": "facebook", "linkedin": "linkedin", "whatsapp": "whatsapp_link"}
    links = "concat_ws(',', " + ", ".join(f"'{n}=' || arg_max({c}, pos) FILTER ({c} IS NOT NULL)" for n, c in networks.items()) + ")"
    count = "count(*) AS sightings, " if with_count else ""
    return recursive(f"""{rated_sql()}, part AS (SELECT * FROM rated WHERE outcome <> 'drop'), {fold_sql('part')},
j AS (SELECT part.*, lead FROM part JOIN assigned USING (pos)),
nums AS (SELECT lead, list_sort(list_distinct(flatten(list(list_concat(extra_phones, CASE WHEN phone_e164 IS NULL THEN [] ELSE [phone_e164] END))))) AS nums, arg_min(extra_phones, pos) AS own,
  count(*) AS cnt, arg_min(phone_e164, pos) FILTER (phone_e164 IS NOT NULL) AS main FROM j GROUP BY lead)
SELECT {count}arg_min(company_name, pos) AS company_name, arg_min(company_name_norm, pos) AS company_name_norm, {cols},
  CAST(arg_min(last_activity_date, pos) FILTER (last_activity_date IS NOT NULL) AS VARCHAR) AS last_activity,
  coalesce(arg_max(score, pos) FILTER (outcome = 'keep'), 0) AS score, coalesce(arg_max(tier, pos) FILTER (outcome = 'keep'), 'Weak') AS tier,
  coalesce(arg_max(reasons, pos) FILTER (outcome = 'keep'), '') AS reasons,
  coalesce(arg_max(company_type, pos) FILTER (company_type <> 'Unknown'), max(company_type)) AS company_type,
  arg_max(product_type, pos) FILTER (product_type IS NOT NULL) AS product_type, arg_max(segment, pos) FILTER (segment IS NOT NULL) AS segment,
  arg_max(shipping_intent, pos) FILTER (shipping_intent IS NOT NULL) AS shipping_intent, string_agg(DISTINCT source, ',' ORDER BY source) AS sources_seen,
  CASE WHEN arg_min(outcome, pos) = 'quarantine' THEN 'quarantined' ELSE 'new' END AS status, CASE WHEN arg_min(outcome, pos) = 'quarantine' THEN arg_min(reason, pos) END AS quarantine_reason,
  any_value(CASE WHEN cnt = 1 THEN array_to_string(own, ',') ELSE array_to_string(list_filter(nums, lambda v: v <> coalesce(main, '')), ',') END) AS extras,
  {links} AS links
FROM j JOIN nums USING (lead) GROUP BY lead""")


MATCH_SQL = f"""WITH {norm_sql()}, st AS (SELECT * FROM norm WHERE pos % 3 = 0),
  a AS (SELECT phone_e164, min(pos) AS m FROM st WHERE phone_e164 IS NOT NULL GROUP BY 1), b AS (SELECT domain, min(pos) AS m FROM st WHERE domain IS NOT NULL GROUP BY 1),
  c AS (SELECT company_name_norm AS n, city, min(pos) AS m FROM st WHERE company_name_norm <> '' GROUP BY 1, 2)
  SELECT pos, coalesce(a.m, b.m, c.m) AS lead_id, CASE WHEN a.m IS NOT NULL THEN 'phone' WHEN b.m IS NOT NULL THEN 'domain' WHEN c.m IS NOT NULL THEN 'name_city' END AS matched_on
  FROM norm LEFT JOIN a USING (phone_e164) LEFT JOIN b USING (domain) LEFT JOIN c ON c.n = norm.company_name_norm AND c.city IS NOT DISTINCT FROM norm.city"""


def _site_sql() -> str:
    sentence = "CASE pos % 7 " + " ".join(f"WHEN {i} THEN {s.q(t)}" for i, t in enumerate(SENTENCES)) + " END"
    about = "CASE pos % 4 " + " ".join(f"WHEN {i} THEN {s.q(t)}" for i, t in enumerate(ABOUT)) + " END"
    low = "lower(site_text)"
    titled = ("CASE WHEN NOT has_about THEN NULL WHEN pos % 4 = 0 THEN 'Export Manager' WHEN pos % 4 IN (1, 2) THEN 'Owner / CEO' ELSE 'Logistics Manager' END")
    return f"""{norm_sql()},
w0 AS (SELECT pos, website, category, lpad(pos::VARCHAR, 8, '0') AS k8, pos % 2 = 0 AS has_contact, pos % 3 <> 1 AS has_about FROM norm WHERE website IS NOT NULL AND pos % 4 <> 3),
w1 AS (SELECT *, 'About us Contact ' || {sentence} || CASE WHEN pos % 2 = 1 THEN ' f' ELSE '' END || CASE WHEN has_contact THEN ' Office call' || CASE WHEN pos % 3 = 0 THEN ' chat' ELSE '' END || ' mail in' ELSE '' END
    || CASE WHEN has_about THEN ' ' || {about} ELSE '' END AS site_text,
  CASE WHEN has_contact THEN CASE WHEN pos % 3 = 0 THEN ['+2011' || k8, '+2010' || k8] ELSE ['+2010' || k8] END ELSE [] END AS phones,
  CASE WHEN has_contact AND pos % 3 = 0 THEN ['+2011' || k8] ELSE [] END AS whatsapp,
  list_concat(CASE WHEN has_contact THEN ['info@firm' || pos || '.net'] ELSE [] END, CASE WHEN has_about AND pos % 4 = 0 THEN ['ahmed@firm.net'] ELSE [] END) AS emails,
  CASE WHEN pos % 2 = 1 THEN 'https://facebook.com/firm' || pos END AS s_facebook, CASE WHEN has_contact THEN 'https://linkedin.com/company/firm' || pos END AS s_linkedin,
  CASE WHEN pos % 9 = 0 THEN 'Shopify' END AS site_platform FROM w0),
w2 AS (SELECT *, {s.company_type(low, 'category')} AS site_type, {s.has_store(low)} AS store, {s.markets(low)} AS markets, {titled} AS role,
  CASE WHEN has_about AND pos % 4 = 0 THEN 'in Ahmed Hassan' WHEN has_about AND pos % 4 = 1 THEN 'Sara Nabil' END AS person,
  CASE WHEN has_about AND pos % 4 = 0 THEN 'ahmed@firm.net' END AS personal FROM w1),
site AS (SELECT *, 1 + has_contact::INT + has_about::INT AS pages_read,
  least({s.intent(low, 'site_type')} + 5 * len(list_filter(markets, lambda m: NOT starts_with(m, 'Local'))) + CASE WHEN store THEN 10 ELSE 0 END, 100) AS site_intent,
  store OR site_platform IS NOT NULL AS site_store FROM w2)"""


def _enriched_sql() -> str:
    """CTEs ``enr`` (merged), ``rated`` (after) and ``before`` (rated without websites)."""
    return f"""WITH {_site_sql()},
m AS (SELECT n.*, w.pages_read, w.site_type, w.site_intent, w.site_store, w.site_platform, w.markets, w.emails AS w_emails, coalesce(w.phones, []) AS w_phones,
    coalesce(w.whatsapp, []) AS w_wa, w.s_facebook, w.s_linkedin, w.person, w.role, w.personal FROM norm n LEFT JOIN site w USING (pos)),
m2 AS (SELECT *, coalesce(w_wa[1], w_phones[1]) AS main FROM m),
enr AS (SELECT pos, company_name, company_name_norm, source, source_url, domain, website, city, country, category, description, followers, last_activity_date, branches, product_type,
    pages_read IS NOT NULL AS enriched,
    CASE WHEN pages_read IS NOT NULL AND coalesce(company_type, 'Unknown') = 'Unknown' AND site_type <> 'Unknown' THEN site_type ELSE company_type END AS company_type,
    CASE WHEN site_intent > 0 THEN greatest(coalesce(shipping_intent, 0), site_intent) ELSE shipping_intent END AS shipping_intent,
    CASE WHEN site_store THEN true ELSE has_online_store END AS has_online_store, site_platform AS store_platform,
    CASE WHEN len(markets) > 0 THEN markets END AS target_markets, coalesce(email, w_emails[1]) AS email, coalesce(facebook, s_facebook) AS facebook, coalesce(linkedin, s_linkedin) AS linkedin,
    person AS contact_name, role AS contact_role, personal AS contact_email,
    CASE WHEN main IS NULL THEN phone_e164 ELSE main END AS phone_e164,
    CASE WHEN main IS NULL THEN extra_phones ELSE {s.distinct("list_concat(extra_phones, list_filter(list_concat([phone_e164], w_phones), lambda v: v IS NOT NULL AND v <> main))")} END AS extra_phones,
    concat_ws(',', 'facebook=' || facebook, 'linkedin=' || coalesce(linkedin, s_linkedin), 'whatsapp=' || coalesce('https://wa.me/' || substr(w_wa[1], 2), whatsapp_link)) AS links
  FROM m2), {rate_sql('enr', 'rated')}, {rate_sql('norm', 'before')}"""


QUERIES = {
    "existing_matches": (existing_matches, MATCH_SQL),
    "entity_assignment": (entity_assignment, recursive(f"WITH {norm_sql()}, {fold_sql('norm')} SELECT pos, lead FROM assigned")),
    "entity_hot_keys": (entity_hot_keys, HOT_SQL),
    "entity_leads": (entity_leads, leads_sql(True)),
    "incremental_leads": (incremental_leads, leads_sql(False)),
    "upsert_counts": (upsert_counts, recursive(f"""{rated_sql()}, part AS (SELECT * FROM rated WHERE outcome <> 'drop'), {fold_sql('part')}
        SELECT count(*) AS found, count(*) FILTER (outcome = 'keep') AS kept, count(*) FILTER (outcome = 'drop') AS dropped, count(*) FILTER (outcome = 'quarantine') AS quarantined,
        count(*) FILTER (outcome = 'keep' AND pos = lead) AS created, count(*) FILTER (outcome = 'keep' AND pos <> lead) AS updated FROM rated LEFT JOIN assigned USING (pos)""")),
    "site_profiles": (site_profiles, f"""WITH {_site_sql()} SELECT website AS site, category AS asked_category, pages_read, array_to_string(emails, ',') AS emails, array_to_string(phones, ',') AS phones,
        array_to_string(whatsapp, ',') AS whatsapp, s_facebook AS facebook, s_linkedin AS linkedin, array_to_string(markets, ',') AS markets, site_type, site_platform, site_intent, site_store,
        person AS site_contact_name, role AS site_contact_role, personal AS site_contact_email FROM site"""),
    "enriched_listings": (enriched_listings, f"""{_enriched_sql()} SELECT r.pos, enriched, company_type, shipping_intent, has_online_store, store_platform, coalesce(array_to_string(target_markets, ','), '') AS markets,
        email, facebook, linkedin, contact_name, contact_role, contact_email, phone_e164, array_to_string(extra_phones, ',') AS extras, links, outcome, segment, score, tier, b.tier AS tier_before
        FROM rated r JOIN (SELECT pos, tier FROM before) b USING (pos)""".replace("r.pos, enriched", "pos, enriched").replace("score, tier, b.tier", "score, r.tier, b.tier")),
    "source_coverage": (source_coverage, f"""{_enriched_sql()}, x AS (SELECT r.*, b.tier AS tier_before FROM rated r JOIN (SELECT pos, tier FROM before) b USING (pos))
        SELECT source, count(*) AS found, count(*) FILTER (outcome = 'keep') AS kept,
        count(*) FILTER (outcome = 'keep' AND list_position(['Weak', 'Medium', 'Hot'], tier) > list_position(['Weak', 'Medium', 'Hot'], tier_before)) AS upgraded,
        count(*) FILTER (outcome = 'keep' AND website IS NOT NULL) AS website, count(*) FILTER (outcome = 'keep' AND phone_e164 IS NOT NULL) AS phone,
        count(*) FILTER (outcome = 'keep' AND email IS NOT NULL) AS email, count(*) FILTER (outcome = 'keep' AND enriched) AS enriched FROM x GROUP BY source"""),
    "coverage_drops": (coverage_drops, f"{_enriched_sql()} SELECT source, outcome, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM rated WHERE outcome <> 'keep' GROUP BY ALL"),
    "enrichment_effect": (enrichment_effect, f"""{_enriched_sql()}, x AS (SELECT r.*, b.tier AS tier_before FROM rated r JOIN (SELECT pos, tier FROM before) b USING (pos))
        SELECT tier, count(*) AS n, count(*) FILTER (tier_before = 'Weak') AS weak_before FROM x WHERE outcome = 'keep' GROUP BY tier"""),
}

"""Queries over single listings: normalization, keyword intelligence, gates, segments, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import intel, urls
from leadloom.functions import text as tx
from leadloom.functions.phone import e164
from leadloom.operators import qualify as ql
from leadloom.operators.firsts import cap_per_source, keep_first, top_per
from leadloom.operators.report import ranked_list
from leadloom.plans.matrix import keywords_of
from leadloom.queries import sqltext as s
from leadloom.queries.base import (
    AS_OF, CUTOFF_YEAR, FILTERS, RAW_SQL, norm_sql, raw_listings, rated_sql, reasons_plain, table, txt,
)

ADDITIVE = {
    "weights": {"has_website": 20, "has_phone": 20, "has_email": 10, "has_linkedin": 10, "multiple_branches": 10,
                "has_online_store": 10, "in_freight_directory": 15},
    "activity": [{"max_months": 6, "points": 15}, {"max_months": 24, "points": 8}],
    "followers": [{"min": 7000, "points": 15}, {"min": 3000, "points": 10}, {"min": 1000, "points": 5}],
    "freight_sources": ["src3"],
    "max_intent_points": 20,
    "max_score": 100,
}
STRICT = {**FILTERS, "require_phone": True, "require_website": True,
          "activity": {"enabled": True, "drop_if_year_at_or_before": CUTOFF_YEAR, "drop_if_activity_unknown": True}}


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return raw_listings(spark, d).transform(ql.conform).transform(ql.normalize)


def classified(spark: SparkSession, d: str) -> DataFrame:
    return normalized(spark, d).transform(ql.classify)


def rated(spark: SparkSession, d: str) -> DataFrame:
    return ql.qualify(raw_listings(spark, d), filters=FILTERS, as_of=AS_OF)


def raw_listing_union(spark, d):
    """Listings of all sources as one table: the union of the sources is read in one pass, whatever sources there are."""
    return raw_listings(spark, d).select("pos", "source", "company_name", "phone_raw", "city")


def phone_e164(spark, d):
    return raw_listings(spark, d).select("pos", "phone_raw", e164("phone_raw").alias("phone"))


def order_number_phones(spark, d):
    """Numbers written in many ways, of several regions, validated."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    forms = [
        F.concat(F.lit("+966 5"), F.lpad(txt(c), 8, "0")), F.concat(F.lit("(02) 2"), F.lpad(txt(c), 7, "0")),
        F.concat(F.lit("00971-50-"), F.lpad(txt(c), 7, "1")), F.concat(F.lit("2011"), F.lpad(txt(c), 8, "0")),
        F.concat(F.lit("+965 9"), F.lpad(txt(c), 7, "9")), F.concat(F.lit("+20 0100"), F.lpad(txt(c), 7, "0")),
        F.concat(F.lit("4111 1111 1111 "), F.lpad(txt(c), 4, "0")), F.concat(F.lit("call "), F.lpad(txt(k), 6, "0")),
    ]
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(k % 9 == i, form).otherwise(raw)
    return o.select(k.alias("id"), raw.alias("raw")).withColumn("phone", e164("raw"))


ORDER_PHONE_SQL = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '+966 5' || lpad(o_custkey::VARCHAR, 8, '0')
 WHEN 1 THEN '(02) 2' || lpad(o_custkey::VARCHAR, 7, '0') WHEN 2 THEN '00971-50-' || lpad(o_custkey::VARCHAR, 7, '1')
 WHEN 3 THEN '2011' || lpad(o_custkey::VARCHAR, 8, '0') WHEN 4 THEN '+965 9' || lpad(o_custkey::VARCHAR, 7, '9')
 WHEN 5 THEN '+20 0100' || lpad(o_custkey::VARCHAR, 7, '0') WHEN 6 THEN '4111 1111 1111 ' || lpad(o_custkey::VARCHAR, 4, '0')
 WHEN 7 THEN 'call ' || lpad(o_orderkey::VARCHAR, 6, '0') END AS raw FROM orders"""


# How numbers of many countries are written, and their E.164 form; four more digits follow (before an extension).
WRITTEN = [
    ("+1 212 555 ", "+1212555", ""), ("001-416-555-", "+1416555", ""), ("+44 (0)20 7946 ", "+44207946", ""), ("+44 7700 90", "+44770090", ""), ("+33 1 42 68 ", "+3314268", ""),
    ("+49 30 9018 ", "+49309018", " ext. 12"), ("+39 06 6982 ", "+39066982", ""), ("+34 912 34 ", "+3491234", ""), ("+90 212 555 ", "+90212555", ""), ("+86 138 0013 ", "+861380013", ""),
    ("+91 98765 4", "+91987654", ""), ("+92 300 123 ", "+92300123", ""), ("+81 3 1234 ", "+8131234", ""), ("+82 2 312 ", "+822312", ""), ("+65 6123 ", "+656123", ""),
    ("+60 3 2161 ", "+6032161", ""), ("+62 21 3983 ", "+62213983", ""), ("+63 2 8123 ", "+6328123", ""), ("+66 2 123 ", "+662123", ""), ("+84 24 3825 ", "+84243825", ""),
    ("+61 2 9374 ", "+6129374", ""), ("+64 9 355 ", "+649355", ""), ("+55 11 95555 ", "+551195555", ""), ("+52 55 5080 ", "+52555080", ""), ("+54 11 4379 ", "+54114379", ""),
    ("+27 11 326 ", "+2711326", ""), ("+234 803 123 ", "+234803123", ""), ("+254 712 34", "+25471234", ""), ("+212 522 43", "+21252243", ""), ("+213 21 63 ", "+2132163", ""),
    ("+216 71 56", "+2167156", ""), ("+961 1 34", "+961134", "5"), ("+964 770 12", "+96477012", "3"), ("+968 2469 ", "+9682469", ""), ("+973 1721 ", "+9731721", ""),
    ("+7 495 123 ", "+7495123", ""), ("+380 44 123 ", "+38044123", ""), ("+48 22 694 ", "+4822694", ""), ("+31 20 551 ", "+3120551", ""), ("+32 2 548 ", "+322548", ""),
    ("02 2593 ", "+2022593", " x5"), ("+20 2 2593 ", "+2022593", " extension 77"), ("+999 123 45 ", None, ""), ("+1 12 ", None, ""), ("+44 1 ", None, ""),
]


def phone_world(spark, d):
    """Numbers of many countries as people write them, with and without extensions."""
    one = F.element_at(F.array(*[F.struct(F.lit(a).alias("head"), F.lit(c).alias("tail")) for a, _, c in WRITTEN]), (F.col("c_custkey") % len(WRITTEN) + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(one["head"], F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0"), one["tail"]).alias("raw"))
    return rows.select("id", e164("raw").alias("phone"))


WORLD_SQL = ("SELECT c_custkey AS id, CASE c_custkey % " + str(len(WRITTEN))
             + " ".join(f" WHEN {i} THEN '{b}' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '{c.strip() if c.isdigit() else ''}'" for i, (_, b, c) in enumerate(WRITTEN) if b) + " END AS phone FROM customer")


def site_domain(spark, d):
    a = raw_listings(spark, d).select(F.col("website").alias("address"))
    b = table(spark, d, "pages").select(F.col("url").alias("address"))
    return a.unionByName(b).select("address", tx.site_domain("address").alias("domain"))


def name_key(spark, d):
    a = raw_listings(spark, d).select(F.col("company_name").alias("name"))
    b = table(spark, d, "documents").select(F.substring("text", 1, 1 << 30).alias("name"))
    return a.unionByName(b).select(F.md5(tx.name_key("name")).alias("key_hash"), F.length(tx.name_key("name")).alias("key_length"))


def cell_email(spark, d):
    return raw_listings(spark, d).select("pos", tx.cell_email("email").alias("email"))


def normalized_listings(spark, d):
    return normalized(spark, d).select(
        "pos", "company_name", "company_name_norm", "phone_e164", F.array_join("extra_phones", ",").alias("extras"),
        "email", "website", "domain", "city", "country", "facebook", "linkedin",
    )


def company_intel(spark, d):
    low = F.lower(F.coalesce("description", F.lit("")))
    return classified(spark, d).select(
        "pos", "company_type", "shipping_intent", F.coalesce("has_online_store", F.lit(False)).alias("store"),
        (F.col("company_type") == "Freight Forwarder").alias("is_competitor"),
        F.array_join(intel.intent_phrases(intel.phrases(low)), ",").alias("signals"),
    )


def document_intel(spark, d):
    """Type, intent, markets and platform read from whole documents."""
    low = F.lower(F.concat_ws(" ", "text", "source"))
    docs = tx.settle(table(spark, d, "documents").select("doc_id", "source", low.alias("low")), {"found": intel.phrases(F.col("low"))})
    docs = docs.withColumn("company_type", intel.company_type(F.col("found"), F.col("source")))
    return docs.select(
        "doc_id", "company_type", intel.shipping_intent(F.col("found"), F.col("company_type")).alias("intent"),
        F.array_join(intel.markets(F.col("found")), ",").alias("markets"), intel.store_platform(F.col("low")).alias("platform"),
    )


def target_markets(spark, d):
    """Markets of listings from address, category and description together."""
    blob = F.lower(F.concat_ws(" ", "description", "category", "country"))
    rows = tx.settle(raw_listings(spark, d).select("pos", blob.alias("blob")), {"found": intel.phrases(F.col("blob"))})
    return rows.select("pos", F.array_join(intel.markets(F.col("found")), ",").alias("markets"))


def store_platform(spark, d):
    """Shop platform from the raw markup of pages, tagged with a platform script by page number."""
    marks = ["cdn.shopify.com/s.js", "wp-content/plugins/woocommerce/x.js", "cdn.salla.sa/a.js", "zid.store/z.js",
             "mage/cookies.js", "wp-json/v2", "plain.js"]
    script = F.lit("")
    for i, mark in enumerate(marks):
        script = F.when(F.col("page_id") % len(marks) == i, F.lit(f'<script src="{mark}"></script>')).otherwise(script)
    return table(spark, d, "pages").select("page_id", intel.store_platform(F.lower(F.concat("html", script))).alias("platform"))


def validation_reason(spark, d):
    return classified(spark, d).select("pos", ql.invalid_reason().alias("reason"))


def quality_reason(spark, d):
    return classified(spark, d).select(
        "pos", ql.filter_reason(FILTERS).alias("reason"), ql.filter_reason(STRICT).alias("strict_reason")
    )


def segments(spark, d):
    return ql.finish_identity(classified(spark, d)).select("pos", ql.segment().alias("segment"))


def band_scores(spark, d):
    return rated(spark, d).where("outcome = 'keep'").select("pos", "segment", "score", "tier", reasons_plain().alias("reasons"))


def additive_scores(spark, d):
    rows = ql.score(ql.finish_identity(classified(spark, d)), ADDITIVE, AS_OF)
    return rows.select("pos", "score", "tier", reasons_plain().alias("reasons"))


def reason_texts(spark, d):
    return rated(spark, d).where("outcome = 'keep'").select("pos", tx.reason_text("score_reasons").alias("why"))


def qualified_listings(spark, d):
    """Whole path of every listing with outcome, reason and score."""
    return rated(spark, d).select(
        "pos", "company_name_norm", "phone_e164", "domain", "email", "company_type", "shipping_intent", "segment",
        "outcome", "reason", "score", "tier",
    )


def working_list(spark, d):
    """Kept listings, best score first."""
    return ranked_list(
        rated(spark, d).where("outcome <> 'drop'").withColumn("lead_id", F.col("pos")).withColumn(
            "status", F.when(F.col("outcome") == "quarantine", rules.QUARANTINED).otherwise("new")
        )
    ).select("lead_id", "company_name", "phone_e164", "website", "segment", "score", "tier")


def best_ten(spark, d):
    return working_list(spark, d).limit(10)


def best_intent(spark, d):
    rows = rated(spark, d).where("outcome = 'keep'")
    return rows.orderBy(F.col("shipping_intent").desc(), "pos").limit(50).select("pos", "company_name", "company_type", "shipping_intent", "tier")


def quarantine_split(spark, d):
    return rated(spark, d).groupBy((F.col("outcome") == "quarantine").alias("quarantined"), "outcome").agg(F.count(F.lit(1)).alias("n"))


def category_keywords(spark, d):
    """Keyword lookup of each listing's category, empty for unknown ones."""
    raw = raw_listings(spark, d).select("pos", F.when(F.col("pos") % 4 == 0, F.lit("Unlisted")).otherwise(F.col("category")).alias("category"))
    return keywords_of(raw).select("pos", "category", F.array_join("keywords", ", ").alias("keywords"))


def address_places(spark, d):
    city, governorate = urls.address_place("address")
    lcity, lcountry = urls.location_place("location")
    raw = raw_listings(spark, d).select(
        "pos", "address",
        F.when(F.col("pos") % 2 == 0, F.concat_ws(", ", "city", F.lit("Egypt"))).otherwise(F.col("country")).alias("location"),
    )
    return raw.select("pos", city.alias("city"), governorate.alias("governorate"), lcity.alias("location_city"), lcountry.alias("location_country"))


def place_labels(spark, d):
    labels = ["Phone: ", "Website:", "ADDRESS: ", "الهاتف: ", "العنوان:", "", "Fax: "]
    label = F.lit(None).cast("string")
    for i, text in enumerate(labels):
        label = F.when(F.col("pos") % len(labels) == i, F.lit(text)).otherwise(label)
    raw = raw_listings(spark, d).select("pos", F.concat(label, F.coalesce("address", F.lit(" "))).alias("panel"))
    return raw.select("pos", tx.place_label("panel").alias("value"))


def relevance_gates(spark, d):
    """Directories a listing's category is relevant to, and its directory category."""
    cats = ["Cotton Yarn", "Ready Wear", "Customs Clearance", "Trucking", "Logistics Services", "Furniture", "Forwarder"]
    c = F.lit(None).cast("string")
    for i, text in enumerate(cats):
        c = F.when(F.col("p_partkey") % 8 == i, F.concat(F.lit(text + " "), F.col("p_name"))).otherwise(c)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), c.alias("category")).select(
        "id",
        intel.relevant_category(F.col("category"), rules.TEXTILE_HINTS).alias("textile"),
        intel.relevant_category(F.col("category"), rules.APPAREL_HINTS).alias("apparel"),
        intel.relevant_category(F.col("category"), rules.FREIGHT_HINTS).alias("freight"),
        intel.mapped_category(F.col("category"), rules.FREIGHT_CATEGORY_NEEDLES, rules.FREIGHT_DEFAULT_CATEGORY).alias("directory_category"),
    )


GATE_CATS = ["Cotton Yarn", "Ready Wear", "Customs Clearance", "Trucking", "Logistics Services", "Furniture", "Forwarder"]


def location_filter(spark, d):
    """Listings in the wanted place (city or governorate), and those that name the wanted country."""
    raw = raw_listings(spark, d)
    wanted = F.when(F.col("pos") % 3 == 0, F.array(F.lit(" city4 "), F.lit("GOV"))).when(F.col("pos") % 3 == 1, F.array(F.lit("gov1"))).otherwise(F.array().cast("array<string>"))
    return raw.select(
        "pos", intel.location_wanted(F.col("city"), F.col("governorate"), wanted).alias("wanted"),
        intel.country_named(F.col("address"), F.col("country"), F.col("company_name"), " Egypt ").alias("in_country"),
    )


def capped_listings(spark, d):
    """First 40 listings of each source."""
    return cap_per_source(raw_listings(spark, d).select("pos", "source", "company_name"), 40)


def first_per_phone(spark, d):
    return keep_first(normalized(spark, d).where(tx.has_value("phone_e164")).select("pos", "phone_e164", "company_name"), ["phone_e164"])


def newest_order_per_customer(spark, d):
    """Newest stage row per company, a keyed newest-row pick."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return top_per(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 1).select("o_custkey", "o_orderkey", "o_orderstatus")


def defaulted_fields(spark, d):
    rows = ql.finish_identity(classified(spark, d))
    return rows.select("pos", "country", "product_type", "website")


def lenient_dates(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    cell = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 2, F.lit("soon"))
    return o.select(k.alias("id"), tx.lenient_date(cell).alias("day"))


LOW = "lower(coalesce(description, ''))"


def _additive_sql() -> str:
    w = ADDITIVE["weights"]
    months = f"({AS_OF.year * 12 + AS_OF.month} - (year(last_activity_date) * 12 + month(last_activity_date)))"
    cat = "lower(coalesce(category, ''))"
    tests = {
        "has_website": f"{s.filled('website')} OR {s.filled('domain')}", "has_phone": s.filled("phone_e164"),
        "has_email": s.filled("email"), "has_linkedin": s.filled("linkedin"), "multiple_branches": "branches > 1",
        "has_online_store": "coalesce(has_online_store, false)",
        "in_freight_directory": f"source = 'src3' OR contains({cat}, 'freight') OR contains({cat}, 'forwarder')",
    }
    parts = [(s.q(k), f"CASE WHEN {t} THEN {w[k]} ELSE 0 END") for k, t in tests.items()]
    act = " ".join(f"WHEN {months} <= {b['max_months']} THEN {b['points']}" for b in ADDITIVE["activity"])
    fol = " ".join(f"WHEN followers >= {b['min']} THEN {b['points']}" for b in ADDITIVE["followers"])
    parts += [("'recent_activity'", f"CASE {act} ELSE 0 END"), ("'followers'", f"CASE {fol} ELSE 0 END"),
              ("'shipping_intent'", "CAST(least(floor(coalesce(shipping_intent, 0) / 5), 20) AS INT)")]
    return (f"WITH {norm_sql()} SELECT pos, CAST({s.score_of(parts)} AS INT) AS score, "
            f"{s.tier(s.score_of(parts), rules.ADDITIVE_TIERS)} AS tier, {s.reasons_of(parts)} AS reasons FROM norm")


def _why_sql() -> str:
    labels = "MAP {" + ", ".join(f"{s.q(k)}: {s.q(v)}" for k, v in rules.REASON_LABELS.items()) + "}"
    return (f"{rated_sql()} SELECT pos, array_to_string(list_transform(string_split(reasons, ','), lambda r: "
            f"coalesce(({labels})[split_part(r, '=', 1)], split_part(r, '=', 1))), {s.q(rules.REASON_SEPARATOR)}) AS why "
            f"FROM rated WHERE outcome = 'keep'")


def _place_label_sql() -> str:
    labels = ["Phone: ", "Website:", "ADDRESS: ", "الهاتف: ", "العنوان:", "", "Fax: "]
    case = "CASE pos % 7 " + " ".join(f"WHEN {i} THEN {s.q(t)}" for i, t in enumerate(labels)) + " END"
    return (f"WITH {RAW_SQL} SELECT pos, nullif(trim(regexp_replace(trim({case} || coalesce(address, ' ')), "
            f"'(?i)^({'|'.join(rules.PLACE_LABELS)})\\s*', '')), '') AS value FROM raw")


def _gates_sql() -> str:
    c = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {s.q(t + ' ')} || p_name" for i, t in enumerate(GATE_CATS)) + " END"

    def rel(hints):
        return f"(category IS NULL OR category = '' OR {s.any_of('lower(category)', hints)})"

    mapped = " ".join(f"WHEN contains(lower(category), {s.q(n)}) THEN {s.q(v)}" for n, v in rules.FREIGHT_CATEGORY_NEEDLES.items())
    return (f"SELECT id, {rel(rules.TEXTILE_HINTS)} AS textile, {rel(rules.APPAREL_HINTS)} AS apparel, {rel(rules.FREIGHT_HINTS)} AS freight, "
            f"CASE WHEN category IS NULL OR category = '' THEN {s.q(rules.FREIGHT_DEFAULT_CATEGORY)} {mapped} END AS directory_category "
            f"FROM (SELECT p_partkey AS id, {c} AS category FROM part)")


def _platform_sql() -> str:
    marks = ["cdn.shopify.com/s.js", "wp-content/plugins/woocommerce/x.js", "cdn.salla.sa/a.js", "zid.store/z.js",
             "mage/cookies.js", "wp-json/v2", "plain.js"]
    script = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(marks)) + " END"
    return f"SELECT page_id, {s.platform('low')} AS platform FROM (SELECT page_id, lower(html || {script}) AS low FROM pages)"


def _keywords_sql() -> str:
    pairs = " ".join(f"WHEN {s.q(c)} THEN {s.q(', '.join(w))}" for c, w in rules.CATEGORIES.items())
    return (f"WITH {RAW_SQL} SELECT pos, category, CASE category {pairs} ELSE '' END AS keywords FROM "
            f"(SELECT pos, CASE WHEN pos % 4 = 0 THEN 'Unlisted' ELSE category END AS category FROM raw)")


N = f"WITH {norm_sql()}"
R = rated_sql()
ALL = f"WITH {RAW_SQL}"

QUERIES = {
    "raw_listing_union": (raw_listing_union, f"{ALL} SELECT pos, source, company_name, phone_raw, city FROM raw"),
    "phone_e164": (phone_e164, f"{ALL} SELECT pos, phone_raw, {s.e164('phone_raw')} AS phone FROM raw"),
    "phone_e164_regions": (order_number_phones, f"SELECT id, raw, {s.e164('raw')} AS phone FROM ({ORDER_PHONE_SQL})"),
    "phone_world": (phone_world, WORLD_SQL),
    "site_domain": (site_domain, f"{ALL} SELECT address, {s.domain('address')} AS domain FROM (SELECT website_raw AS address FROM raw UNION ALL SELECT url FROM pages)"),
    "name_key": (name_key, f"{ALL} SELECT md5({s.name_key('name')}) AS key_hash, length({s.name_key('name')}) AS key_length FROM (SELECT company_name AS name FROM raw UNION ALL SELECT text FROM documents)"),
    "cell_email": (cell_email, f"{ALL} SELECT pos, {s.cell_email('email_raw')} AS email FROM raw"),
    "normalized_listings": (normalized_listings, f"{N} SELECT pos, company_name, company_name_norm, phone_e164, array_to_string(extra_phones, ',') AS extras, email, website, domain, city, country, facebook, linkedin FROM norm"),
    "company_intel": (company_intel, f"{N} SELECT pos, company_type, shipping_intent, coalesce(has_online_store, false) AS store, company_type = 'Freight Forwarder' AS is_competitor, {s.intent_phrases(LOW)} AS signals FROM norm"),
    "document_intel": (document_intel, f"SELECT doc_id, company_type, {s.intent('low', 'company_type')} AS intent, array_to_string({s.markets('low')}, ',') AS markets, {s.platform('low')} AS platform FROM (SELECT *, {s.company_type('low', 'source')} AS company_type FROM (SELECT *, lower(concat_ws(' ', text, source)) AS low FROM documents))"),
    "target_markets": (target_markets, f"{ALL} SELECT pos, array_to_string({s.markets('low')}, ',') AS markets FROM (SELECT pos, lower(concat_ws(' ', description, category, country_raw)) AS low FROM raw)"),
    "store_platform": (store_platform, _platform_sql()),
    "validation_reason": (validation_reason, f"{N} SELECT pos, {s.invalid_reason()} AS reason FROM norm"),
    "quality_reason": (quality_reason, f"{N} SELECT pos, {s.filter_reason(CUTOFF_YEAR, 1000)} AS reason, {s.filter_reason(CUTOFF_YEAR, 1000, True, True, True)} AS strict_reason FROM norm"),
    "segments": (segments, f"{N} SELECT pos, {s.segment()} AS segment FROM norm"),
    "band_scores": (band_scores, f"{R} SELECT pos, segment, score, tier, reasons FROM rated WHERE outcome = 'keep'"),
    "additive_scores": (additive_scores, _additive_sql()),
    "reason_texts": (reason_texts, _why_sql()),
    "qualified_listings": (qualified_listings, f"{R} SELECT pos, company_name_norm, phone_e164, domain, email, company_type, shipping_intent, segment, outcome, reason, score, tier FROM rated"),
    "working_list": (working_list, f"{R} SELECT pos AS lead_id, company_name, phone_e164, website, segment, score, tier FROM rated WHERE outcome = 'keep' ORDER BY score DESC, pos"),
    "best_ten": (best_ten, f"{R} SELECT pos AS lead_id, company_name, phone_e164, website, segment, score, tier FROM rated WHERE outcome = 'keep' ORDER BY score DESC, pos LIMIT 10"),
    "best_intent": (best_intent, f"{R} SELECT pos, company_name, company_type, shipping_intent, tier FROM rated WHERE outcome = 'keep' ORDER BY shipping_intent DESC, pos LIMIT 50"),
    "quarantine_split": (quarantine_split, f"{R} SELECT outcome = 'quarantine' AS quarantined, outcome, count(*) AS n FROM rated GROUP BY ALL"),
    "category_keywords": (category_keywords, _keywords_sql()),
    "address_places": (address_places, f"""{ALL}, p AS (SELECT pos, list_filter(list_transform(string_split(regexp_replace(address, '[ .]+$', ''), ','), lambda v: trim(v)), lambda v: v <> '') AS a,
        CASE WHEN pos % 2 = 0 THEN concat_ws(', ', city, 'Egypt') ELSE country_raw END AS loc FROM raw)
        SELECT pos, CASE WHEN len(a) >= 2 THEN a[-2] END AS city, a[-1] AS governorate,
        CASE WHEN contains(loc, ',') THEN trim(split_part(loc, ',', 1)) END AS location_city,
        CASE WHEN contains(loc, ',') THEN trim(string_split(loc, ',')[-1]) ELSE loc END AS location_country FROM p"""),
    "place_labels": (place_labels, _place_label_sql()),
    "relevance_gates": (relevance_gates, _gates_sql()),
    "location_filter": (location_filter, f"""{ALL} SELECT pos, CASE pos % 3 WHEN 0 THEN contains(hay, 'city4') AND contains(hay, 'gov') WHEN 1 THEN contains(hay, 'gov1') ELSE true END AS wanted,
        contains(lower(concat_ws(' ', address, country_raw, company_name)), 'egypt') AS in_country
        FROM (SELECT *, lower(coalesce(city, '') || ' ' || coalesce(governorate, '')) AS hay FROM raw)"""),
    "capped_listings": (capped_listings, f"{ALL} SELECT pos, source, company_name FROM raw QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 40"),
    "first_per_phone": (first_per_phone, f"{N} SELECT pos, phone_e164, company_name FROM norm WHERE phone_e164 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY phone_e164 ORDER BY pos) = 1"),
    "newest_order_per_customer": (newest_order_per_customer, "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "defaulted_fields": (defaulted_fields, f"{N} SELECT pos, country, product_type, website FROM norm"),
    "lenient_dates": (lenient_dates, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders"),
}

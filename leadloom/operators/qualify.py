"""Raw listing to qualified lead: one narrow stage of Column expressions, no shuffle.

``qualify`` chains normalize, classify, gate, segment and score. Each step is a
``DataFrame -> DataFrame`` for ``DataFrame.transform``, so steps can be used alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import intel
from leadloom.functions import text as tx
from leadloom.functions.phone import valid_phones

REASONS_TYPE = "array<struct<factor:string,points:int>>"
RAW_FIELDS = {
    "pos": "long", "company_name": "string", "source": "string", "source_url": "string", "phone_raw": "string",
    "extra_phones": "array<string>", "email": "string", "website": "string", "address": "string", "city": "string",
    "governorate": "string", "country": "string", "category": "string", "description": "string",
    "social_links": "map<string,string>", "followers": "int", "last_activity_date": "date", "rating": "double",
    "branches": "int", "has_online_store": "boolean",
}


def conform(df: DataFrame, fields: dict[str, str] = RAW_FIELDS) -> DataFrame:
    """Add missing ``fields`` as nulls and cast the present ones; a cell that does not fit becomes null. Extra columns stay."""
    extra = [c for c in df.columns if c not in fields]
    cols = [(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in fields.items()]
    return df.select(*cols, *extra)


def normalize(df: DataFrame, region: str = rules.DEFAULT_REGION, country: str = rules.DEFAULT_COUNTRY) -> DataFrame:
    """Phones, site, name key, e-mail, country and social columns in canonical form."""
    texts = F.concat(
        F.array(F.col("phone_raw")), F.coalesce(F.col("extra_phones"), F.array().cast("array<string>"))
    )
    name = F.trim(F.coalesce(F.col("company_name"), F.lit("")))
    site = tx.null_if_empty(F.trim(F.col("website")))
    links = F.coalesce(F.col("social_links"), F.create_map().cast("map<string,string>"))
    df = tx.settle(
        df,
        {
            "company_name": name,
            "company_name_norm": tx.name_key(name),
            "_phones": valid_phones(F.array_compact(texts), region),
            "website": tx.url_with_scheme(site),
            "domain": tx.site_domain(site),
            "email": tx.cell_email("email"),
            "city": tx.null_if_empty("city"),
            "country": F.coalesce(tx.null_if_empty("country"), F.lit(country)),
            "social_links": links,
        },
    )
    return df.withColumns(
        {
            "phone_e164": tx.first_of(F.col("_phones")),
            "extra_phones": F.slice(F.col("_phones"), 2, 1 << 30),
            "facebook": F.try_element_at("social_links", F.lit("facebook")),
            "linkedin": F.try_element_at("social_links", F.lit("linkedin")),
        }
    ).drop("_phones")


def classify(df: DataFrame) -> DataFrame:
    """Company type, intent and competitor flag from the description, else the category."""
    described = tx.has_value("description") | tx.has_value("category")
    found = F.col("_found")
    df = tx.settle(df, {"_found": intel.phrases(F.lower(F.coalesce(F.col("description"), F.lit(""))))})
    df = tx.settle(
        df,
        {
            "company_type": F.when(described, intel.company_type(found, F.col("category"))),
            "has_online_store": F.when(intel.has_store(found), F.lit(True)).otherwise(F.col("has_online_store")),
        },
    )
    return tx.settle(df, {"shipping_intent": F.when(described, intel.shipping_intent(found, F.col("company_type")))}).drop("_found")


ENRICHED_DEFAULTS = {
    "enriched": "boolean", "store_platform": "string", "target_markets": "array<string>",
    "contact_name": "string", "contact_role": "string", "contact_email": "string", "product_type": "string",
}


def finish_identity(df: DataFrame) -> DataFrame:
    """Columns later steps rely on: competitor flag, product type and the enrichment fields."""
    missing = {c: F.lit(None).cast(t) for c, t in ENRICHED_DEFAULTS.items() if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    return df.withColumns(
        {
            "enriched": F.coalesce(F.col("enriched"), F.lit(False)),
            "is_competitor": F.coalesce(F.col("company_type") == "Freight Forwarder", F.lit(False)),
            "product_type": F.coalesce(tx.null_if_empty("product_type"), tx.null_if_empty("category")),
        }
    )


def contact_known() -> Column:
    return tx.has_value("phone_e164") | tx.has_value("email") | tx.has_value("website") | tx.has_value("domain")


def invalid_reason() -> Column:
    """Why a record is broken data, null when it is sound."""
    word_chars = F.length(F.regexp_replace("company_name", tx.WORD_CHAR.replace("[", "[^", 1), ""))
    return (
        F.when(F.trim(F.coalesce(F.col("company_name"), F.lit(""))) == "", F.lit("no_identity"))
        .when(word_chars < 2, F.lit("junk_name"))
        .when(~contact_known(), F.lit("no_contact"))
        .when(tx.has_value("phone_e164") & ~F.rlike("phone_e164", F.lit(r"^\+[0-9]{6,15}$")), F.lit("bad_phone"))
    )


def filter_reason(cfg: dict = rules.FILTERS) -> Column:
    """First quality rule a lead fails, null when it passes all enabled ones."""
    checks: list[tuple[Column, str]] = []
    if cfg.get("require_phone"):
        checks.append((~tx.has_value("phone_e164"), "no_phone"))
    if cfg.get("require_website"):
        checks.append((~(tx.has_value("website") | tx.has_value("domain")), "no_website"))
    if cfg.get("require_contact"):
        checks.append((~contact_known(), "no_contact"))
    activity = cfg.get("activity", {})
    if activity.get("enabled"):
        cutoff = int(activity.get("drop_if_year_at_or_before", 0))
        checks.append((F.year("last_activity_date") <= cutoff, "inactive"))
        if activity.get("drop_if_activity_unknown"):
            checks.append((F.col("last_activity_date").isNull(), "activity_unknown"))
    followers = cfg.get("followers", {})
    if followers.get("enabled"):
        checks.append((F.col("followers") < int(followers.get("min", 0)), "low_followers"))
    reason = F.lit(None).cast("string")
    for failed, code in reversed(checks):
        reason = F.when(failed, F.lit(code)).otherwise(reason)
    return reason


def segment(cfg: dict = rules.SEGMENTS) -> Column:
    """Targeting bucket: competitor, service, P1, P2, P3 or other."""

    kind = F.coalesce(F.col("company_type"), F.lit(""))
    cat = F.trim(F.coalesce(F.col("category"), F.lit("")))
    product = tx.one_of(kind, rules.PRODUCT_TYPES) | tx.one_of(cat, cfg.get("p1_categories", []))
    shop = (
        F.coalesce(F.col("has_online_store"), F.lit(False))
        | tx.has_value("store_platform")
        | (kind == "Ecommerce")
        | tx.one_of(cat, cfg.get("p2_categories", []))
    )
    export = (
        (kind == "Exporter") | tx.one_of(F.col("source"), cfg.get("p3_sources", [])) | tx.one_of(cat, cfg.get("p3_categories", []))
    )
    words = F.lower(
        F.concat_ws(" ", *[tx.null_if_empty(c) for c in ("category", "company_name", "description", "product_type")])
    )
    service = tx.contains_any(words, [k.lower() for k in cfg.get("service_keywords", [])])
    return (
        F.when(F.col("is_competitor") | (kind == "Freight Forwarder"), F.lit("competitor"))
        .when(product, F.lit("P1"))
        .when(shop, F.lit("P2"))
        .when(export, F.lit("P3"))
        .when(service, F.lit("service"))
        .otherwise(F.lit("other"))
    )


def band_key() -> Column:
    """Business-fit band of a lead."""
    kind = F.coalesce(F.col("company_type"), F.lit(""))
    cat = F.lower(F.coalesce(F.col("category"), F.lit("")))
    seg = F.coalesce(F.col("segment"), F.lit(""))
    return (
        F.when((seg == "competitor") | F.col("is_competitor"), F.lit("competitor"))
        .when(seg == "service", F.lit("service"))
        .when(kind.isin(rules.MAKER_TYPES), F.lit("product_maker"))
        .when(kind.isin(rules.TRADER_TYPES), F.lit("trader"))
        .when(kind == "Ecommerce", F.lit("ecommerce"))
        .when(seg == "P1", F.lit("trader"))
        .when(seg == "P2", F.lit("ecommerce"))
        .when(seg == "P3", F.lit("general_trading"))
        .when(F.contains(cat, F.lit("import")) & F.contains(cat, F.lit("export")), F.lit("general_trading"))
        .otherwise(F.lit("default"))
    )


def ships() -> Column:
    foreign = F.exists("target_markets", lambda m: ~F.startswith(m, F.lit(rules.LOCAL_MARKET_PREFIX)))
    return F.coalesce(foreign, F.lit(False)) | (F.coalesce(F.col("shipping_intent"), F.lit(0)) >= rules.SHIPS_INTENT)


def tier_of(score: Column, tiers: dict[str, int]) -> Column:
    """Tier with the highest threshold reached; of equal thresholds the later name."""
    tier = F.lit("Weak")
    for _, (name, threshold) in sorted(enumerate(tiers.items()), key=lambda t: (t[1][1], t[0])):
        tier = F.when(score >= threshold, F.lit(name)).otherwise(tier)
    return tier


def _points(factors: list[tuple[Column, str, Column]], head: list[Column], top: int) -> tuple[Column, Column]:
    """(score, breakdown): capped sum and the list of factors that gave points.

    Both are plain sums and concatenations, so the step stays inside generated code.
    """
    none = F.array().cast(REASONS_TYPE)
    total = F.lit(0)
    parts = [F.array(h).cast(REASONS_TYPE) for h in head]
    for h in head:
        total = total + h["points"]
    for hit, name, points in factors:
        given = F.when(hit, points.cast("int")).otherwise(0)
        total = total + given
        row = F.array(F.struct(F.lit(name).alias("factor"), given.alias("points"))).cast(REASONS_TYPE)
        parts.append(F.when(given != 0, row).otherwise(none))
    return F.least(total, F.lit(top)), F.concat(*parts)


def band_score(cfg: dict = rules.SCORING) -> tuple[Column, Column]:
    """(score, breakdown) of the band engine; reads the ``band`` and ``_ships`` columns."""
    bands = {**rules.SCORING["base_bands"], **cfg.get("base_bands", {})}
    bonus = {**rules.SCORING["bonuses"], **cfg.get("bonuses", {})}
    base = F.lit(bands["default"])
    for name, points in bands.items():
        base = F.when(F.col("band") == name, F.lit(int(points))).otherwise(base)
    open_band = ~F.col("band").isin(rules.FLAT_BANDS)
    links = F.try_element_at("social_links", F.lit("linkedin"))
    checks = [
        (tx.has_value("website") | tx.has_value("domain"), "has_website"),
        (F.coalesce(F.col("has_online_store"), F.lit(False)), "has_online_store"),
        (F.col("_ships"), "ships"),
        (tx.has_value("phone_e164"), "has_phone"),
        (tx.has_value("email"), "has_email"),
        (tx.has_value("contact_name") | tx.has_value("contact_role"), "has_contact_person"),
        (tx.has_value("linkedin") | tx.has_value(links), "has_linkedin"),
    ]
    head = [F.struct(F.concat(F.lit("band:"), F.col("band")).alias("factor"), base.cast("int").alias("points"))]
    factors = [(hit & open_band, name, F.lit(int(bonus.get(name, 0)))) for hit, name in checks]
    return _points(factors, head, int(cfg.get("max_score", 100)))


def months_since(day: Column, as_of: dt.date) -> Column:
    """Difference in calendar months."""
    return F.lit(as_of.year * 12 + as_of.month) - (F.year(day) * 12 + F.month(day))


def additive_score(cfg: dict, as_of: dt.date) -> tuple[Column, Column]:
    """(score, breakdown) of the presence-based engine, used without bands."""
    weights = cfg.get("weights", {})
    cat = F.lower(F.coalesce(F.col("category"), F.lit("")))
    freight = F.coalesce(F.col("source").isin(list(cfg.get("freight_sources", [])) or [""]), F.lit(False))

    def bucket(value: Column, steps: list[dict], bound: str) -> Column:
        out = F.lit(0)
        for step in reversed(steps):
            hit = value <= step[bound] if bound == "max_months" else value >= step[bound]
            out = F.when(hit, F.lit(int(step["points"]))).otherwise(out)
        return F.when(value.isNotNull(), out).otherwise(0)

    def weighted(hit: Column, name: str) -> tuple[Column, str, Column]:
        return F.coalesce(hit, F.lit(False)), name, F.lit(int(weights.get(name, 0)))

    yes = F.lit(True)
    intent = F.coalesce(F.col("shipping_intent"), F.lit(0))
    factors = [
        weighted(tx.has_value("website") | tx.has_value("domain"), "has_website"),
        weighted(tx.has_value("phone_e164"), "has_phone"),
        weighted(tx.has_value("email"), "has_email"),
        weighted(tx.has_value(F.try_element_at("social_links", F.lit("linkedin"))), "has_linkedin"),
        weighted(F.col("branches") > 1, "multiple_branches"),
        weighted(F.col("has_online_store"), "has_online_store"),
        weighted(freight | tx.contains_any(cat, ["freight", "forwarder"]), "in_freight_directory"),
        (yes, "recent_activity",
         bucket(months_since(F.col("last_activity_date"), as_of), cfg.get("activity", []), "max_months")),
        (yes, "followers", bucket(F.col("followers"), cfg.get("followers", []), "min")),
        (yes, "shipping_intent", F.least(F.floor(intent / 5), F.lit(int(cfg.get("max_intent_points", 20))))),
    ]
    return _points(factors, [], int(cfg.get("max_score", 100)))


def score(df: DataFrame, cfg: dict = rules.SCORING, as_of: dt.date | None = None) -> DataFrame:
    """Add score, tier and breakdown; bands in the config choose the engine."""
    if cfg.get("base_bands"):
        df = df.withColumns({"band": band_key(), "_ships": ships()})
        points, reasons = band_score(cfg)
        tiers = cfg.get("tiers", rules.SCORING["tiers"])
    else:
        points, reasons = additive_score(cfg, as_of or dt.date.today())
        tiers = cfg.get("tiers", rules.ADDITIVE_TIERS)
    df = df.withColumns({"score": points.cast("int"), "score_reasons": reasons})
    return df.withColumn("tier", tier_of(F.col("score"), tiers)).drop("band", "_ships")


def gate(df: DataFrame, filters: dict = rules.FILTERS) -> DataFrame:
    """Add ``outcome`` (keep, drop, quarantine) and ``reason``: integrity first, quality second."""
    df = tx.settle(df, {"_broken": invalid_reason(), "_poor": filter_reason(filters)})
    outcome = (
        F.when(F.col("_broken").isNotNull(), F.lit("quarantine"))
        .when(F.col("_poor").isNotNull(), F.lit("drop"))
        .otherwise(F.lit("keep"))
    )
    return df.withColumns({"outcome": outcome, "reason": F.coalesce("_broken", "_poor")}).drop("_broken", "_poor")


def rate(
    df: DataFrame,
    filters: dict = rules.FILTERS,
    segments: dict = rules.SEGMENTS,
    scoring: dict = rules.SCORING,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Gate, segment and score; only kept leads carry a segment and a score."""
    df = gate(finish_identity(df), filters)
    kept = F.col("outcome") == "keep"
    df = df.withColumn("segment", F.when(kept, segment(segments)))
    df = score(df, scoring, as_of)
    return df.withColumns(
        {
            "score": F.when(kept, F.col("score")).otherwise(0),
            "tier": F.when(kept, F.col("tier")).otherwise("Weak"),
            "score_reasons": F.when(kept, F.col("score_reasons")).otherwise(F.array().cast(REASONS_TYPE)),
        }
    )


def qualify(df: DataFrame, enrich=None, **rating) -> DataFrame:
    """Whole path for raw listings; ``enrich`` is an optional step between classify and the gates."""
    df = df.transform(conform).transform(normalize).transform(classify)
    if enrich is not None:
        df = df.transform(enrich)
    return rate(df, **rating)

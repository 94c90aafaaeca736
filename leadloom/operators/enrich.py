"""Website intelligence: from landed pages of a site to a richer lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import html as h
from leadloom.functions import intel
from leadloom.functions import text as tx
from leadloom.functions.urls import subpages
from leadloom.session import cut
from leadloom.sources.pages import PLACE, located, newest_places

NO_TEXTS = "array<string>"


def site_pages(sites: DataFrame, pages: DataFrame, budget: int = rules.SITE_PAGE_BUDGET) -> DataFrame:
    """Pages read for each site: its home page (0) and the landed sub-pages it leads to.

    ``sites(site)`` joins ``pages(url, html)`` on the address twice; a site without a landed
    home page gives no rows. At most ``budget`` pages per site, as the crawl allows. Of several landings of
    an address the newest is read (by ``fetched_at`` where the pages carry it, else the last in the files).

    Which landing is read is decided on addresses, times and places in the files; markup is fetched by place, so
    that of unwanted and older landings is never shuffled.
    """
    places = located(pages)
    order = ["fetched_at"] if "fetched_at" in pages.columns else []

    def newest(wanted: DataFrame) -> DataFrame:
        return newest_places(places.join(wanted.select("url").distinct(), "url", "left_semi"), order)

    def markup(chosen: DataFrame) -> DataFrame:
        return places.select(*PLACE, "html").join(chosen, PLACE)

    homes = markup(newest(sites.select(F.col("site").alias("url"))).withColumnRenamed("url", "site")).select("site", "html")
    homes = cut(homes.withColumn("subpages", subpages(h.anchors("html"), F.col("site"), budget - 1)))  # read twice below
    wanted = homes.select("site", F.posexplode("subpages").alias("page_no", "url"))
    subs = markup(newest(wanted).join(wanted, "url")).select("site", (F.col("page_no") + 1).alias("page_no"), "html")
    return homes.select("site", F.lit(0).alias("page_no"), "html").unionByName(subs)


def read_page(pages: DataFrame, region: str = rules.DEFAULT_REGION) -> DataFrame:
    """Text, contacts, social links and shop platform of every page. The markup ends here: it is not shuffled again."""
    read = tx.settle(pages, {"text": h.visible_text("html"), "links": h.anchors("html"), "platform": intel.platform_rank(F.lower("html"))})
    return read.withColumns(
        {
            "emails": h.emails_of(F.col("html"), F.col("links"), F.col("text")),
            "phones": h.phones_of(F.col("html"), F.col("links"), F.col("text"), region),
            "whatsapp": h.whatsapp_numbers("html", region),
            "socials": h.social_profiles(F.col("links")),
        }
    ).withColumns(
        {n: F.try_element_at("socials", F.lit(n)) for n in ("facebook", "linkedin")}
    ).drop("links", "socials", "html")


def collect_sites(pages: DataFrame) -> DataFrame:
    """One row per site from its few read pages, everything in page order."""
    grouped = pages.groupBy("site").agg(
        F.array_sort(
            F.collect_list(F.struct("page_no", "text", "platform", "emails", "phones", "whatsapp", "facebook", "linkedin"))
        ).alias("p")
    )

    def united(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("p", lambda x: x[name])))

    def first_link(network: str) -> Column:
        return tx.first_of(F.array_compact(F.transform("p", lambda x: x[network])))

    return grouped.select(
        "site",
        F.size("p").alias("pages_read"),
        F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"),
        intel.platform_of_rank(F.array_min(F.transform("p", lambda x: x["platform"]))).alias("site_platform"),
        united("emails").alias("emails"),
        united("phones").alias("phones"),
        united("whatsapp").alias("whatsapp"),
        first_link("facebook").alias("facebook"),
        first_link("linkedin").alias("linkedin"),
    )


def site_intel(collected: DataFrame, category: str | None = None) -> DataFrame:
    """Type, intent, shop, markets and decision-maker of each site; ``category`` names a column to keep."""
    cat = F.lit(None).cast("string") if category is None else F.col(category)
    kept = [category] if category else []
    low = tx.settle(collected, {"_found": intel.phrases(F.lower("text"))})
    typed = tx.settle(
        low,
        {
            "site_type": intel.company_type(F.col("_found"), cat),
            "_store": intel.has_store(F.col("_found")),
            "markets": intel.markets(F.col("_found")),
            "contact": intel.decision_maker(F.col("text"), F.col("emails"), F.col("_found")),
            "signals": intel.intent_phrases(F.col("_found")),
        },
    )
    return typed.select(
        "site", *kept, "pages_read", "emails", "phones", "whatsapp", "facebook", "linkedin", "markets", "signals",
        "site_type", "site_platform",
        intel.site_intent(
            intel.shipping_intent(F.col("_found"), F.col("site_type")), F.col("markets"), F.col("_store")
        ).alias("site_intent"),
        (F.col("_store") | F.col("site_platform").isNotNull()).alias("site_store"),
        F.col("contact.name").alias("site_contact_name"),
        F.col("contact.role").alias("site_contact_role"),
        F.col("contact.email").alias("site_contact_email"),
    )


def crawl_intel(leads: DataFrame, pages: DataFrame, region: str = rules.DEFAULT_REGION) -> DataFrame:
    """Intelligence per (site, category) of the leads' websites.

    Pages are read once per site; the category only matters when the text names no type.
    """
    asked = leads.where(tx.has_value("website")).select(F.col("website").alias("site"), "category").distinct()
    collected = collect_sites(read_page(site_pages(asked, pages), region))
    return site_intel(collected.join(asked.withColumnRenamed("category", "asked_category"), "site"), "asked_category")


def merge_intel(leads: DataFrame, intel_rows: DataFrame) -> DataFrame:
    """Fold site intelligence into the leads; a site without a landed page changes nothing.

    The company's own site is trusted for phones: its first number on WhatsApp, else its first
    number, becomes primary and all other numbers are kept as extras.
    """
    # Leads without a site get a key of their own, so they do not pile up in one task.
    probe = F.coalesce(F.col("website"), F.concat(F.lit("\u0000"), F.col("pos").cast("string")))
    keys = (probe == F.col("site")) & F.col("category").eqNullSafe(F.col("asked_category"))
    other = intel_rows.withColumnsRenamed({"facebook": "site_facebook", "linkedin": "site_linkedin"})
    j = leads.join(other, keys, "left")
    read = F.col("pages_read").isNotNull()
    none = F.array().cast(NO_TEXTS)
    phones = F.coalesce(F.col("phones"), none)
    on_whatsapp = tx.first_of(F.filter(phones, lambda p: F.array_contains("whatsapp", p)))
    primary = F.coalesce(on_whatsapp, tx.first_of(phones))
    every = F.array_distinct(F.array_compact(F.concat(F.array(primary, F.col("phone_e164")), phones)))
    extras = F.array_distinct(F.concat(F.coalesce(F.col("extra_phones"), none), F.slice(every, 2, 1 << 30)))
    takes_role = tx.has_value("site_contact_role") & ~tx.has_value("contact_role")
    takes_linkedin = tx.has_value("site_linkedin") & ~tx.has_value("linkedin")
    first_whatsapp = tx.first_of(F.coalesce(F.col("whatsapp"), none))

    def put(links: Column, network: str, url: Column, when: Column, replace: bool) -> Column:
        held = F.coalesce(F.map_contains_key(links, network), F.lit(False))
        without = F.map_filter(links, lambda k, v: k != network)
        added = F.map_concat(without, F.create_map(F.lit(network), url))
        return F.when(when if replace else when & ~held, added).otherwise(links)

    def filled(c: str, value: Column | str) -> Column:
        return F.when(tx.has_value(c), F.col(c)).otherwise(F.col(value) if isinstance(value, str) else value)

    base_links = F.coalesce(F.col("social_links"), F.create_map().cast("map<string,string>"))
    wa_link = F.concat(F.lit("https://wa.me/"), F.regexp_replace(first_whatsapp, r"^\+", ""))
    blank_type = ~tx.has_value("company_type") | (F.col("company_type") == "Unknown")
    out = j.withColumns(
        {
            "enriched": read,
            "company_type": F.when(
                read & blank_type & (F.col("site_type") != "Unknown"), F.col("site_type")
            ).otherwise(F.col("company_type")),
            "shipping_intent": F.when(
                F.col("site_intent") > 0, F.greatest(F.coalesce("shipping_intent", F.lit(0)), F.col("site_intent"))
            ).otherwise(F.col("shipping_intent")),
            "has_online_store": F.when(F.col("site_store"), F.lit(True)).otherwise(F.col("has_online_store")),
            "store_platform": F.col("site_platform"),
            "target_markets": F.when(F.size("markets") > 0, F.col("markets")),
            "email": filled("email", tx.first_of(F.coalesce(F.col("emails"), none))),
            "facebook": filled("facebook", "site_facebook"),
            "social_links": put(
                put(base_links, "linkedin", F.col("site_linkedin"), takes_linkedin, False),
                "whatsapp", wa_link, first_whatsapp.isNotNull(), True,
            ),
            "linkedin": filled("linkedin", "site_linkedin"),
            "contact_name": F.when(takes_role, F.col("site_contact_name")).otherwise(F.col("contact_name")),
            "contact_email": F.when(takes_role, F.coalesce("site_contact_email", "contact_email")).otherwise(
                F.col("contact_email")
            ),
            "contact_role": F.when(takes_role, F.col("site_contact_role")).otherwise(F.col("contact_role")),
            "extra_phones": F.when(F.size(phones) > 0, extras).otherwise(F.col("extra_phones")),
            "phone_raw": F.when(F.size(phones) > 0, filled("phone_raw", primary)).otherwise(F.col("phone_raw")),
            "phone_e164": F.when(F.size(phones) > 0, primary).otherwise(F.col("phone_e164")),
        }
    )
    drop = [c for c in other.columns if c not in leads.columns]
    return out.drop(*drop)


def with_contact_columns(leads: DataFrame) -> DataFrame:
    """Contact columns a lead gains only by enrichment, as blanks."""
    return leads.withColumns(
        {c: F.lit(None).cast("string") for c in ("contact_name", "contact_role", "contact_email") if c not in leads.columns}
    )


def rate_before_and_after(classified: DataFrame, pages: DataFrame, **rating) -> DataFrame:
    """Rated leads after enrichment with the tier each one had before, both in one row."""
    from leadloom.operators.qualify import rate

    before = rate(classified, **rating).withColumn("tier_before", F.col("tier"))
    before = before.drop("outcome", "reason", "segment", "score", "tier", "score_reasons", "is_competitor", "enriched", "store_platform", "target_markets")
    return rate(enrich(before, pages), **rating)


def enrich(leads: DataFrame, pages: DataFrame, region: str = rules.DEFAULT_REGION) -> DataFrame:
    """Read the landed websites of the leads and merge what they say."""
    ready = with_contact_columns(leads)
    return merge_intel(ready, crawl_intel(ready, pages, region))

"""Export table and append-only feed of new contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import text as tx
from leadloom.functions.phone import e164
from leadloom.sources import key_index


def export_table(leads: DataFrame) -> DataFrame:
    """Sales export: fixed columns in fixed order, lists as text."""
    special = {
        "whatsapp": tx.whatsapp_number("social_links"),
        "extra_phones": F.array_join("extra_phones", ", "),
        "target_markets": F.array_join("target_markets", ", "),
        "sources_seen": F.array_join("sources_seen", ","),
    }
    return leads.select(*[special.get(f, F.col(f)).alias(h) for f, h in rules.EXPORT_COLUMNS.items()])


def export_links(export: DataFrame) -> DataFrame:
    """Clickable addresses of the link columns; blank cells give no link."""

    def web(header: str) -> Column:
        c = F.col(header)
        return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))

    wa = F.concat(F.lit("https://wa.me/"), F.regexp_replace("WhatsApp", r"^\++", ""))
    built = {"Website": web("Website"), "Source URL": F.col("Source URL"), "WhatsApp": wa,
             "Facebook": web("Facebook"), "LinkedIn": web("LinkedIn")}
    return export.withColumns(
        {f"{h} Link": F.when(tx.has_value(F.col(h)) & (F.col(h) != "None"), v) for h, v in built.items()}
    )


def overwrite_rows(export: DataFrame) -> DataFrame:
    """Rows for a full overwrite: all text, nulls blank."""
    return export.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in export.columns])


def feed_values(today: Column) -> dict[str, Column]:
    """Text value of every known feed header."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    # A zero intent shows blank, a zero score shows 0.
    intent = F.when(F.col("shipping_intent") != 0, F.col("shipping_intent").cast("string")).otherwise("")
    return {
        "Company": plain("company_name"), "Phone": plain("phone_e164"),
        "WhatsApp": F.coalesce(tx.whatsapp_number("social_links"), F.lit("")),
        "Extra Phones": tx.list_text("extra_phones"), "Email": plain("email"), "Website": plain("website"),
        "Category": plain("category"), "Type": plain("company_type"), "Intent": F.coalesce(intent, F.lit("")),
        "Markets": tx.list_text("target_markets"), "City": plain("city"), "Country": plain("country"),
        "Address": plain("address"), "Score": plain("score"), "Tier": plain("tier"), "Status": F.lit("new"),
        "Facebook": plain("facebook"), "LinkedIn": plain("linkedin"), "Product Type": plain("product_type"),
        "Store Platform": plain("store_platform"), "Contact Name": plain("contact_name"),
        "Contact Role": plain("contact_role"), "Contact Email": plain("contact_email"),
        "Segment": plain("segment"), "Source": plain("source"), "Added Date": today.cast("string"),
    }


def full_header(header: list[str] | None) -> list[str]:
    """Header of the feed: the default when empty, else with the missing added columns at the end."""
    if not header:
        return rules.FEED_HEADER + rules.FEED_ADDED
    return header + [c for c in rules.FEED_ADDED if c not in header]


def aligned_rows(leads: DataFrame, header: list[str], today: Column) -> DataFrame:
    """Leads laid out along an external header.

    The first column of a known name is filled; manual columns and repeated names stay blank.
    A repeated name gets its column number as suffix, since a table needs distinct names.
    """
    values = feed_values(today)
    out, used = [], set()
    for i, name in enumerate(header):
        first = name not in used
        used.add(name)
        value = values[name] if first and name in values else F.lit("")
        out.append(value.alias(name if first else f"{name}_{i + 1}"))
    return leads.select("lead_id", *out)


def known_keys(tabs: list[DataFrame]) -> DataFrame:
    """Distinct contact keys of the given tabs (columns Phone, Website, Email where present)."""
    parts = []
    for tab in tabs:
        cols = []
        if "Phone" in tab.columns:
            cols.append(e164("Phone"))
        if "Website" in tab.columns:
            cols.append(tx.site_domain("Website"))
        if "Email" in tab.columns:
            mail = tx.lead_email_key("Email")
            cols.append(F.when(F.contains(mail, F.lit("@")), mail))
        if cols:
            parts.append(tab.select(F.explode(F.array_compact(F.array(*cols))).alias("key")))
    if not parts:
        return tabs[0].sparkSession.createDataFrame([], "key string")
    return reduce(DataFrame.unionByName, parts).distinct()


def lead_keys() -> Column:
    """Contact keys of a lead: phone, domain, lower-cased e-mail."""
    return F.array_compact(
        F.array(tx.null_if_empty("phone_e164"), tx.null_if_empty("domain"), tx.lead_email_key("email"))
    )


def flag_new(leads: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``is_new``: not delivered before and no contact key already known.

    Keys are exploded and matched by an equi-join, since one OR-condition over three keys would
    compare all pairs.
    """
    fresh = leads.where(~F.coalesce(F.col("pushed_to_sheet"), F.lit(False)))
    met = (
        fresh.select("lead_id", F.explode(lead_keys()).alias("key"))
        .join(known.select("key"), "key", "left_semi")
        .select("lead_id")
        .distinct()
        .withColumn("_met", F.lit(True))
    )
    pushed = F.coalesce(F.col("pushed_to_sheet"), F.lit(False))
    return leads.join(met, "lead_id", "left").withColumn(
        "is_new", ~pushed & ~F.coalesce(F.col("_met"), F.lit(False))
    ).drop("_met")


def new_leads(leads: DataFrame, known: DataFrame) -> DataFrame:
    """Leads to append; two new leads sharing a key both pass."""
    return flag_new(leads, known).where("is_new").drop("is_new")


def append_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("is_new").alias("appended"), F.count_if(~F.col("is_new")).alias("skipped"), F.count(F.lit(1)).alias("seen")
    )


def index_feed(spark: SparkSession, feed_path: str, done: list[key_index.Part] | None = None) -> tuple[str, list[key_index.Part]]:
    """Bring the key index beside a feed up to date and return its path and parts: only files it does not name yet are read."""
    index = f"{feed_path.rstrip('/')}.keys"
    done = key_index.parts(spark, index) if done is None else done
    covered = {f for p in done for f in p.files}
    fresh = [n for n in key_index.names(spark, feed_path, "part-") if n not in covered]
    if fresh:
        rows = spark.read.option("mergeSchema", "true").parquet(*[f"{feed_path}/{n}" for n in fresh])
        done = key_index.add(spark, index, known_keys([rows]), fresh, [c for c in rows.columns if c != "lead_id"], done)
    return index, done


def _flagged(leads: DataFrame, index: str, done: list[key_index.Part], other_tabs: list[DataFrame]) -> DataFrame:
    asked = leads.where(~F.coalesce("pushed_to_sheet", F.lit(False))).select(F.explode(lead_keys()).alias("key"))
    known = key_index.known(leads.sparkSession, index, asked, done)
    return flag_new(leads, known.union(known_keys(other_tabs)) if other_tabs else known)


def flag_new_for(leads: DataFrame, feed_path: str, other_tabs: list[DataFrame]) -> DataFrame:
    """``flag_new`` against a feed and other tabs: of the feed only the buckets are read that may hold the leads' keys."""
    return _flagged(leads, *index_feed(leads.sparkSession, feed_path), other_tabs)


def append_new(leads: DataFrame, feed_path: str, other_tabs: list[DataFrame], today: Column, header: list[str] | None = None) -> None:
    """Append the new leads to the feed table; rows already there are never touched, nor read.

    Keys are looked up in the index beside the feed; columns are those of the last append, later ones at the end.
    """
    spark = leads.sparkSession
    index, done = index_feed(spark, feed_path)
    chosen = _flagged(leads, index, done, other_tabs).where("is_new").drop("is_new")
    aligned_rows(chosen, full_header(done[-1].columns if done else header), today).write.mode("append").parquet(feed_path)
    index_feed(spark, feed_path, done)

"""Working-list views and keyed updates of stored leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import text as tx
from leadloom.operators.report import due


def crm_view(leads: DataFrame) -> DataFrame:
    """Columns of the sales view, blanks for nulls."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return leads.select(
        "lead_id",
        F.col("company_name").alias("company"),
        F.col("phone_e164").alias("phone"),
        "city", "category", "score", "tier",
        tx.reason_text("score_reasons").alias("why"),
        blank("company_type").alias("type"),
        F.col("shipping_intent").alias("intent"),
        tx.status_label("status").alias("status_label"),
        F.coalesce(tx.null_if_empty(F.array_join("sources_seen", ",")), F.col("source"), F.lit("")).alias("sources"),
        blank("assigned_to").alias("assigned_to"),
        "last_contact_date", "next_followup_date",
        blank("notes").alias("notes"),
    )


def quarantine_view(leads: DataFrame) -> DataFrame:
    """Columns of the review list."""
    pairs = {"phone": "phone_e164", "email": "email", "website": "website", "source": "source"}
    return leads.where(F.col("status") == rules.QUARANTINED).select(
        "lead_id", F.col("company_name").alias("company"), F.col("quarantine_reason").alias("reason"),
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in pairs.items()],
    )


def filter_view(
    leads: DataFrame, tiers: list[str], statuses: list[str], assigned: str = "", company: str = "",
    due_by: Column | None = None,
) -> DataFrame:
    """Filters of the sales view; the two text boxes are case-insensitive patterns."""
    view = leads.where(F.col("tier").isin(tiers) & F.col("status").isin(statuses))
    if assigned:
        view = view.where(F.rlike(F.coalesce("assigned_to", F.lit("")), F.lit(f"(?iu){assigned}")))
    if company:
        view = view.where(F.rlike("company_name", F.lit(f"(?iu){company}")))
    return view if due_by is None else view.where(due(due_by))


def apply_changes(leads: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Update the CRM fields of the leads named in ``changes(lead_id, field columns)``.

    Only whitelisted fields are taken; an unknown id changes nothing; the row with the highest ``seq``
    per id wins. Without ``seq`` an id may be named once only.
    """
    fields = [c for c in rules.CRM_FIELDS if c in changes.columns]
    if "seq" in changes.columns:
        change = changes.groupBy("lead_id").agg(F.max_by(F.struct(*fields), "seq").alias("c"))
    else:
        once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("several changes without seq for lead "), F.col("lead_id").cast("string"))))
        change = changes.groupBy("lead_id").agg(F.max(F.struct(*fields)).alias("c"), once.alias("_once")).where(F.col("_once").isNull()).drop("_once")
    joined = leads.join(change, "lead_id", "left")
    hit = F.col("c").isNotNull()
    return joined.withColumns(
        {**{f: F.when(hit, F.col(f"c.{f}")).otherwise(F.col(f)) for f in fields},
         "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    ).drop("c")


def mark_pushed(leads: DataFrame, pushed: DataFrame, now: Column) -> DataFrame:
    """Flag the leads listed in ``pushed(lead_id)`` as delivered."""
    ids = pushed.select("lead_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return leads.join(ids, "lead_id", "left").withColumns(
        {
            "pushed_to_sheet": hit | F.coalesce(F.col("pushed_to_sheet"), F.lit(False)),
            "sheet_synced_at": F.when(hit, now).otherwise(F.col("sheet_synced_at")),
        }
    ).drop("_hit")

"""Whole runs: a search run over landed listings, and the unattended daily run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.operators import report
from leadloom.operators.crm import mark_pushed
from leadloom.operators.enrich import enrich, with_contact_columns
from leadloom.operators.firsts import cap_per_source
from leadloom.operators.qualify import RAW_FIELDS, conform, qualify
from leadloom.operators.sync import append_new, flag_new_for
from leadloom.plans.matrix import daily_requests
from leadloom.session import cut
from leadloom.sources.lead_table import fold_into_table, leads_by_id, read_leads, replace_leads
from leadloom.sources.sinks import append_run

def run_search(
    listings: DataFrame,
    leads_path: str,
    runs_path: str,
    *,
    run_id: int,
    sources: DataFrame,
    started: Column,
    finished: Column,
    max_results: int | None = 100,
    pages: DataFrame | None = None,
    errors: DataFrame | None = None,
    params: dict | None = None,
    **rating,
) -> DataFrame:
    """One run: cap per source (None: capped before), qualify (with ``pages`` also enrich), fold into the lead table, log.

    ``listings`` carry ``pos``; ``sources(source)`` are the sources asked, so silent ones are
    logged as empty; ``errors(source, error)`` are those that failed. Returns the run-log row.
    """
    asked = conform(listings).join(sources.select("source").distinct(), "source", "left_semi")
    reading = None if pages is None else lambda df: enrich(with_contact_columns(df), pages)
    rated = cut(qualify(asked if max_results is None else cap_per_source(asked, max_results), enrich=reading, **rating))
    placed = fold_into_table(rated, leads_path, run_id=run_id, now=started)
    flagged = rated.select("pos", "source", "outcome", "reason").join(placed, "pos", "left")
    stats = report.source_stats(flagged, sources, errors)
    folded = flagged.where("outcome = 'keep'").groupBy("source").agg(
        F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("updated")
    )
    row = report.run_row(stats.join(folded, "source", "left"), run_id, started, finished, params or {})
    append_run(row, runs_path)
    return row


def swept_listings(listings: DataFrame, day: int, plan: dict = rules.PLAN) -> DataFrame:
    """The listings that a day's run takes: the councils' members, and what the directories answered to the requests due.

    ``listings`` carry ``pos``, ``source`` and ``request_no``, the index of the request a page was asked for (null for
    sources asked without one). Their own category and city may be others than the request's. The cap of the
    plan holds for each source, and for directories for each request and source.
    """
    due = daily_requests(listings.sparkSession, day, plan).select(F.col("idx").alias("request_no"))
    councils = listings.where(F.col("source").isin(plan["council_sources"])).withColumn("request_no", F.lit(None).cast("long"))
    directories = listings.where(F.col("source").isin(plan["directory_sources"])).join(due, "request_no", "left_semi")
    rows = councils.unionByName(directories.select(councils.columns))
    return cap_per_source(rows, plan["max_results_per_source"], keys=("request_no", "source"))


def daily_run(
    listings: DataFrame,
    leads_path: str,
    runs_path: str,
    feed_path: str,
    *,
    day: dt.date,
    run_id: int,
    pages: DataFrame | None = None,
    other_tabs: list[DataFrame] | None = None,
    plan: dict = rules.PLAN,
    **options,
) -> DataFrame:
    """The unattended run of a day: councils and all due requests in one job, then new contacts to the feed.

    See ``swept_listings`` for what takes part. ``pages``, landed pages of the listings' websites, are read
    if the plan says ``enrich``.
    """
    spark = listings.sparkSession
    stamp = F.lit(dt.datetime.combine(day, dt.time())).cast("timestamp_ntz")
    asked = spark.createDataFrame([(x,) for x in [*plan["council_sources"], *plan["directory_sources"]]], "source string")
    row = run_search(
        swept_listings(conform(listings, {**RAW_FIELDS, "request_no": "long"}), day.toordinal(), plan), leads_path, runs_path, run_id=run_id, sources=asked, started=stamp,
        finished=stamp, max_results=None, pages=pages if plan["enrich"] else None, **options,
    )
    leads = read_leads(spark, leads_path)
    today = F.lit(day.isoformat())
    fresh = cut(flag_new_for(leads, feed_path, list(other_tabs or [])).where("is_new").select("lead_id"))
    append_new(leads.join(fresh, "lead_id", "left_semi"), feed_path, list(other_tabs or []), today)
    replace_leads(mark_pushed(leads_by_id(spark, leads_path, fresh), fresh, stamp), leads_path)
    return row

"""Incremental jobs run over the tables as they have landed; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import rules
from leadloom.operators.sync import append_new
from leadloom.queries.base import AS_OF, COUNTS_SQL, CRM_SQL, EVENTS_SQL, FILTERS, crm_leads, raw_listings, table
from leadloom.queries.entities import _lead_columns, leads_sql
from leadloom.session import cut, shared_path
from leadloom.sources.sinks import read_leads
from leadloom.streaming import jobs

DAY = "2002-01-01"


def _landed(spark, d, name: str):
    """A given table read as a stream of landed files."""
    return jobs.read_landed(spark, d, table(spark, d, name).schema, glob=f"{name}.parquet")


def page_landings(spark, d):
    """Pages as they land: each again some hours or days later, so repeats lie inside and beyond the time to live."""
    again = F.explode(F.sequence(F.lit(0), F.col("page_id") % 4)).alias("turn")
    pages = table(spark, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url"), "page_id", "html", again)
    hours = F.col("turn") * (F.col("page_id") % 5 + 1) * 6
    first = F.timestamp_add("MINUTE", F.col("page_id") * 7, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return pages.withColumn("fetched_at", F.timestamp_add("HOUR", hours, first)).drop("turn")


def streamed_pages(spark, d):
    """Pages ingested as they land in three runs of one job: the first landing of an address, and each that comes when the
    last one kept has outlived its time to live."""
    landing, out, state = (shared_path(spark, n) for n in ("landing", "ingested", "state"))
    landings = cut(page_landings(spark, d))
    ends = landings.agg(F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high")).first()
    third = (ends.high - ends.low) / 3 if ends.low else None
    for turn in range(3 if third else 0):
        since, until = (F.lit(ends.low + third * k) for k in (turn, turn + 1))
        part = landings.where((F.col("fetched_at") >= since) & ((F.col("fetched_at") < until) | F.lit(turn == 2)))
        part.write.mode("append").parquet(landing)
        jobs.ingest_pages(spark, landing, landings.schema, out, state)
    return spark.read.parquet(out).select("url", "fetched_at", F.md5("html").alias("html_hash"))


def late_pages(spark, d):
    """Landings kept of those that came in one run, their files in no order of time."""
    landing = shared_path(spark, "landing")
    page_landings(spark, d).select("url", "fetched_at").repartition(7, F.col("fetched_at")).write.parquet(landing)
    stream = jobs.read_landed(spark, landing, spark.read.parquet(landing).schema)
    return jobs.run_available(jobs.page_stream(stream))


def _outcomes(spark, d):
    return _landed(spark, d, "events").selectExpr(
        "cast(ts AS timestamp) AS ts", "concat('src', user_id % 5) AS source",
        "CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 'keep' WHEN event_type = 'click' THEN 'drop' ELSE 'quarantine' END AS outcome",
    )


def streamed_daily_yield(spark, d):
    """Counters per source and finished day; the last days are still open and come with ``streamed_daily_progress``."""
    return jobs.run_available(jobs.daily_yield_stream(_outcomes(spark, d))).withColumn("day", F.to_date("day"))


def streamed_daily_progress(spark, d):
    """Counters per source and day as they stand, open days included."""
    return jobs.run_latest(jobs.daily_yield_stream(_outcomes(spark, d)), ["day", "source"]).withColumn("day", F.to_date("day"))


def streamed_leads(spark, d):
    """Lead table after listings that landed as files were qualified and folded."""
    landing, leads, state = (shared_path(spark, n) for n in ("listings", "leads", "state"))
    raw_listings(spark, d).write.parquet(landing)
    stream = jobs.read_landed(spark, landing, spark.read.parquet(landing).schema)
    jobs.upsert_batches(stream, leads, state, filters=FILTERS, as_of=AS_OF)
    return _lead_columns(read_leads(spark, leads, with_quarantined=True).withColumn("sightings", F.lit(0))).drop("sightings")


def streamed_feed(spark, d):
    """Contact feed after leads that landed as files were appended."""
    landing, feed, state = (shared_path(spark, n) for n in ("crm", "feed", "state"))
    crm_leads(spark, d).write.parquet(landing)
    stream = jobs.read_landed(spark, landing, spark.read.parquet(landing).schema)
    jobs.feed_batches(stream, feed, state, F.lit(DAY).cast("date"))
    return spark.read.parquet(feed).select("lead_id", "Company", "Phone")


def feed_in_batches(spark, d):
    """Contact feed after ten appends: a lead with a contact of an earlier batch is left out."""
    feed, leads = shared_path(spark, "feed"), cut(crm_leads(spark, d))
    for batch in range(10):
        append_new(leads.where(F.pmod("lead_id", F.lit(10)) == batch), feed, [], F.lit(DAY).cast("date"))
    return spark.read.parquet(feed).select("lead_id", "Company", "Phone")


LANDINGS_SQL = f"""WITH RECURSIVE l AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id, html,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7 AS INT)) + to_hours(CAST(j * (page_id % 5 + 1) * 6 AS INT)) AS fetched_at
        FROM pages, UNNEST(range(page_id % 4 + 1)) u(j)),
    k AS (SELECT url, min(fetched_at) AS fetched_at FROM l GROUP BY url
        UNION ALL SELECT url, min(l.fetched_at) FROM k JOIN l USING (url) WHERE l.fetched_at >= k.fetched_at + INTERVAL {rules.PAGE_TTL_SECONDS} SECONDS GROUP BY url)"""

QUERIES = {
    "streamed_pages": (streamed_pages, f"""{LANDINGS_SQL} SELECT url, fetched_at, md5(html) AS html_hash FROM k JOIN l USING (url, fetched_at)
        QUALIFY row_number() OVER (PARTITION BY url, fetched_at ORDER BY page_id) = 1"""),
    "late_pages": (late_pages, f"{LANDINGS_SQL} SELECT url, fetched_at FROM k"),
    "streamed_daily_yield": (streamed_daily_yield, f"WITH {EVENTS_SQL} SELECT day, source, {COUNTS_SQL} FROM ev WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL"),
    "streamed_daily_progress": (streamed_daily_progress, f"WITH {EVENTS_SQL} SELECT day, source, {COUNTS_SQL} FROM ev GROUP BY ALL"),
    "streamed_leads": (streamed_leads, leads_sql(False)),
    "streamed_feed": (streamed_feed, f"""WITH {CRM_SQL} SELECT lead_id, company_name AS "Company", coalesce(phone_e164, '') AS "Phone" FROM crm WHERE NOT pushed_to_sheet"""),
    "feed_in_batches": (feed_in_batches, f"""WITH RECURSIVE {CRM_SQL}, c AS (SELECT lead_id, company_name, phone_e164, list_filter([phone_e164, domain, lower(email)], lambda v: v <> '') AS keys FROM crm WHERE NOT pushed_to_sheet),
        f(k, keys, ids) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])
            UNION ALL SELECT k + 1, list_concat(f.keys, (SELECT coalesce(flatten(list(c.keys)), []) FROM c WHERE c.lead_id % 10 = f.k AND NOT list_has_any(c.keys, f.keys))),
                list_concat(f.ids, (SELECT coalesce(list(c.lead_id), []) FROM c WHERE c.lead_id % 10 = f.k AND NOT list_has_any(c.keys, f.keys))) FROM f WHERE k < 10)
        SELECT lead_id, company_name AS "Company", coalesce(phone_e164, '') AS "Phone" FROM c WHERE lead_id IN (SELECT unnest(ids) FROM f WHERE k = 10)"""),
}

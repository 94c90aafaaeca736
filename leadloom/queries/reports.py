"""Queries over run records (``events``) and sales-stage rows (``orders``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.functions import text as tx
from leadloom.operators import crm
from leadloom.operators import report as rp
from leadloom.queries import sqltext as s
from leadloom.queries.base import (
    AS_OF, COUNTS_SQL, CRM_SQL, EVENTS_SQL, crm_leads, processed_events, raw_listings, table,
)


DAY_SQL = f"DATE '{AS_OF.isoformat()}'"
SOURCES = [f"src{i}" for i in range(7)]


def run_totals(spark, d):
    return rp.run_totals(processed_events(spark, d), "day")


def reason_histogram(spark, d):
    return rp.reason_histogram(processed_events(spark, d), "day")


def reason_maps(spark, d):
    """Reasons of each outcome packed into one map, written out as text."""
    entries = F.array_sort(F.map_entries("reasons"))
    maps = rp.reason_maps(processed_events(spark, d))
    return maps.select("outcome", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("reasons"))


def source_errors(events: DataFrame, *by: str) -> DataFrame:
    """Last error text per source."""
    return events.where("error IS NOT NULL").groupBy(*by, "source").agg(F.max_by("error", "event_id").alias("error"))


def asked_sources(spark, d) -> DataFrame:
    """Sources that were asked: those of the customers' nations, plus two that never answer."""
    real = raw_listings(spark, d).select("source").distinct()
    silent = real.select(F.concat(F.lit("silent_"), F.col("source")).alias("source")).where("source IN ('silent_src1', 'silent_src2')")
    return real.unionByName(silent)


def source_stats(spark, d):
    """Counters and health per asked source; src2 is taken as having failed."""
    events = processed_events(spark, d)
    errors = source_errors(events).where("source IN ('src2', 'src4')")
    return rp.source_stats(events, asked_sources(spark, d), errors)


def stats_as_map(spark, d):
    return rp.stats_map(source_stats(spark, d)).select(F.size("source_stats").alias("sources"), F.col("source_stats")["src1"]["found"].alias("src1_found"))


def run_log_row(spark, d):
    """The run-log row of the whole table as one run."""
    row = rp.run_row(
        source_stats(spark, d), 1, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-02-01 01:00:00").cast("timestamp_ntz"),
        {"country": "Egypt", "city": None, "max_results": 30},
    )
    return row.select("run_id", "found", "kept", "dropped", "quarantined", "status", "error", F.size("source_stats").alias("sources"),
                      F.try_element_at("params", F.lit("country")).alias("country"))


def hourly_runs(spark, d) -> DataFrame:
    """Run log with one run per hour: statistics per source as a map."""
    events = processed_events(spark, d)
    stats = events.groupBy("run_id", "source").agg(*rp.outcome_counts(), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("event_id"))).alias("error"))
    stats = stats.withColumns({"errors": F.col("error").isNotNull().cast("int"), "health": rp.health(F.col("found"), F.col("error"))})
    runs = rp.stats_map(stats, "run_id")
    started = F.timestamp_seconds(F.col("run_id") * 3600).cast("timestamp_ntz")
    return runs.select("run_id", started.alias("started_at"), F.when(F.col("run_id") % 3 != 0, started + F.expr("INTERVAL 20 MINUTES")).alias("finished_at"), "source_stats")


def newest_runs(spark, d):
    return rp.newest_runs(hourly_runs(spark, d)).select("run_id", F.size("source_stats").alias("sources"))


def health_rollup(spark, d):
    rows = rp.health_rollup(hourly_runs(spark, d))
    return rows.select("source", "health", "yield", F.col("last_success").cast("string").alias("last_success"), F.col("last_run").cast("string").alias("last_run"))


def health_table(spark, d):
    return health_rollup(spark, d).orderBy("source")


def failing_sources(spark, d):
    return rp.failing_sources(rp.health_rollup(hourly_runs(spark, d)))


def newest_stat_per_source(spark, d):
    rows = hourly_runs(spark, d).select("run_id", "started_at", F.explode("source_stats").alias("source", "stat"))
    return rp.newest_per_source(rows).select("source", "run_id", F.col("stat.found").alias("found"), F.col("stat.health").alias("health"))


def sweep_rollup(spark, d):
    """Days taken as requests of one sweep: totals over all of them."""
    per_day = rp.run_totals(processed_events(spark, d), "day")
    return rp.rollup_requests(per_day)


def sweep_reasons(spark, d):
    return rp.reason_histogram(processed_events(spark, d))


def sweep_errors(spark, d):
    events = processed_events(spark, d)
    return rp.last_errors(source_errors(events, "run_id").withColumn("request_no", F.col("run_id")))


def blocked_errors(spark, d):
    rows = processed_events(spark, d).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("error", "n", tx.looks_blocked("error").alias("blocked"))


def stage_funnel(spark, d):
    return rp.funnel(crm_leads(spark, d)).select("ord", "status", "label", "n")


def tier_counts(spark, d):
    return rp.tier_counts(crm_leads(spark, d)).select("tier", "n")


def type_counts(spark, d):
    return rp.type_counts(crm_leads(spark, d))


def mean_intent(spark, d):
    return rp.mean_intent(crm_leads(spark, d)).select(F.round("mean_intent", 6).alias("mean_intent"))


def conversion(spark, d):
    leads = crm_leads(spark, d).where(F.col("status") != rules.QUARANTINED)
    return rp.conversion(leads, F.lit(AS_OF)).withColumn("conversion", F.round("conversion", 6))


def crm_working_list(spark, d):
    return rp.ranked_list(crm_leads(spark, d)).select("lead_id", "company_name", "score", "tier", "status")


def review_list(spark, d):
    return rp.review_list(crm_leads(spark, d)).select("lead_id", "company_name", "quarantine_reason", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def crm_view(spark, d):
    return crm.crm_view(rp.ranked_list(crm_leads(spark, d))).drop("last_contact_date")


def quarantine_view(spark, d):
    return crm.quarantine_view(crm_leads(spark, d))


def filtered_view(spark, d):
    """Hot and medium open leads of one salesperson, company by pattern."""
    rows = crm.filter_view(crm_leads(spark, d), ["Hot", "Medium"], ["new", "interested", "negotiation"], assigned="^a.r", company="y 1.*(trad|co$)")
    return rows.select("lead_id", "company_name", "tier", "status", "assigned_to")


def due_followups(spark, d):
    when = dt.date(1998, 1, 1)
    rows = crm.filter_view(crm_leads(spark, d), ["Hot", "Medium", "Weak"], list(rules.STATUS_LABELS), due_by=F.lit(when))
    return rows.select("lead_id", "status", "next_followup_date")


def changed_leads(spark, d):
    """Stage changes of a day applied to the leads; unknown ids change nothing."""
    leads = crm_leads(spark, d)
    changes = table(spark, d, "lineitem").where("l_linenumber <= 2 AND l_returnflag = 'R'").selectExpr(
        "l_orderkey * 2 AS lead_id", "IF(l_linenumber = 1, 'contacted', 'won') AS status", "concat('note ', l_linenumber) AS notes",
        "l_linenumber * 1000000000 + l_partkey AS seq", "'x' AS score",
    )
    rows = crm.apply_changes(leads, changes, F.lit("2002-01-01").cast("timestamp_ntz"))
    return rows.select("lead_id", "status", "notes", "score", (F.year("updated_at") == 2002).alias("changed"))


def pushed_leads(spark, d):
    """Leads named by line items flagged as delivered."""
    pushed = table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_linenumber = 1").select(F.col("l_orderkey").alias("lead_id"))
    rows = crm.mark_pushed(crm_leads(spark, d), pushed, F.lit("2002-01-01").cast("timestamp_ntz"))
    return rows.groupBy("pushed_to_sheet", F.col("sheet_synced_at").isNotNull().alias("stamped")).agg(F.count(F.lit(1)).alias("n"))


def status_round_trip(spark, d):
    rows = crm_leads(spark, d).select("status").withColumn("label", tx.status_label("status"))
    return rows.select("status", "label", tx.status_of_label("label").alias("back")).groupBy("status", "label", "back").agg(F.count(F.lit(1)).alias("n"))


LABEL_CASE = "CASE status " + " ".join(f"WHEN {s.q(k)} THEN {s.q(v)}" for k, v in rules.STATUS_LABELS.items()) + " ELSE status END"
E = f"WITH {EVENTS_SQL}"
C = f"WITH {CRM_SQL}"
BLOCKED = s.any_of("lower(error)", rules.BLOCK_SIGNALS)
HEALTH = f"CASE WHEN error IS NOT NULL AND {BLOCKED} THEN 'blocked' WHEN error IS NOT NULL THEN 'error' WHEN found > 0 THEN 'ok' ELSE 'empty' END"
STATS_SQL = f"""{E}, asked AS (SELECT DISTINCT 'src' || (c_nationkey % 5) AS source FROM customer UNION ALL VALUES ('silent_src1'), ('silent_src2')),
 n AS (SELECT source, {COUNTS_SQL} FROM ev GROUP BY 1), er AS (SELECT source, arg_max(error, event_id) AS error FROM ev WHERE error IS NOT NULL AND source IN ('src2', 'src4') GROUP BY 1),
 st0 AS (SELECT source, coalesce(found, 0) AS found, coalesce(kept, 0) AS kept, coalesce(dropped, 0) AS dropped, coalesce(quarantined, 0) AS quarantined, error
   FROM asked LEFT JOIN n USING (source) LEFT JOIN er USING (source)),
 st AS (SELECT *, CAST(error IS NOT NULL AS INT) AS errors, {HEALTH} AS health FROM st0)"""
RUNS_SQL = f"""{E}, rs0 AS (SELECT run_id, source, {COUNTS_SQL}, arg_max(error, event_id) FILTER (error IS NOT NULL) AS error FROM ev GROUP BY 1, 2),
 rs AS (SELECT *, {HEALTH} AS health, CASE WHEN run_id % 3 <> 0 THEN make_timestamp(CAST(run_id AS BIGINT) * 3600000000) + INTERVAL 20 MINUTE ELSE make_timestamp(CAST(run_id AS BIGINT) * 3600000000) END AS ran_at FROM rs0),
 top AS (SELECT DISTINCT run_id FROM rs ORDER BY run_id DESC LIMIT 100), t AS (SELECT rs.* FROM rs JOIN top USING (run_id)),
 roll AS (SELECT source, arg_max(health, run_id) AS health, CAST(sum(kept) AS BIGINT) AS yield, CAST(arg_max(ran_at, run_id) FILTER (found > 0) AS VARCHAR) AS last_success,
   CAST(arg_max(ran_at, run_id) AS VARCHAR) AS last_run FROM t GROUP BY 1)"""

QUERIES = {
    "run_totals": (run_totals, f"{E} SELECT day, {COUNTS_SQL}, count(*) FILTER (outcome = 'keep' AND created) AS created, count(*) FILTER (outcome = 'keep' AND NOT created) AS updated FROM ev GROUP BY day"),
    "reason_histogram": (reason_histogram, f"{E} SELECT day, outcome, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM ev WHERE outcome <> 'keep' GROUP BY ALL"),
    "reason_maps": (reason_maps, f"{E}, n AS (SELECT outcome, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM ev WHERE outcome <> 'keep' GROUP BY 1, 2) SELECT outcome, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM n GROUP BY outcome"),
    "source_stats": (source_stats, f"{STATS_SQL} SELECT * FROM st"),
    "stats_as_map": (stats_as_map, f"{STATS_SQL} SELECT CAST(count(*) AS INT) AS sources, max(found) FILTER (source = 'src1') AS src1_found FROM st"),
    "run_log_row": (run_log_row, f"""{STATS_SQL} SELECT 1 AS run_id, CAST(sum(found) AS BIGINT) AS found, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(dropped) AS BIGINT) AS dropped,
        CAST(sum(quarantined) AS BIGINT) AS quarantined, CASE WHEN sum(errors) > 0 THEN 'done_with_errors' ELSE 'done' END AS status,
        string_agg(source || ': ' || error, '; ' ORDER BY source) AS error, CAST(count(*) AS INT) AS sources, 'Egypt' AS country FROM st"""),
    "newest_runs": (newest_runs, f"{E} SELECT run_id, CAST(count(DISTINCT source) AS INT) AS sources FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 100"),
    "health_rollup": (health_rollup, f"{RUNS_SQL} SELECT * FROM roll"),
    "health_table": (health_table, f"{RUNS_SQL} SELECT * FROM roll ORDER BY source"),
    "failing_sources": (failing_sources, f"{RUNS_SQL} SELECT coalesce(string_agg(source, {s.q(rules.REASON_SEPARATOR)} ORDER BY source) FILTER (health IN ('blocked', 'error')), '') AS failing, coalesce(string_agg(source, {s.q(rules.REASON_SEPARATOR)} ORDER BY source) FILTER (health = 'empty'), '') AS empty FROM roll"),
    "newest_stat_per_source": (newest_stat_per_source, f"{RUNS_SQL} SELECT source, run_id, found, health FROM rs QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_id DESC) = 1"),
    "sweep_rollup": (sweep_rollup, f"{E} SELECT count(DISTINCT day) AS requests, {COUNTS_SQL}, count(*) FILTER (outcome = 'keep' AND created) AS created, count(*) FILTER (outcome = 'keep' AND NOT created) AS updated FROM ev"),
    "sweep_reasons": (sweep_reasons, f"{E} SELECT outcome, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM ev WHERE outcome <> 'keep' GROUP BY ALL"),
    "sweep_errors": (sweep_errors, f"{E}, p AS (SELECT run_id, source, arg_max(error, event_id) AS error FROM ev WHERE error IS NOT NULL GROUP BY 1, 2) SELECT source, arg_max(error, run_id) AS error FROM p GROUP BY 1"),
    "blocked_errors": (blocked_errors, f"{E} SELECT error, count(*) AS n, coalesce({BLOCKED}, false) AS blocked FROM ev GROUP BY error"),
    "stage_funnel": (stage_funnel, f"{C}, st AS (SELECT unnest({list(rules.STATUS_LABELS)}) AS status, unnest(range({len(rules.STATUS_LABELS)})) AS ord) SELECT CAST(ord AS INT) AS ord, status, {LABEL_CASE} AS label, (SELECT count(*) FROM crm WHERE crm.status = st.status) AS n FROM st"),
    "tier_counts": (tier_counts, f"{C} SELECT tier, count(*) AS n FROM crm GROUP BY tier"),
    "type_counts": (type_counts, f"{C} SELECT company_type, count(*) AS n FROM crm WHERE company_type IS NOT NULL GROUP BY 1"),
    "mean_intent": (mean_intent, f"{C} SELECT round(avg(shipping_intent), 6) AS mean_intent FROM crm"),
    "conversion": (conversion, f"{C} SELECT count(*) AS total, count(*) FILTER (status IN {s.in_list(rules.ENGAGED)}) AS engaged, count(*) FILTER (status = 'won') AS won, count(*) FILTER (next_followup_date <= {DAY_SQL} AND status NOT IN ('won', 'lost')) AS due, round(count(*) FILTER (status = 'won') * 100 / nullif(count(*) FILTER (status IN {s.in_list(rules.ENGAGED)}), 0), 6) AS conversion FROM crm WHERE status <> 'quarantined'"),
    "crm_working_list": (crm_working_list, f"{C} SELECT lead_id, company_name, score, tier, status FROM crm WHERE status <> 'quarantined' ORDER BY score DESC, lead_id"),
    "review_list": (review_list, f"{C} SELECT lead_id, company_name, 'no_contact' AS quarantine_reason, strftime(updated_at, '%Y-%m-%d') AS updated FROM crm WHERE status = 'quarantined' ORDER BY updated_at DESC"),
    "crm_view": (crm_view, f"""{C} SELECT lead_id, company_name AS company, phone_e164 AS phone, city, category, score, tier,
        {s.q(rules.REASON_LABELS['band:trader'] + rules.REASON_SEPARATOR)} || CASE second_factor WHEN 'has_phone' THEN {s.q(rules.REASON_LABELS['has_phone'])} ELSE second_factor END AS why,
        coalesce(company_type, '') AS type, shipping_intent AS intent, {LABEL_CASE} AS status_label, CASE WHEN len(sources_seen) > 0 THEN array_to_string(sources_seen, ',') ELSE source END AS sources,
        coalesce(assigned_to, '') AS assigned_to, next_followup_date, '' AS notes FROM crm WHERE status <> 'quarantined'"""),
    "quarantine_view": (quarantine_view, f"{C} SELECT lead_id, company_name AS company, 'no_contact' AS reason, coalesce(phone_e164, '') AS phone, coalesce(email, '') AS email, coalesce(website, '') AS website, source FROM crm WHERE status = 'quarantined'"),
    "filtered_view": (filtered_view, f"{C} SELECT lead_id, company_name, tier, status, assigned_to FROM crm WHERE tier IN ('Hot', 'Medium') AND status IN ('new', 'interested', 'negotiation') AND regexp_matches(assigned_to, '(?i)^a.r') AND regexp_matches(company_name, '(?i)y 1.*(trad|co$)')"),
    "due_followups": (due_followups, f"{C} SELECT lead_id, status, next_followup_date FROM crm WHERE status NOT IN ('won', 'lost', 'quarantined') AND next_followup_date <= DATE '1998-01-01'"),
    "changed_leads": (changed_leads, f"""{C}, ch AS (SELECT l_orderkey * 2 AS lead_id, arg_max(l_linenumber, l_linenumber * 1000000000 + l_partkey) AS ln FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag = 'R' GROUP BY 1)
        SELECT lead_id, CASE ln WHEN 1 THEN 'contacted' WHEN 2 THEN 'won' ELSE status END AS status, 'note ' || ln AS notes, score, ln IS NOT NULL AS changed FROM crm LEFT JOIN ch USING (lead_id)"""),
    "pushed_leads": (pushed_leads, f"""{C}, p AS (SELECT DISTINCT l_orderkey AS lead_id FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1), j AS (SELECT pushed_to_sheet OR p.lead_id IS NOT NULL AS pushed_to_sheet, p.lead_id IS NOT NULL AS stamped FROM crm LEFT JOIN p USING (lead_id))
        SELECT pushed_to_sheet, stamped, count(*) AS n FROM j GROUP BY ALL"""),
    "status_round_trip": (status_round_trip, f"{C} SELECT status, {LABEL_CASE} AS label, CASE WHEN status = 'quarantined' THEN 'new' ELSE status END AS back, count(*) AS n FROM crm GROUP BY ALL"),
}

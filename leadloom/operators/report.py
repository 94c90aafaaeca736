"""Run statistics, source health, funnel and coverage reports: map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadloom import rules
from leadloom.functions import text as tx


def counted(hit: Column, name: str) -> Column:
    return F.count_if(hit).alias(name)


def outcome_counts() -> list[Column]:
    out = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("found"),
        counted(out == "keep", "kept"),
        counted(out == "drop", "dropped"),
        counted(out == "quarantine", "quarantined"),
    ]


def run_totals(processed: DataFrame, *by: str) -> DataFrame:
    """Found, kept, dropped and quarantined; ``created``/``updated`` when the fold flagged rows."""
    cols = outcome_counts()
    if "created" in processed.columns:
        kept = F.col("outcome") == "keep"
        cols += [counted(kept & F.col("created"), "created"), counted(kept & ~F.col("created"), "updated")]
    return processed.groupBy(*by).agg(*cols)


def reason_histogram(processed: DataFrame, *by: str) -> DataFrame:
    """Rows per outcome and reason of everything not kept."""
    return (
        processed.where(F.col("outcome") != "keep")
        .groupBy(*by, "outcome", F.coalesce("reason", F.lit("unknown")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reason_maps(processed: DataFrame) -> DataFrame:
    """One map of reasons per outcome."""
    pairs = reason_histogram(processed)
    return pairs.groupBy("outcome").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons")
    )


def health(found: Column, error: Column) -> Column:
    """blocked or error when the source raised, else ok or empty."""
    raised = tx.has_value(error)
    return (
        F.when(raised & tx.looks_blocked(error), F.lit("blocked"))
        .when(raised, F.lit("error"))
        .when(found > 0, F.lit("ok"))
        .otherwise(F.lit("empty"))
    )


def source_stats(processed: DataFrame, requested: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counters and health per requested source; a source without rows shows zeros."""
    stats = processed.groupBy("source").agg(*outcome_counts())
    out = requested.join(stats, "source", "left")
    if errors is None:
        out = out.withColumn("error", F.lit(None).cast("string"))
    else:
        out = out.join(errors.groupBy("source").agg(F.max("error").alias("error")), "source", "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("found", "kept", "dropped", "quarantined")}
    out = out.withColumns(zeros)
    return out.select(
        "source", "found", "kept", "dropped", "quarantined",
        tx.has_value("error").cast("int").alias("errors"), "error",
        health(F.col("found"), F.col("error")).alias("health"),
    )


def stats_map(stats: DataFrame, *by: str) -> DataFrame:
    """Source statistics packed into one map column, the shape kept in the run log."""
    body = F.struct("found", "kept", "dropped", "quarantined", "errors", "error", "health")
    return stats.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("source"), body.alias("stat")))).alias("source_stats")
    )


def run_row(stats: DataFrame, run_id: int, started: Column, finished: Column, params: dict) -> DataFrame:
    """The run-log row from the per-source statistics, in one aggregate.

    Holds parameters, totals (also quarantined), status, joined error text and the statistics
    map; ``created`` and ``updated`` are summed where the statistics carry them.
    """
    body = F.struct("found", "kept", "dropped", "quarantined", "errors", "error", "health")
    sums = [c for c in ("found", "kept", "dropped", "quarantined", "created", "updated") if c in stats.columns]
    messages = F.array_sort(F.collect_list(F.when(F.col("errors") > 0, F.concat_ws(": ", "source", "error"))))
    pairs = [F.lit(x) for k, v in params.items() for x in (k, "" if v is None else str(v))]
    row = stats.agg(
        *[F.sum(c).alias(c) for c in sums],
        messages.alias("messages"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", body.alias("stat"))))).alias("source_stats"),
    )
    return row.select(
        F.lit(run_id).cast("long").alias("run_id"), started.alias("started_at"), finished.alias("finished_at"),
        F.create_map(*pairs).alias("params"), *sums,
        F.when(F.size("messages") > 0, "done_with_errors").otherwise("done").alias("status"),
        tx.null_if_empty(F.array_join("messages", "; ")).alias("error"),
        "source_stats",
    )


def zero_filled(counts: DataFrame, key: str, values: list[str], spark: SparkSession) -> DataFrame:
    """Counts for every listed value, zero when none occurred."""
    frame = spark.range(1).select(F.posexplode(tx.words(values)).alias("ord", key))
    return frame.join(counts, key, "left").select("ord", key, F.coalesce("n", F.lit(0)).alias("n"))


def funnel(leads: DataFrame) -> DataFrame:
    """Leads per sales stage, unused stages as zero."""
    counts = leads.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    rows = zero_filled(counts, "status", list(rules.STATUS_LABELS), leads.sparkSession)
    return rows.withColumn("label", tx.status_label("status"))


def tier_counts(leads: DataFrame) -> DataFrame:
    counts = leads.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "tier", ["Hot", "Medium", "Weak"], leads.sparkSession)


def type_counts(leads: DataFrame) -> DataFrame:
    return leads.where(tx.has_value("company_type")).groupBy("company_type").agg(F.count(F.lit(1)).alias("n"))


def mean_intent(leads: DataFrame) -> DataFrame:
    return leads.agg(F.coalesce(F.avg("shipping_intent"), F.lit(0.0)).alias("mean_intent"))


def due(as_of: Column) -> Column:
    return (F.col("next_followup_date") <= as_of) & ~F.col("status").isin(rules.CLOSED)


def conversion(leads: DataFrame, as_of: Column) -> DataFrame:
    """Headline numbers: total, engaged, won, due follow-ups and won per engaged in percent."""
    return leads.agg(
        F.count(F.lit(1)).alias("total"),
        counted(F.col("status").isin(rules.ENGAGED), "engaged"),
        counted(F.col("status") == "won", "won"),
        F.count_if(F.coalesce(due(as_of), F.lit(False))).alias("due"),
    ).withColumn("conversion", F.coalesce(F.try_divide(F.col("won") * 100, F.col("engaged")), F.lit(0.0)))


def newest_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)


def health_rollup(runs: DataFrame, last: int = 100) -> DataFrame:
    """Per source over the newest runs: current health, summed yield, last success, last run."""
    rows = newest_runs(runs, last).select(
        "run_id", "started_at", F.coalesce("finished_at", "started_at").alias("ran_at"), F.explode("source_stats").alias("source", "s")
    )
    newest = F.struct("started_at", "run_id")
    return rows.groupBy("source").agg(
        F.max_by(F.col("s.health"), newest).alias("health"),
        F.sum("s.kept").alias("yield"),
        F.max_by("ran_at", F.when(F.col("s.found") > 0, newest)).alias("last_success"),
        F.max_by("ran_at", newest).alias("last_run"),
    )


def failing_sources(rollup: DataFrame) -> DataFrame:
    """Names of failing and of empty sources."""

    def named(*states: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("health").isin(*states), F.col("source")))), rules.REASON_SEPARATOR)

    return rollup.agg(named("blocked", "error").alias("failing"), named("empty").alias("empty"))


def coverage(processed: DataFrame) -> DataFrame:
    """Per source: found, kept, contact coverage and leads lifted to a better tier.

    Reads ``tier_before`` and ``tier`` of the same row, so no self-join is needed.
    """
    kept = F.col("outcome") == "keep"
    return processed.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"),
        counted(kept, "kept"),
        F.count_if(kept & (tier_rank("tier") > tier_rank("tier_before"))).alias("upgraded"),
        counted(kept & tx.has_value("website"), "website"),
        counted(kept & tx.has_value("phone_e164"), "phone"),
        counted(kept & tx.has_value("email"), "email"),
        counted(kept & F.col("enriched"), "enriched"),
    )


def tier_rank(tier: str) -> Column:
    rank = F.lit(0)
    for name, value in rules.TIER_RANK.items():
        rank = F.when(F.col(tier) == name, F.lit(value)).otherwise(rank)
    return rank


def enrichment_effect(processed: DataFrame) -> DataFrame:
    """Tiers after enrichment with how many of them were weak before."""
    return processed.where(F.col("outcome") == "keep").groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), counted(F.col("tier_before") == "Weak", "weak_before")
    )


def rollup_requests(per_request: DataFrame) -> DataFrame:
    """Totals over several requests."""
    names = [c for c in ("found", "kept", "dropped", "quarantined", "created", "updated") if c in per_request.columns]
    return per_request.agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in names])


def last_errors(errors: DataFrame) -> DataFrame:
    """Latest error text of each source over the requests of a sweep."""
    return errors.groupBy("source").agg(F.max_by("error", "request_no").alias("error"))


def ranked_list(leads: DataFrame) -> DataFrame:
    """Working list: quarantined leads left out, best score first."""
    return leads.where(~F.col("status").eqNullSafe(rules.QUARANTINED)).orderBy(F.col("score").desc(), "lead_id")


def review_list(leads: DataFrame) -> DataFrame:
    """Quarantined leads, newest change first."""
    return leads.where(F.col("status").eqNullSafe(rules.QUARANTINED)).orderBy(F.col("updated_at").desc(), "lead_id")


def newest_per_source(run_sources: DataFrame) -> DataFrame:
    window = W.partitionBy("source").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return run_sources.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")

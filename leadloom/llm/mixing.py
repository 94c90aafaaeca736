"""Mix sources to target weights along a time-varying curriculum. DataFrame functions only.

Every source has a weight schedule, a piecewise linear density over training time 0 to 1. Its target is
what its overall weight buys of the budget, at most ``MAX_PASSES`` times its own size. The integral of
its density, scaled to the target, is its cumulative demand for words; the documents of a source, in an
order drawn by hash, are laid end to end along that demand, pass after pass, and the demand is inverted to
give every pass of a document its position in training. The mix is range-sorted by position.

The words before a document come from two levels: sums per (source, hash bucket), a window over these
sums of each source, and a window inside each bucket. So the rows of a source are never in one
task, whatever its share of all rows.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in
order. A source without words has target 0. Null or repeated ids are fine: order is drawn from id and
text, and rows equal in both are interchangeable. The last document of the last pass is cut where the
target is reached, so the words taken equal the rounded target. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import cut

MAX_PASSES = 3
BUCKET_DIGITS = 3  # hexadecimal digits of the draw: 4,096 buckets a source
WORD = r"[^\x20\x09-\x0D]+"
#: Density of demand at the knots (evenly spaced over training time) by weight: light sources come early, heavy ones late.
KNOTS = {1.0: (1.5, 1.25, 1.0, 0.75, 0.5), 2.0: (1.0, 1.0, 1.0, 1.0, 1.0), 3.0: (0.75, 0.85, 1.0, 1.15, 1.25)}


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: Column | None = None, max_passes: int = MAX_PASSES) -> DataFrame:
    """``target`` of each source from ``source, weight, source_size``: budget by weight, capped at
    ``max_passes`` times the size, the excess shared out again by weight until no source is above.

    That is a common level: ``min(cap, weight * level)``. Sources in order of cap / weight fill up one after
    the other; the level is what remains for the rest at the first source that needs no cap.
    One row a source: the windows here have no partition and read the list of sources only.
    """
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if budget is None else budget
    cap = (F.lit(max_passes) * F.col("source_size")).cast("double")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("total", total.cast("double")).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "full", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * fits, F.col("cap")))).drop("total", "cap", "ratio", "full", "rest", "level")


def default_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, for the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))


def share_at(time: Column, knots: Column) -> Column:
    """Integral of the density up to ``time`` as a share of the whole: cumulative demand."""
    n = F.size(knots) - 1
    areas = F.transform(F.sequence(F.lit(1), n), lambda i: (F.get(knots, i - 1) + F.get(knots, i)) / 2)
    at = F.least(F.floor(time * n), n - 1).cast("int")
    part = time * n - at
    low, high = F.get(knots, at), F.get(knots, at + 1)
    done = F.aggregate(F.slice(areas, F.lit(1), at), F.lit(0.0), lambda a, x: a + x)
    return (done + low * part + (high - low) * part * part / 2) / F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)


def time_at(share: Column, steps: str = "steps", knots: str = "knots") -> Column:
    """Inverse of ``share_at``: when demand reaches ``share``. ``steps``: cumulative area at every knot, from 0."""
    total = F.element_at(steps, -1)
    want = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * total
    n = F.size(steps) - 1
    at = F.least(F.size(F.filter(steps, lambda x: x <= want)), n) - 1
    low, high = F.get(knots, at), F.get(knots, at + 1)
    rest = F.greatest(want - F.get(steps, at), F.lit(0.0))
    slope = high - low
    root = F.sqrt(F.greatest(low * low + 2 * slope * rest, F.lit(0.0)))
    part = F.when(low + root > 0, 2 * rest / (low + root)).otherwise(F.lit(0.0))
    return (at + F.least(part, F.lit(1.0))) / n


def with_steps(rows: DataFrame) -> DataFrame:
    """Cumulative area under the density at every knot."""
    areas = F.expr("transform(sequence(1, size(knots) - 1), i -> (knots[i - 1] + knots[i]) / 2)")
    return rows.withColumn("areas", areas).withColumn(
        "steps", F.expr("transform(sequence(0, size(areas)), i -> aggregate(slice(areas, 1, i), double(0), (a, x) -> a + x))")).drop("areas")


def _knots(schedule: dict[float, tuple[float, ...]]) -> Column:
    flat = max(schedule.values(), key=len)
    out = F.array(*[F.lit(1.0)] * len(flat))
    for weight, density in schedule.items():
        out = F.when(F.col("weight") == weight, F.array(*[F.lit(float(x)) for x in density])).otherwise(out)
    return out


def mix(docs: DataFrame, schedule: dict[float, tuple[float, ...]] | None = None, digits: int = BUCKET_DIGITS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken`` and ``passes``: (position, words) of each pass taken."""
    draw = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    slim = docs.select("doc_id", "source", word_count().alias("size"), draw.alias("draw"))
    slim = cut(slim.withColumn("bucket", F.substring("draw", 1, digits)))  # texts are read once
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    plan = with_steps(targets(default_weights(sizes), max_passes=max_passes).withColumn("knots", _knots(schedule or KNOTS)))
    within = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(within), F.lit(0))).drop("bucket_size")
    offsets = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = slim.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(offsets, laid["source"].eqNullSafe(offsets["source"]) & (laid["bucket"] == offsets["bucket"])).drop(offsets["source"]).drop(offsets["bucket"])
    laid = laid.withColumn("start", F.col("bucket_start") + F.col("before")).withColumn("goal", F.round("target").cast("long"))
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_passes)), lambda k: F.struct(
        (F.col("start") + k * F.col("source_size")).alias("at"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("start") - k * F.col("source_size"))).cast("long").alias("words")))
    passes = F.filter(passes, lambda p: p["words"] > 0)
    laid = laid.withColumn("passes", F.transform(passes, lambda p: F.struct(time_at(p["at"] / F.col("goal")).alias("position"), p["words"].alias("words"))))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per pass of a document, range-sorted by position: the order to train in."""
    rows = mixed.select("doc_id", "source", F.explode("passes").alias("p")).select("doc_id", "source", "p.position", "p.words")
    return rows.orderBy("position", "doc_id")


def by_first_position(mixed: DataFrame) -> DataFrame:
    """One row per document, range-sorted by its first position; documents not taken come last."""
    first = F.get("passes", F.lit(0))["position"]
    return mixed.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")

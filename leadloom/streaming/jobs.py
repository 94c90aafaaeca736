"""Incremental twins of the batch jobs, as Structured Streaming queries.

Each ``*_stream`` is a plain transformation of a streaming DataFrame; ``run_available`` drives
one to the end of what has landed and returns the sink as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom import rules
from leadloom.operators.firsts import top_per
from leadloom.operators.qualify import qualify
from leadloom.operators.report import outcome_counts
from leadloom.operators.sync import append_new
from leadloom.session import cut, drop_cut, shared_path
from leadloom.sources.pages import fetch
from leadloom.sources.sinks import fold_into_table, folded_batches


def read_landed(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Stream of the parquet files that land in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def _keep_landings(ttl: int, names: list[str]):
    """Landings of one address in time order: one is kept when the last kept one is ``ttl`` microseconds old or older."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["fetched_at", *names], kind="stable")
        at = rows["fetched_at"].to_numpy().astype("datetime64[us]").astype("int64")
        last = state.get[0] if state.exists else None
        place, kept = 0 if last is None else int(np.searchsorted(at, last + ttl)), []
        while place < len(at):
            kept.append(place)
            last = int(at[place])
            place = int(np.searchsorted(at, last + ttl))
        state.update((last,))
        # once the watermark passed the time to live, any further landing is kept, with this state or without it
        state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept]

    return step


def page_stream(pages: DataFrame, ttl_seconds: int = rules.PAGE_TTL_SECONDS, late: str = "30 days", keep: tuple[str, ...] = ()) -> DataFrame:
    """Landings of pages that are to be read, with ``url``, ``fetched_at`` and the columns ``keep``: the first of each address,
    and each next one that comes when the last kept one has outlived its time to live.

    Landings of one batch are taken in time order; one that is older than the last kept one of its address is a repeat.
    State is one time per address and expires by event time. Landings more than ``late`` behind the newest are
    dropped. Only ``keep`` passes through Python, so leave the markup out of it and fetch it for what is kept.
    """
    rows = pages.select("url", "fetched_at", *keep).withWatermark("fetched_at", late)
    return rows.groupBy("url").applyInPandasWithState(
        _keep_landings(ttl_seconds * 1_000_000, list(keep)), rows.schema, "kept_at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def ingest_pages(spark: SparkSession, landing: str, schema: T.StructType, out: str, state: str, ttl_seconds: int = rules.PAGE_TTL_SECONDS, files_per_batch: int = 1000) -> None:
    """Write the landed pages that are to be read to ``out``, one folder a batch, so a batch that is repeated replaces itself.

    Which landings are kept is decided on addresses and times; the markup is then fetched by file and row.
    """
    landed = read_landed(spark, landing, schema, files_per_batch=files_per_batch)
    found = landed.select("url", "fetched_at", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def put(batch: DataFrame, number: int) -> None:
        chosen = cut(batch.select("file", "row"))
        files = [r.file for r in chosen.select("file").distinct().collect()]  # at most ``files_per_batch``
        if files:
            fetch(spark.read.schema(schema).parquet(*files), chosen).write.mode("overwrite").parquet(f"{out}/batch={number}")
        drop_cut(chosen)

    run_batches(page_stream(found, ttl_seconds, keep=("file", "row")), put, state, mode="append")


def daily_yield_stream(processed: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Counters per source and day, finished once the watermark passed the day."""
    return (
        processed.withWatermark(at, late)
        .groupBy(F.window(at, "1 day"), "source")
        .agg(*outcome_counts())
        .select(F.col("window.start").alias("day"), "source", "found", "kept", "dropped", "quarantined")
    )


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything that has landed into a parquet sink and read it back."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "sink"), shared_path(spark, "state")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything that has landed in update mode and return the latest row of each key, open windows included.

    Batches are appended with their number; a batch that is repeated brings the same rows under the same number.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, "latest"), shared_path(spark, "state")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return top_per(spark.read.parquet(out), keys, [F.col("_batch").desc()], 1).drop("_batch")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Drive a ``foreachBatch`` job to the end of what has landed."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(listings: DataFrame, leads_path: str, state: str, **rating) -> None:
    """Qualify each micro-batch and fold it into the lead table.

    The table records the last batch of each job, named by its state folder; a batch that is repeated
    after a lost driver is skipped, as sightings without any key would found their leads again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        if folded_batches(batch.sparkSession, leads_path).get(state, -1) < number:
            fold_into_table(qualify(batch, **rating), leads_path, writer=state, batch=number)

    run_batches(listings, fold, state)


def feed_batches(leads: DataFrame, feed_path: str, state: str, today: Column) -> None:
    """Append the new contacts of each micro-batch to the feed."""
    run_batches(leads, lambda batch, _: append_new(batch, feed_path, [], today), state)

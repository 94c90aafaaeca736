"""Sinks: run log, contact feed, export; the lead table has a module of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.sync import export_table, overwrite_rows
from leadloom.sources.lead_table import compact, fold_into_table, folded_batches, lead_table, read_leads, replace_leads, write_leads  # noqa: F401  (the lead table is a sink)


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: columns a stored table lacks appear as nulls; a second run adds nothing."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None before its first write."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None


def append_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_export(leads: DataFrame, path: str, fmt: str = "csv") -> None:
    """Sales export as CSV with header (or any Spark format), all cells as text."""
    table = overwrite_rows(export_table(leads))
    writer = table.write.mode("overwrite").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)

"""Session helpers: a local builder for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "leadloom") -> SparkSession:
    """Session for one machine. A cluster brings its own session and its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "64m")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints (``spark.checkpoint.dir``).

    Only a session on one machine may go without: there a folder of its own serves.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leadloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage forgotten. ``codec``: of Parquet, by default the session's.

    A columnar table rather than a checkpoint: it is compressed, later reads take only the columns
    they need, and its size is known when the next join is planned. It survives lost executors.
    """
    path = shared_path(df.sparkSession, "cut")
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def is_cut(df: DataFrame) -> bool:
    """Whether ``df`` is a table as ``cut`` returned it, so that reading it again computes nothing anew."""
    return "_cut_path" in df.__dict__


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        if path := df.__dict__.get("_cut_path"):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

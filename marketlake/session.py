"""Session set-up shared by jobs, queries and tests."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every query of this package relies on.
#  * caseSensitive: book payloads carry b/B and a/A as different fields.
#  * timeZone: event time is unix seconds, so dates and hours are cut in UTC.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows may hold whole documents: bounds what a Python worker holds at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # state of windows by token and price bucket outgrows a heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    # executors need no copy of this package: its Python functions travel with the job
    cloudpickle.register_pickle_by_value(sys.modules["marketlake"])
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "marketlake",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SQL_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only a local-mode session (tests) may fall back to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    base = context.getCheckpointDir()
    if base:
        return base
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="marketlake-")
    context.setCheckpointDir(base)
    return base


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's tables below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def make_dir(spark: SparkSession, path: str) -> str:
    """Create a folder, on whatever file system it lies; a stream can then start on it while it is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage after a large reduction, in reliable shared storage.

    Used where a compact table (one row per series and minute) feeds several
    later passes: the tick scan then runs once, and a lost executor costs a
    re-read of the compact table instead of the archive.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


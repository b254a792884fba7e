"""Tick archive and message sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.schemas import INPUT_TOPICS, TICK_DDL, TICK_PARTITIONS
from marketlake.session import configure, make_dir, materialize

MESSAGE_DDL = "topic STRING, key STRING, value STRING"
COMPACT_SIZE = "256MB"
#: Files that a task of a compaction may write at once; rows of more folders than that are sorted.
OPEN_FILES = 64


def tick_source(
    spark: SparkSession,
    kind: str,
    location: str,
    topics: Iterable[str] = INPUT_TOPICS,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Message stream with columns topic and value.

    kind `kafka`: all topics as one stream from the brokers in `location`, from the latest
    offsets, tolerating lost data (needs the Kafka connector on the classpath).
    kind `files`: JSON-lines files of {topic, key, value} in the folder `location`.
    """
    options = options or {}
    topics = list(topics)
    if kind == "kafka":
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", location)
            .option("subscribe", ",".join(topics))
            .option("startingOffsets", "latest")
            .option("failOnDataLoss", "false")
            .options(**options)
            .load()
            .select("topic", "value")
        )
    if kind == "files":
        return (
            spark.readStream.schema(MESSAGE_DDL)
            .options(**options)
            .json(location)
            .where(F.col("topic").isin(*topics))
            .select("topic", "value")
        )
    raise ValueError(f"unknown source kind {kind!r}: use 'kafka' or 'files'")


def read_ticks(spark: SparkSession, root: str) -> DataFrame:
    """The tick archive. The schema is declared, so nothing is inferred and no file footer is
    read for it; filters on source / date / hour prune folders and empty files are skipped."""
    return spark.read.schema(TICK_DDL).parquet(root)


def write_ticks(ticks: DataFrame, root: str, mode: str = "append") -> None:
    """Write ticks partitioned by source, date and hour, in files of balanced size.

    The rebalance hint lets adaptive execution split a partition that holds most of the rows
    and merge the small ones, so neither a hot hour nor a quiet one decides the file size.
    An overwrite replaces only the partitions that the rows belong to.
    """
    ticks.hint("rebalance", *TICK_PARTITIONS).write.mode(mode).partitionBy(*TICK_PARTITIONS).option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(root)


def _compacting(spark: SparkSession, file_size: str) -> SparkSession:
    """A session of its own, so that the file size it asks for touches no other query.

    A folder larger than `file_size` is split. Small ones are not gathered into one task: each is a file of
    its own anyhow, and the task would hold the rows of all of them to sort them by folder.
    """
    own = configure(spark.newSession())
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", file_size)
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return own


def compact_ticks(
    spark: SparkSession, root: str, target: str, dates: Iterable[str] | None = None, file_size: str = COMPACT_SIZE
) -> None:
    """Rewrite an archive of many small files into `target`, optionally for some dates only.

    Dates compacted before stay; a date compacted again is replaced. A task writes the files of its folders
    side by side as the rows come, so that it holds none to sort them.
    """
    own = _compacting(spark, file_size)
    own.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES))
    ticks = read_ticks(own, root)
    if dates is not None:
        ticks = ticks.where(F.col("date").isin(*dates))
    write_ticks(ticks, target, mode="overwrite")


def compact_changed(spark: SparkSession, root: str, target: str, file_size: str = COMPACT_SIZE) -> DataFrame:
    """Bring a compacted copy of an archive up to date; only folders that hold more than the copy are rewritten.

    The archive only grows, so a folder (source, date, hour) has changed if its number of rows has, which the
    files' footers tell without reading a column; rows that arrive while this runs are found by the next
    run. Rows are sorted by (ident, ts) within a file, so that a filter on ident skips row groups. Returns the
    folders rewritten, with their rows before and after.
    """
    own = _compacting(spark, file_size)
    folder = list(TICK_PARTITIONS)
    held = read_ticks(own, make_dir(own, target)).groupBy(folder).agg(F.count(F.lit(1)).alias("n_before"))
    there = read_ticks(own, root).groupBy(folder).agg(F.count(F.lit(1)).alias("n_after"))
    changed = materialize(
        there.join(held, folder, "left").fillna(0, "n_before").where("n_after <> n_before")
    )
    if not changed.isEmpty():
        ticks = read_ticks(own, root).join(changed.select(folder), folder, "left_semi").select(read_ticks(own, root).columns)
        spread = ticks.hint("rebalance", *folder).sortWithinPartitions(*folder, "ident", "ts")
        spread.write.mode("overwrite").partitionBy(*folder).option("partitionOverwriteMode", "dynamic").parquet(target)
    return changed

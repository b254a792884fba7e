"""Sinks and the running pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marketlake.operators.normalize import normalize_ticks
from marketlake.operators.ordered import in_order, numbered, part_sizes
from marketlake.operators.stats import forecast_stats, windowed_stats
from marketlake.schemas import (
    DEFAULT_SIGMA_LOG,
    TICK_DDL,
    TICK_PARTITIONS,
    TOPIC_FORECAST,
    TOPIC_SCORED,
    TOPIC_STATS,
)
from marketlake.session import make_dir, materialize
from marketlake.sources.envelope import parse_envelope
from marketlake.sources.forecasts import forecast_messages
from marketlake.streaming.state import LATENESS, carry_forward_stream

DRAIN = {"availableNow": True}


def run_stream(
    df: DataFrame,
    name: str,
    checkpoint: str,
    sink: dict | None = None,
    mode: str = "append",
    trigger: dict | None = None,
    each_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start one named query with its own checkpoint."""
    writer = (
        df.writeStream.queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", f"{checkpoint}/{name}")
    )
    if trigger:
        writer = writer.trigger(**trigger)
    if each_batch:
        return writer.foreachBatch(each_batch).start()
    sink = dict(sink or {})
    writer = writer.format(sink.pop("format"))
    partitions = sink.pop("partitionBy", None)
    if partitions:
        writer = writer.partitionBy(*partitions)
    return writer.options(**sink).start()


def sink_ticks(
    ticks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, salts: int = 4,
    name: str = "ticks",
) -> StreamingQuery:
    """Partitioned Parquet archive, exactly once.

    A live micro-batch falls into one or two hours. Spreading each hour over `salts` tasks
    bounds the files a batch adds per folder without sending a hot hour to one task.
    """
    salt = F.pmod(F.xxhash64("ident", "ts"), F.lit(salts))
    spread = ticks.repartition(*TICK_PARTITIONS, salt)
    sink = {"format": "parquet", "path": path, "partitionBy": TICK_PARTITIONS}
    return run_stream(spread, name, checkpoint, sink, trigger=trigger)


def sink_messages(
    messages: DataFrame,
    name: str,
    topic: str,
    checkpoint: str,
    kind: str,
    location: str,
    trigger: dict | None = None,
    order_by: str | None = None,
    single_partition: bool = False,
) -> StreamingQuery:
    """Publish key / value rows to a topic: Kafka brokers or a folder of JSON lines.

    With `order_by`, each batch is written in that order per key; `single_partition` writes
    one ordered partition for readers that follow only one. Many tasks sort its ranges; the one
    task that writes copies them one after another and holds no rows.
    """
    if kind not in ("kafka", "files"):
        raise ValueError(f"unknown sink kind {kind!r}: use 'kafka' or 'files'")
    rows = messages.withColumn("topic", F.lit(topic))
    if order_by is None:
        sink = (
            {"format": "kafka", "kafka.bootstrap.servers": location}
            if kind == "kafka"
            else {"format": "json", "path": f"{location}/{topic}"}
        )
        return run_stream(rows, name, checkpoint, sink, trigger=trigger)

    def publish(batch: DataFrame, batch_id: int) -> None:
        if single_partition:
            batch = _in_one_partition(batch, order_by)
        else:
            batch = batch.repartition("key").sortWithinPartitions("key", order_by)
        if kind == "kafka":
            out = batch.select("topic", "key", "value")
            if single_partition:
                out = out.withColumn("partition", F.lit(0))
            out.write.format("kafka").option("kafka.bootstrap.servers", location).save()
        else:
            # a replayed batch overwrites its own folder
            batch.select("topic", "key", "value").write.mode("overwrite").json(
                f"{location}/{topic}/batch={batch_id}"
            )

    return run_stream(rows, name, checkpoint, trigger=trigger, each_batch=publish)


def _in_one_partition(batch: DataFrame, order_by: str) -> DataFrame:
    """The rows in one partition and in order; sorted ranges are stored first and then read one after another."""
    # state of the stream is read once; the order reads the rows again
    placed = in_order(materialize(batch), order_by)
    rows = numbered(placed, F.broadcast(part_sizes(placed)), "_n").coalesce(1)
    # a row's id in the one partition is its place there
    in_place = F.assert_true(F.monotonically_increasing_id() == F.col("_n"), F.lit("ranges out of order"))
    return rows.where(in_place.isNull()).drop("_n")


def sink_numbered(
    messages: DataFrame,
    name: str,
    topic: str,
    checkpoint: str,
    location: str,
    order_by: list[str],
    trigger: dict | None = None,
    parts: int | None = None,
) -> StreamingQuery:
    """Publish key / value rows as JSON lines in a total order, without writing them in one task.

    A micro-batch is dealt into ranges of the order; each row gets a number `seq`, which counts on without gaps
    from the batches before, so that readers of several files can follow one order. How far a batch got is a
    row of a manifest, one small file per batch, of which only the last one is read. A batch that is run again
    finds the same start and overwrites its own folder and row. Rows that tie in `order_by` keep one number each.
    """
    base, manifest = f"{location}/{topic}", f"{location}/{topic}-batches"

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = 0
        if batch_id:  # the ids of a query's batches follow each other
            before = spark.read.schema("first long, rows long").json(f"{manifest}/batch={batch_id - 1}")
            first = before.agg(F.max(F.col("first") + F.col("rows"))).first()[0]
        # state of the stream is read once; the order reads the rows again
        placed = in_order(materialize(batch), *order_by, "key", "value", parts=parts)
        sizes = materialize(part_sizes(placed))
        rows = numbered(placed, F.broadcast(sizes), "_n")  # one row per part
        out = rows.select("key", "value", (F.col("_n") + first).alias("seq"))
        out.write.mode("overwrite").json(f"{base}/batch={batch_id}")
        done = sizes.agg(F.lit(first).cast("long").alias("first"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"))
        done.write.mode("overwrite").json(f"{manifest}/batch={batch_id}")

    return run_stream(messages, name, checkpoint, trigger=trigger, each_batch=publish)


def sink_console(rows: DataFrame, checkpoint: str, every: str = "15 seconds") -> StreamingQuery:
    sink = {"format": "console", "truncate": "false", "numRows": "20"}
    return run_stream(
        rows, "console", checkpoint, sink, mode="update", trigger={"processingTime": every}
    )


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of the live pipeline."""

    output: str
    checkpoint: str
    sink_kind: str = "files"
    sink_location: str | None = None
    window: str = "1 minute"
    watermark: str = "30 seconds"
    forecast_grain: str = "1 second"
    forecast_watermark: str = "10 seconds"
    slug_suffix: str = "-updown-5m-"
    sigma_log: float = DEFAULT_SIGMA_LOG
    # (series, sigma_log) of fitted models; series without one use sigma_log
    sigmas: DataFrame | None = None
    prob_stale: int = 1800
    spot_stale: int | None = None
    lateness: str = LATENESS
    console: bool = False
    salts: int = 4
    # bound of a micro-batch over the tables that the later hops read
    files_per_trigger: int = 1000
    trigger: dict = field(default_factory=dict)


POINTS_DDL = "asset STRING, ts DOUBLE, btc_mid DOUBLE, poly_prob DOUBLE"


def sink_forecast_points(
    ticks: DataFrame, config: PipelineConfig, trigger: dict | None = None
) -> StreamingQuery:
    """First hop of the forecast: closed per-second windows into a table of points.

    Keyed state cannot follow an aggregation in one append-mode query, so the points land in
    a table (exactly once) and the carry-forward reads that table as its stream.
    """
    points = forecast_stats(
        ticks,
        config.sigma_log,
        config.forecast_grain,
        config.forecast_watermark,
        config.slug_suffix,
    ).select("asset", "ts", "btc_mid", "poly_prob")
    sink = {"format": "parquet", "path": f"{config.output}/forecast_points"}
    return run_stream(points, "forecast_points", config.checkpoint, sink, trigger=trigger)


def live_forecast(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    """Second hop: forecast points to carried-forward forecast rows (asset, sec, …)."""
    points = _hop(spark, config, POINTS_DDL, "forecast_points")
    return carry_forward_stream(
        points, config.sigma_log, config.prob_stale, config.spot_stale, lateness=config.lateness, sigmas=config.sigmas
    )


def archived_ticks(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    """The tick archive as a stream.

    Folders appear after the stream has started, so their columns cannot be left to partition
    discovery, which looks once: the source is read off the path, date and hour off the time.
    """
    stored = StructType([f for f in StructType.fromDDL(TICK_DDL) if f.name not in TICK_PARTITIONS])
    rows = _hop(spark, config, stored, "ticks", recursiveFileLookup="true")
    return rows.select(
        "*",
        F.regexp_extract("_metadata.file_path", "/source=([^/]*)/", 1).alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.hour("ts").alias("hour"),
    )


def _hop(
    spark: SparkSession, config: PipelineConfig, schema: str | StructType, table: str, **options: str
) -> DataFrame:
    """A table that an earlier query of the pipeline writes, as a stream of bounded batches."""
    return (
        spark.readStream.schema(schema)
        .options(maxFilesPerTrigger=config.files_per_trigger, **options)
        .parquet(make_dir(spark, f"{config.output}/{table}"))
    )


def stats_messages(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("series").alias("key"), F.to_json(F.struct("*")).alias("value"))


def run_pipeline(raw: DataFrame, config: PipelineConfig) -> list[StreamingQuery]:
    """Start the tick archive, the statistics topic and the two forecast hops over one source.

    Only the archive query reads and parses messages. The statistics and the forecast read the
    archived ticks as their stream, each with offsets of its own, so one that fails or lags
    does not hold back the others.
    """
    ticks = normalize_ticks(parse_envelope(raw))
    archived = archived_ticks(raw.sparkSession, config)
    stats = windowed_stats(archived, config.window, config.watermark)
    location = config.sink_location or config.output
    trigger = config.trigger or None
    queries = [
        sink_ticks(ticks, f"{config.output}/ticks", config.checkpoint, trigger, config.salts),
        sink_messages(
            stats_messages(stats), "stats", TOPIC_STATS, config.checkpoint, config.sink_kind,
            location, trigger,
        ),
        sink_forecast_points(archived, config, trigger),
        sink_messages(
            forecast_messages(live_forecast(raw.sparkSession, config)).withColumn(
                "ts", F.get_json_object("value", "$.ts")
            ),
            "forecast", TOPIC_FORECAST, config.checkpoint, config.sink_kind, location, trigger,
            order_by="ts",
        ),
    ]
    if config.console:
        queries.append(sink_console(stats, config.checkpoint))
    return queries


def publish_scores(
    scored: DataFrame, config: PipelineConfig, single_partition: bool = False
) -> StreamingQuery:
    messages = scored.select(
        F.col("series").alias("key"),
        F.col("ts"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"),
    )
    return sink_messages(
        messages, "score", TOPIC_SCORED, config.checkpoint, config.sink_kind,
        config.sink_location or config.output, config.trigger or None, order_by="ts",
        single_partition=single_partition,
    )


def drain(queries: list[StreamingQuery]) -> None:
    """Wait for queries started with the availableNow trigger."""
    for q in queries:
        q.awaitTermination()


def await_any(spark: SparkSession) -> None:
    spark.streams.awaitAnyTermination()

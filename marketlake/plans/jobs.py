"""Command-line jobs: `spark-submit … -m marketlake.plans.jobs <job> …`.

    stream         messages → tick archive, statistics topic, forecast topic
    build-dataset  tick archive → training table
    train          training table → parameters, AIC grid, predictions, metrics
    score          forecast topic + parameters → scored topic
    probe          message archive → throughput and event mix
    compact        archive of many small files → balanced files
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators import arma, metrics, stats
from marketlake.operators.resample import Grains, build_training_table, time_split
from marketlake.schemas import DEFAULT_SIGMA_LOG, EXOG, TARGET, TOPIC_FORECAST
from marketlake.session import build_session, materialize
from marketlake.sources import forecasts, models, ticks
from marketlake.sources.envelope import parse_envelope
from marketlake.streaming import pipeline, state


def build_dataset(spark: SparkSession, archive: str, output: str, grains: Grains = Grains()) -> DataFrame:
    """Write the training table; returns the coverage report of the archive."""
    rows = ticks.read_ticks(spark, archive)
    build_training_table(rows, grains).write.mode("overwrite").parquet(output)
    surviving = spark.read.parquet(output)
    return stats.coverage_report(rows, grains.second, grains.slug_suffix, surviving)


def train(
    spark: SparkSession,
    training: str,
    output: str,
    holdout: float = 0.2,
    max_p: int = 3,
    max_q: int = 3,
    delay: int = 5,
    step: int | None = None,
) -> DataFrame:
    """Select and fit every series, write model and predictions; returns the metrics."""
    split = materialize(time_split(spark.read.parquet(training), holdout))
    stage1 = arma.fit_exog(split).select("series", "beta")
    u_rows = arma.residuals(split.where(F.col("split") == "train"), stage1)
    grid = materialize(arma.order_grid(u_rows, max_p, max_q, step=step))
    params = materialize(arma.fit_arx(split, grid=grid))
    models.save_model(params, output, grid)
    arma.coef_table(split, params, orders=(max_p, max_q), step=step).write.mode("overwrite").parquet(f"{output}/coefficients")
    predictions = materialize(arma.walk_forward(split, params, delay))
    predictions.write.mode("overwrite").parquet(f"{output}/predictions")
    sigmas = metrics.sigma_by_series(split)
    inside = metrics.regression_metrics(
        arma.walk_forward(split, params, 0).where(F.col("split") == "train"), "y", ("pred",)
    ).withColumn("forecaster", F.lit("model, in sample"))
    return inside.unionByName(metrics.baseline_comparison(split, predictions, sigmas))


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    params = models.load_model(spark, args.model)
    if args.source == "kafka":
        messages = ticks.tick_source(
            spark, "kafka", args.location, [TOPIC_FORECAST], {"maxOffsetsPerTrigger": str(args.max_per_trigger)}
        )
    else:
        messages = spark.readStream.schema("key STRING, value STRING").options(
            recursiveFileLookup="true", maxFilesPerTrigger=args.max_per_trigger
        ).json(args.location)
    scored = state.score_stream(
        forecasts.read_forecast_points(messages), params, Grains(), args.strict_history, args.emit_interval,
        lateness=args.lateness,
    )
    config = pipeline.PipelineConfig(
        args.output, args.checkpoint, args.source, args.location if args.source == "kafka" else None
    )
    pipeline.publish_scores(scored, config, args.single_partition).awaitTermination()


def probe(spark: SparkSession, archive: str, target: float = 4000.0) -> tuple[DataFrame, DataFrame]:
    """Throughput per topic and event mix of landed messages (topic, value)."""
    rows = parse_envelope(spark.read.schema(ticks.MESSAGE_DDL).json(archive))
    return stats.throughput_summary(rows, target), stats.event_mix(rows)


def _sigmas(spark: SparkSession, args: argparse.Namespace) -> tuple[float, DataFrame | None]:
    """The default σ and, with a model, the σ of every series it has."""
    default = DEFAULT_SIGMA_LOG if args.sigma_log is None else args.sigma_log
    if not 0 < default <= models.MAX_SIGMA_LOG:
        raise SystemExit(f"--sigma-log {args.sigma_log} is no 5-minute log-return deviation")
    if not args.model:
        return default, None
    params = models.load_model(spark, args.model)
    return default, models.sigma_lookup(params.select("series"), params.select("series", "sigma_log"), default=default)


def stream(spark: SparkSession, args: argparse.Namespace) -> None:
    default, sigmas = _sigmas(spark, args)
    config = pipeline.PipelineConfig(
        output=args.output,
        checkpoint=args.checkpoint,
        sink_kind=args.source,
        sink_location=args.location if args.source == "kafka" else None,
        window=args.window,
        watermark=args.watermark,
        forecast_watermark=args.forecast_watermark,
        slug_suffix=args.slug_suffix,
        sigma_log=default,
        sigmas=sigmas,
        prob_stale=args.prob_stale,
        spot_stale=args.spot_stale,
        lateness=args.lateness,
        console=args.console,
        salts=args.salts,
        files_per_trigger=args.files_per_trigger,
    )
    bound = "maxOffsetsPerTrigger" if args.source == "kafka" else "maxFilesPerTrigger"
    source = ticks.tick_source(spark, args.source, args.location, options={bound: str(args.max_per_trigger)})
    pipeline.run_pipeline(source, config)
    pipeline.await_any(spark)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marketlake", allow_abbrev=False)
    parser.add_argument("--master")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *required: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, allow_abbrev=False)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    s = job("stream", "location", "output", "checkpoint")
    s.add_argument("--source", choices=("kafka", "files"), default="kafka")
    s.add_argument("--window", default="1 minute")
    s.add_argument("--watermark", default="30 seconds")
    s.add_argument("--forecast-watermark", default="10 seconds")
    s.add_argument("--slug-suffix", default="-updown-5m-")
    s.add_argument("--prob-stale", type=int, default=1800)
    s.add_argument("--spot-stale", type=int)
    s.add_argument("--sigma-log", type=float)
    s.add_argument("--salts", type=int, default=4, help="tasks over which an hour of the archive is spread")
    s.add_argument("--files-per-trigger", type=int, default=1000, help="archived files in one micro-batch of the later queries")
    s.add_argument("--lateness", default=state.LATENESS)
    s.add_argument("--max-per-trigger", type=int, default=1_000_000, help="offsets or files in one micro-batch")
    s.add_argument("--model")
    s.add_argument("--console", action="store_true")

    b = job("build-dataset", "archive", "output")
    b.add_argument("--label-horizon-min", type=int, default=5)

    t = job("train", "training", "output")
    t.add_argument("--holdout-frac", type=float, default=0.2)
    t.add_argument("--max-p", type=int, default=3)
    t.add_argument("--max-q", type=int, default=3)
    t.add_argument("--delay", type=int, default=5)
    t.add_argument("--require-contiguous", action="store_true")

    c = job("score", "location", "output", "checkpoint", "model")
    c.add_argument("--source", choices=("kafka", "files"), default="kafka")
    c.add_argument("--strict-history", action="store_true")
    c.add_argument("--emit-interval", type=int, default=1)
    c.add_argument("--single-partition", action="store_true")
    c.add_argument("--lateness", default=state.LATENESS)
    c.add_argument("--max-per-trigger", type=int, default=100_000, help="offsets or files in one micro-batch")

    p = job("probe", "archive")
    p.add_argument("--target", type=float, default=4000.0)
    job("compact", "archive", "output")

    args = parser.parse_args(argv)
    spark = build_session(f"marketlake-{args.job}", args.master)
    if args.job == "stream":
        stream(spark, args)
    elif args.job == "build-dataset":
        build_dataset(spark, args.archive, args.output, Grains(horizon=args.label_horizon_min)).show()
    elif args.job == "train":
        step = Grains().minute if args.require_contiguous else None
        train(
            spark, args.training, args.output, args.holdout_frac, args.max_p, args.max_q, args.delay, step
        ).show(200, truncate=False)
        split = time_split(spark.read.parquet(args.training), args.holdout_frac)
        stats.split_summary(split, TARGET).show(200)
        stats.feature_summary(split, (*EXOG, TARGET), ("series",), (TARGET,)).show(200)
    elif args.job == "score":
        score(spark, args)
    elif args.job == "probe":
        for table in probe(spark, args.archive, args.target):
            table.show(100, truncate=False)
    else:
        ticks.compact_ticks(spark, args.archive, args.output)


if __name__ == "__main__":
    main()

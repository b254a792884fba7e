"""Forecast evaluation: errors, baselines, calibration, edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.pricing import implied_log_return, prob_up
from marketlake.schemas import TARGET


def stack_predictions(rows: DataFrame, y: str, predictions: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """One row per (row, prediction column): by…, forecaster, y, pred."""
    return rows.select(
        *by,
        F.col(y).alias("y"),
        F.explode(
            F.array(
                *[F.struct(F.lit(p).alias("forecaster"), F.col(p).alias("pred")) for p in predictions]
            )
        ).alias("_e"),
    ).select(*by, "_e.forecaster", "y", "_e.pred")


def regression_metrics(
    rows: DataFrame, y: str, predictions: tuple[str, ...], by: tuple[str, ...] = ("series",)
) -> DataFrame:
    """RMSE, MAE and directional accuracy per forecaster; direction only where y ≠ 0."""
    stacked = stack_predictions(rows, y, predictions, by).where(
        F.col("y").isNotNull() & F.col("pred").isNotNull()
    )
    err = F.col("pred") - F.col("y")
    hit = F.when(
        F.col("y") != 0, F.when(F.signum("pred") == F.signum("y"), 1.0).otherwise(0.0)
    )
    return stacked.groupBy(*by, "forecaster").agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(hit).alias("dir_acc"),
    )


def sigma_by_series(
    split: DataFrame, target: str = TARGET, keys: tuple[str, ...] = ("series",)
) -> DataFrame:
    """Sample standard deviation of the training target."""
    return (
        split.where(F.col("split") == "train")
        .groupBy(*keys)
        .agg(F.count("*").alias("n_train"), F.stddev_samp(target).alias("sigma_log"))
    )


def with_baselines(
    rows: DataFrame, sigmas: DataFrame, prob: str = "poly_p_up", keys: tuple[str, ...] = ("series",)
) -> DataFrame:
    """Add market-implied and zero forecasts of the log return."""
    return (
        rows.join(sigmas.select(*keys, "sigma_log"), list(keys))
        .withColumn("market", implied_log_return(prob, "sigma_log"))
        .withColumn("zero", F.lit(0.0))
    )


def baseline_comparison(
    truth: DataFrame,
    model: DataFrame,
    sigmas: DataFrame,
    target: str = TARGET,
    keys: tuple[str, ...] = ("series",),
) -> DataFrame:
    """Model, market-implied and zero forecasts on the holdout rows, aligned by position."""
    rows = truth.where(F.col("split") == "holdout").join(
        model.select(*keys, "idx", F.col("pred").alias("model")), [*keys, "idx"]
    )
    scored = with_baselines(rows, sigmas, keys=keys)
    return regression_metrics(scored, target, ("model", "market", "zero"), keys)


def calibration(
    rows: DataFrame, y: str, probs: tuple[str, ...], by: tuple[str, ...] = (), buckets: int = 10
) -> DataFrame:
    """Per probability bucket: mean predicted probability against the empirical up frequency."""
    stacked = stack_predictions(rows, y, probs, by).where(
        F.col("pred").isNotNull() & F.col("y").isNotNull()
    )
    edge = F.least(F.floor(F.col("pred") * buckets), F.lit(buckets - 1)).cast("bigint")
    return stacked.groupBy(*by, "forecaster", edge.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.avg("pred").alias("mean_prob"),
        F.avg((F.col("y") > 0).cast("double")).alias("up_rate"),
    )


def edge_signal(rows: DataFrame, model_prob: Column | str, market_prob: Column | str, threshold: float = 0.05) -> DataFrame:
    """Rows with edge = model − market probability, flagged where it exceeds the threshold."""
    m = F.col(model_prob) if isinstance(model_prob, str) else model_prob
    k = F.col(market_prob) if isinstance(market_prob, str) else market_prob
    return rows.withColumn("edge", m - k).withColumn("alert", F.abs(F.col("edge")) > threshold)


def with_prob_up(rows: DataFrame, pred: str = "pred", name: str = "model_prob") -> DataFrame:
    return rows.withColumn(name, prob_up(pred, "sigma_log"))

"""Batch scoring of forecast points with fitted parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.pricing import prob_up
from marketlake.functions.times import iso_millis, to_timestamp
from marketlake.operators.arma import INDEX_CHUNK, with_states
from marketlake.operators.asof import asof_join, realized_label
from marketlake.operators.chunks import chunk_window, core_only, row_index, with_halo
from marketlake.operators.features import live_features
from marketlake.operators.resample import Grains
from marketlake.schemas import EXOG, TARGET
from marketlake.session import materialize

MODEL_NAME = "sarimax"
X = {"x_prob": "poly_p_up", "x_change": "poly_p_up_change_5m", "x_vol": "btc_volatility_5m"}


def observed_states(
    bars: DataFrame,
    params: DataFrame,
    grains: Grains = Grains(),
    chunk: int = INDEX_CHUNK,
    strict: bool = False,
) -> DataFrame:
    """Error-process forecast known at each bar, from the newest realised u and e values.

    Bars carry the series' `sigma_log`.

    A bar's label is realised `horizon` bars later, with the features the scorer had at the
    bar. The state at bar T therefore rests on labels up to T − horizon.
    """
    features = live_features(bars.withColumn("sec", F.col("t")), bars, F.col("sigma_log"), grains, strict)
    features = features.select("series", F.col("t").alias("origin_t"), *X)
    realized = realized_label(
        bars, ["series"], "t", "btc_mid", grains.minute, grains.horizon, grains.chunk
    ).where(F.col("realized").isNotNull())
    observed = realized.join(features, ["series", "origin_t"]).select(
        "series", "t", F.col("realized").alias(TARGET), *[F.col(k).alias(v) for k, v in X.items()]
    )
    rows = row_index(observed, ["series"], "t", grains.chunk)
    states, lag = with_states(rows, params, EXOG, TARGET, chunk, grains.horizon)
    halo = with_halo(states, "idx", max(chunk, lag), before=lag)
    w = chunk_window(["series"], "idx")
    past = {
        f"{n}_{k}": F.coalesce(F.lag(n, k).over(w), F.lit(0.0)) for n in ("u", "e") for k in range(lag)
    }
    ahead = F.lit(0.0)
    for k in range(lag):
        ahead = ahead + F.col("_w")[k] * F.col(f"u_{k}") + F.col("_w")[lag + k] * F.col(f"e_{k}")
    return core_only(halo.withColumns(past)).select("series", "t", ahead.alias("ahead"))


def score_rows(features: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Scored output from features, coefficients and the error-process forecast `ahead`."""
    lr = F.coalesce(F.col("ahead"), F.lit(0.0))
    for i, c in enumerate(X):
        lr = lr + F.col(c) * F.col("beta")[i]
    target_s = grains.horizon * grains.minute
    rows = features.withColumn("log_return_pred", lr)
    rows = rows.where(
        F.col("log_return_pred").isNotNull()
        & ~F.isnan("log_return_pred")
        & (F.abs("log_return_pred") != float("inf"))
    )
    forecast = F.col("btc_mid") * F.exp("log_return_pred")
    return rows.select(
        "series",
        iso_millis(to_timestamp("sec")).alias("ts"),
        F.col("sec").cast("double").alias("ts_unix"),
        iso_millis(to_timestamp(F.col("sec") + target_s)).alias("target_ts"),
        F.lit(target_s).alias("target_horizon_s"),
        F.lit(MODEL_NAME).alias("model"),
        "feature_mode",
        F.col("btc_mid").alias("sarimax_input_btc_mid"),
        F.col("poly_p_up").alias("sarimax_poly_prob"),
        "log_return_pred",
        forecast.alias("sarimax_forecast"),
        (forecast - F.col("btc_mid")).alias("sarimax_drift"),
        prob_up("log_return_pred", "sigma_log").alias("sarimax_prob_up"),
        "sigma_log",
    )


def score_batch(
    points: DataFrame,
    bars: DataFrame,
    params: DataFrame,
    grains: Grains = Grains(),
    strict: bool = False,
    chunk: int = INDEX_CHUNK,
) -> DataFrame:
    """Score every point: live features, error-process state as of then, output fields.

    Bars and states (one row per series and minute) are materialised: bars feed four steps,
    and the states' own chain of windows is long.
    """
    bars = materialize(bars)
    sigmas = params.where(F.col("status") == "ok").select("series", "beta", "sigma_log")
    with_sigma = points.join(sigmas, "series")
    features = live_features(with_sigma, bars, F.col("sigma_log"), grains, strict)
    bars_sigma = bars.join(sigmas.drop("beta"), "series")
    states = materialize(observed_states(bars_sigma, params, grains, chunk, strict))
    stated = asof_join(
        features.withColumn("t", F.col("sec")), states, ["series"], "t", ["ahead"], None, grains.chunk
    )
    return score_rows(stated, grains)

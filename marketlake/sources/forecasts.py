"""Forecast messages read back for scoring, and their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.pricing import finite, number
from marketlake.functions.times import iso_millis, parse_seconds, to_timestamp
from marketlake.schemas import FORECAST_TEXT_DDL


def read_forecast_points(messages: DataFrame, value: str = "value") -> DataFrame:
    """Forecast JSON to (series, sec, btc_mid, poly_p_up); unusable messages give no row.

    Time comes from `ts_unix`, else from `ts`, as a number or as ISO-8601 text, cut to the
    second. Both values must be finite numbers.
    """
    m = F.from_json(F.col(value).cast("string"), FORECAST_TEXT_DDL)
    rows = messages.withColumn("_m", m)
    points = rows.select(
        F.col("_m.asset").alias("series"),
        finite(parse_seconds(F.coalesce("_m.ts_unix", "_m.ts"))).alias("_ts"),
        finite(number("_m.btc_mid")).alias("btc_mid"),
        finite(number("_m.poly_prob")).alias("poly_p_up"),
    ).dropna(subset=["_ts", "btc_mid", "poly_p_up"])
    sec = F.when(F.col("_ts") >= 0, F.floor("_ts")).otherwise(F.ceil("_ts")).cast("bigint")
    return points.select("series", sec.alias("sec"), "btc_mid", "poly_p_up")


def forecast_messages(points: DataFrame, key: str = "asset", t: str = "sec") -> DataFrame:
    """Forecast rows to key / JSON value; absent fields are written as null, ts as ISO-8601."""
    fields = ("btc_mid", "poly_prob", "log_return", "drift", "forecast", "sigma", "sigma_log")
    body = F.struct(
        F.col(key).alias("asset"), iso_millis(to_timestamp(t)).alias("ts"), *fields
    )
    return points.select(
        F.col(key).alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )

"""Envelope to tick: one typed row per usable price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.pricing import asset_label, event_price, price_bucket, series_label
from marketlake.schemas import SPOT_SOURCE


def normalize_ticks(envelopes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed ticks; rows without a positive price are dropped.

    `keep` passes further envelope columns through (for example a tie-break id).
    """
    ident = F.when(F.col("source") == SPOT_SOURCE, F.col("symbol")).otherwise(F.col("asset_id"))
    priced = envelopes.withColumn("price", event_price("type")).where(F.col("price") > 0)
    ts = F.col("recv_ts").cast("timestamp")
    labelled = priced.select(
        *keep,
        "source",
        "type",
        ident.alias("ident"),
        asset_label("source", "symbol", "market.slug").alias("asset"),
        ts.alias("ts"),
        "price",
        price_bucket("source", "price").alias("price_bucket"),
        F.col("market.slug").alias("market_slug"),
        F.col("market.outcome").alias("market_outcome"),
    )
    return labelled.select(
        *keep,
        "source",
        "type",
        "ident",
        "asset",
        series_label("source", "ident", "asset", "market_outcome").alias("series"),
        "ts",
        "price",
        "price_bucket",
        "market_slug",
        "market_outcome",
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.hour("ts").alias("hour"),
    )

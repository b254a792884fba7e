"""Decoders for the raw feed frames, before they become envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.schemas import (
    BOOK_EVENT_DDL,
    PREDICTION_SOURCE,
    SPOT_FRAME_DDL,
    SPOT_SOURCE,
    TOPIC_BOOK,
    TOPIC_PREDICTION,
    TOPIC_TRADES,
)

# Event types that carry no market information (fixed values).
NOISE_TYPES = ("tick_size_change",)


def route_topic(kind: Column | str) -> Column:
    """Topic of a spot event: trades apart, everything else is book data."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == "aggTrade", TOPIC_TRADES).otherwise(TOPIC_BOOK)


def decode_spot_frames(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """`{stream: "symbol@type", data: {…}}` to envelope columns.

    Only the first `@` splits, so `depth20@100ms` stays one type. Frames without a stream
    or without data, and text that is not JSON, give no row.
    """
    frame = F.from_json(F.col(raw), SPOT_FRAME_DDL)
    at = F.instr("stream", "@")
    kind = F.when(at > 0, F.expr("substring(stream, instr(stream, '@') + 1)")).otherwise("")
    return (
        frames.withColumn("_f", frame)
        .where((F.col("_f.stream") != "") & F.col("_f.data").isNotNull())
        .withColumn("stream", F.col("_f.stream"))
        .withColumn("source", F.lit(SPOT_SOURCE))
        .withColumn("symbol", F.substring_index("stream", "@", 1))
        .withColumn("type", kind)
        .withColumn("topic", route_topic("type"))
        .withColumn("payload", F.col("_f.data"))
        .drop("_f", "stream", raw)
    )


def _book_events(frames: DataFrame, raw: str) -> DataFrame:
    """One row per event of an object-or-list frame."""
    text = F.trim(F.col(raw))
    as_list = F.when(F.startswith(text, F.lit("[")), text).otherwise(
        F.concat(F.lit("["), text, F.lit("]"))
    )
    events = F.from_json(as_list, f"ARRAY<STRUCT<{BOOK_EVENT_DDL}>>")
    kind = F.coalesce(F.col("_e.event_type"), F.col("_e.type"), F.lit("?"))
    return frames.withColumn("_e", F.explode(events)).drop(raw).withColumn("type", kind)


def flatten_book_frames(frames: DataFrame, raw: str = "raw", drop_noise: bool = False) -> DataFrame:
    """Prediction-market frames to one row per atomic event.

    A `price_change` event fans out into its per-asset changes. Rows without an asset id
    and frames that are no JSON give nothing. With `drop_noise`, event types that carry no
    market information are dropped too.
    """
    events = _book_events(frames, raw)
    if drop_noise:
        events = events.where(~F.col("type").isin(*NOISE_TYPES))
    own = F.struct(
        *[F.col(f"_e.{c}").alias(c) for c in
          ("asset_id", "price", "size", "side", "best_bid", "best_ask", "last_trade_price")]
    )
    changes = F.transform(
        F.col("_e.price_changes"),
        lambda c: F.struct(
            *[c[n].alias(n) for n in ("asset_id", "price", "size", "side", "best_bid", "best_ask")],
            F.lit(None).cast("string").alias("last_trade_price"),
        ),
    )
    items = F.when(F.col("type") == "price_change", changes).otherwise(F.array(own))
    return (
        events.withColumn("payload", F.explode(items))
        .where(F.col("payload.asset_id") != "")
        .withColumn("asset_id", F.col("payload.asset_id"))
        .withColumn("source", F.lit(PREDICTION_SOURCE))
        .withColumn("topic", F.lit(TOPIC_PREDICTION))
        .drop("_e")
    )


def top_of_book(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """Best bid / ask (first level of each side), depth per side and last trade of book events."""
    depth = lambda side: F.coalesce(F.size(F.col(f"_e.{side}")), F.lit(0)).cast("bigint")
    best = lambda side: F.get(F.col(f"_e.{side}"), F.lit(0))["price"].try_cast("double")
    return (
        _book_events(frames, raw)
        .where((F.col("type") == "book") & (F.col("_e.asset_id") != ""))
        .withColumn("asset_id", F.col("_e.asset_id"))
        .withColumn("best_bid", best("bids"))
        .withColumn("best_ask", best("asks"))
        .withColumn("bid_depth", depth("bids"))
        .withColumn("ask_depth", depth("asks"))
        .withColumn("last_trade", F.col("_e.last_trade_price").try_cast("double"))
        .drop("_e", "type")
    )


def book_features(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """Spread and size imbalance of each book event, over all its levels."""
    total = lambda side: F.aggregate(
        F.coalesce(F.col(f"_e.{side}"), F.array().cast("array<struct<price:string,size:string>>")),
        F.lit(0.0),
        lambda acc, lvl: acc + F.coalesce(lvl["size"].try_cast("double"), F.lit(0.0)),
    )
    best = lambda side: F.get(F.col(f"_e.{side}"), F.lit(0))["price"].try_cast("double")
    return (
        _book_events(frames, raw)
        .where((F.col("type") == "book") & (F.col("_e.asset_id") != ""))
        .withColumn("asset_id", F.col("_e.asset_id"))
        .withColumn("spread", best("asks") - best("bids"))
        .withColumn("bid_size", total("bids"))
        .withColumn("ask_size", total("asks"))
        .withColumn(
            "imbalance",
            F.try_divide(
                F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size")
            ),
        )
        .drop("_e", "type")
    )

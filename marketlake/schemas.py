"""Schemas of the wire messages and of the landed tables (fixed values).

Field names and types must equal what the feeds send, so they are stated here
once, as DDL text, and used by every parser.
"""

from __future__ import annotations

# Union of the flat payload fields of all feeds; prices arrive as text.
PAYLOAD_DDL = (
    "p STRING, q STRING, m BOOLEAN, T BIGINT, "
    "b STRING, B STRING, a STRING, A STRING, "
    "price STRING, size STRING, side STRING, best_bid STRING, best_ask STRING, "
    "last_trade_price STRING"
)
MARKET_DDL = "question STRING, slug STRING, outcome STRING"
ENVELOPE_DDL = (
    "source STRING, type STRING, recv_ts DOUBLE, symbol STRING, asset_id STRING, "
    f"market STRUCT<{MARKET_DDL}>, payload STRUCT<{PAYLOAD_DDL}>"
)
LEVELS_DDL = "ARRAY<STRUCT<price STRING, size STRING>>"

SPOT_FRAME_DDL = f"stream STRING, data STRUCT<{PAYLOAD_DDL}>"
PRICE_CHANGE_DDL = (
    "asset_id STRING, price STRING, size STRING, side STRING, best_bid STRING, best_ask STRING"
)
BOOK_EVENT_DDL = (
    "event_type STRING, type STRING, asset_id STRING, price STRING, size STRING, side STRING, "
    "best_bid STRING, best_ask STRING, last_trade_price STRING, "
    f"bids {LEVELS_DDL}, asks {LEVELS_DDL}, "
    f"price_changes ARRAY<STRUCT<{PRICE_CHANGE_DDL}>>"
)
CATALOGUE_DDL = (
    "question STRING, slug STRING, volume DOUBLE, endDate STRING, "
    "clobTokenIds STRING, outcomes STRING"
)

TICK_DDL = (
    "source STRING, type STRING, ident STRING, asset STRING, series STRING, ts TIMESTAMP, "
    "price DOUBLE, price_bucket DOUBLE, market_slug STRING, market_outcome STRING, "
    "date STRING, hour INT"
)
TICK_PARTITIONS = ("source", "date", "hour")

STATS_DDL = (
    "window_start TIMESTAMP, window_end TIMESTAMP, source STRING, ident STRING, asset STRING, "
    "series STRING, market_outcome STRING, price_bucket DOUBLE, price_min DOUBLE, "
    "price_max DOUBLE, price_avg DOUBLE, price_var DOUBLE, n BIGINT"
)
FORECAST_TEXT_DDL = (
    "asset STRING, ts STRING, ts_unix STRING, btc_mid STRING, poly_prob STRING"
)

# Topics the feeds publish to, and the two the engine publishes.
TOPIC_PREDICTION = "polymarket.events"
TOPIC_TRADES = "binance.trades"
TOPIC_BOOK = "binance.book"
TOPIC_STATS = "stats.windowed"
TOPIC_FORECAST = "btc.forecast.clean"
TOPIC_SCORED = "btc.sarimax-forecast.clean"
INPUT_TOPICS = (TOPIC_PREDICTION, TOPIC_TRADES, TOPIC_BOOK)

SPOT_SOURCE = "binance"
PREDICTION_SOURCE = "polymarket"
UP_OUTCOMES = ("Up", "Yes")
DEFAULT_SIGMA_LOG = 0.0005
EXOG = ("poly_p_up", "poly_p_up_change_5m", "btc_volatility_5m")
TARGET = "log_return_5m"

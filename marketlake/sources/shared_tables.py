"""View of the shared `events` table as feed messages.

The shared tables hold no market ticks. One deterministic mapping turns each event into
one feed message, so every query reads the whole table and grows with it:

    click    → spot trade          (aggTrade)
    purchase → spot quote          (bookTicker, one unit either side of value * 100)
    error    → spot depth snapshot (depth20@100ms, carries no price)
    view     → probability level   (price_change, price = props.k / 100)
    signup   → probability trade   (last_trade_price, same price)

    asset   = btc / eth / sol by user_id mod 3      outcome = Up / Down by user_id mod 2
    slug    = <asset>-updown-5m-<start of the event's 5-minute window>
    recv_ts = event time in unix seconds
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlake.operators.resample import Grains
from marketlake.schemas import (
    LEVELS_DDL,
    MARKET_DDL,
    PAYLOAD_DDL,
    PREDICTION_SOURCE,
    PRICE_CHANGE_DDL,
    SPOT_SOURCE,
    TOPIC_PREDICTION,
)
from marketlake.sources.envelope import to_envelope
from marketlake.sources.frames import route_topic

EVENTS_DDL = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

# Events lie minutes apart, so the time scales are those of a slow feed.
SLOW = Grains(
    second=600,
    minute=3600,
    spot_fill=6 * 3600,
    prob_fill=12 * 3600,
    spot_stale=6 * 3600,
    prob_stale=18 * 3600,
    chunk_rows=200,
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in as many pieces as the session has cores: it is one small file."""
    events = spark.read.schema(EVENTS_DDL).parquet(f"{sf_dir}/events.parquet")
    return events.repartition(spark.sparkContext.defaultParallelism)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a file stream, dealt over the cores as well."""
    events = spark.readStream.schema(EVENTS_DDL).parquet(f"{sf_dir}/events.parquet*")
    return events.repartition(spark.sparkContext.defaultParallelism)


def _is_spot() -> Column:
    return F.col("event_type").isin("click", "purchase", "error")


def _text(c: Column) -> Column:
    return c.cast("string")


def _struct_of(ddl: str, **given: Column) -> Column:
    """A struct of the whole schema; fields not given are NULL."""
    return F.struct(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(ddl)
        ]
    )


def _described(events: DataFrame) -> DataFrame:
    asset = F.element_at(
        F.array(F.lit("btc"), F.lit("eth"), F.lit("sol")), (F.col("user_id") % 3 + 1).cast("int")
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.floor(micros / 300_000_000) * 300
    return (
        events.where(
            F.col("event_type").isin("click", "purchase", "error", "view", "signup")
        )
        .withColumn("_asset", asset)
        .withColumn("recv_ts", micros / 1_000_000)
        .withColumn("_outcome", F.when(F.col("user_id") % 2 == 0, "Up").otherwise("Down"))
        .withColumn("_slug", F.concat("_asset", F.lit("-updown-5m-"), start.cast("string")))
        .withColumn("_k", F.get_json_object("props", "$.k").try_cast("double") / 100)
    )


def _kind() -> Column:
    e = F.col("event_type")
    return (
        F.when(e == "click", "aggTrade")
        .when(e == "purchase", "bookTicker")
        .when(e == "error", "depth20@100ms")
        .when(e == "view", "price_change")
        .when(e == "signup", "last_trade_price")
    )


def _payload() -> Column:
    e, px = F.col("event_type"), F.col("value") * 100
    trade, quote = e == "click", e == "purchase"
    prob = e.isin("view", "signup")
    return _struct_of(
        PAYLOAD_DDL,
        p=F.when(trade, _text(px)),
        q=F.when(trade, _text(F.col("value"))),
        m=F.when(trade, F.col("user_id") % 2 == 1),
        T=F.when(trade, F.floor(F.col("recv_ts") * 1000)),
        b=F.when(quote, _text(px - 1)),
        B=F.when(quote, F.lit("1.0")),
        a=F.when(quote, _text(px + 1)),
        A=F.when(quote, F.lit("2.0")),
        price=F.when(prob, _text(F.col("_k"))),
        size=F.when(prob, _text(F.col("value"))),
        side=F.when(prob, F.when(F.col("user_id") % 4 < 2, "BUY").otherwise("SELL")),
    )


def bind_envelopes(events: DataFrame) -> DataFrame:
    """Typed envelope rows (with `event_id`), for operators that start after the parser."""
    spot = _is_spot()
    d = _described(events)
    token = F.concat("_slug", F.lit("#"), "_outcome")
    market = _struct_of(
        MARKET_DDL,
        question=F.concat(F.upper("_asset"), F.lit(" up or down")),
        slug=F.col("_slug"),
        outcome=F.col("_outcome"),
    )
    return d.select(
        "event_id",
        F.when(spot, route_topic(_kind())).otherwise(TOPIC_PREDICTION).alias("topic"),
        F.when(spot, SPOT_SOURCE).otherwise(PREDICTION_SOURCE).alias("source"),
        _kind().alias("type"),
        "recv_ts",
        F.when(spot, F.concat("_asset", F.lit("usdt"))).alias("symbol"),
        F.when(~spot, token).alias("asset_id"),
        F.when(~spot, market).alias("market"),
        _payload().alias("payload"),
    )


def bind_messages(events: DataFrame) -> DataFrame:
    """The same rows as a message stream: topic, key and JSON bytes."""
    env = bind_envelopes(events)
    text = to_envelope(
        F.col("source"),
        F.col("type"),
        F.col("recv_ts"),
        F.col("payload"),
        symbol=F.col("symbol"),
        asset_id=F.col("asset_id"),
        market=F.col("market"),
    )
    return env.select(
        "event_id",
        "topic",
        F.coalesce("symbol", "asset_id").alias("key"),
        # never NULL, and said so: the parser's NULL check then needs no second rendering
        F.coalesce(text, F.lit("")).cast("binary").alias("value"),
    )


def bind_noisy_messages(events: DataFrame) -> DataFrame:
    """Messages of which some are broken, as a feed would send them: every 50th event loses
    its tail, every 50th (offset 1) has no type, every 50th (offset 2) has no value."""
    m = bind_messages(events)
    text = F.col("value").cast("string")
    slot = F.col("event_id") % 50
    broken = (
        F.when(slot == 0, F.expr("substring(cast(value as string), 1, 20)"))
        .when(slot == 1, F.regexp_replace(text, '"type":"[^"]*",', ""))
        .when(slot == 2, F.lit(None).cast("string"))
        .otherwise(text)
    )
    return m.withColumn("value", broken.cast("binary"))


def bind_spot_frames(events: DataFrame) -> DataFrame:
    """Raw spot frames `{stream, data}`; every 40th has an empty stream, every 40th no data."""
    d = _described(events).where(_is_spot())
    slot = F.col("event_id") % 40
    stream = F.when(slot == 0, "").otherwise(
        F.concat("_asset", F.lit("usdt@"), _kind())
    )
    data = F.when(slot == 1, F.lit(None)).otherwise(_payload())
    return d.select(
        "event_id", "recv_ts", F.to_json(F.struct(stream.alias("stream"), data.alias("data"))).alias("raw")
    )


def bind_book_frames(events: DataFrame) -> DataFrame:
    """Raw prediction frames from view / signup / error events.

    view   → a list holding one price_change event with three changes: the token, its
             complement at 1 − price, and one without asset id
    signup → a single last_trade_price object (named by `type`, not `event_type`)
    error  → a list of a book event and a tick_size_change event; bids has user_id mod 4
             levels, asks has user_id mod 3
    """
    d = _described(events).where(F.col("event_type").isin("view", "signup", "error"))
    up, down = F.concat("_slug", F.lit("#Up")), F.concat("_slug", F.lit("#Down"))
    token = F.concat("_slug", F.lit("#"), "_outcome")
    other = F.when(F.col("_outcome") == "Up", down).otherwise(up)
    change = lambda aid, px: _struct_of(
        PRICE_CHANGE_DDL, asset_id=aid, price=_text(px), size=_text(F.col("value")), side=F.lit("BUY")
    )
    view = F.to_json(
        F.array(
            F.struct(
                F.lit("price_change").alias("event_type"),
                F.array(
                    change(token, F.col("_k")), change(other, 1 - F.col("_k")), change(F.lit(""), F.col("_k"))
                ).alias("price_changes"),
            )
        )
    )
    signup = F.to_json(
        F.struct(
            F.lit("last_trade_price").alias("type"),
            token.alias("asset_id"),
            _text(F.col("_k")).alias("price"),
            _text(F.col("value")).alias("size"),
        )
    )
    level = lambda side, sign: F.transform(
        F.when(
            side > 0, F.sequence(F.lit(1), side)
        ).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            _text(F.col("value") + sign * i).alias("price"), _text(i * 2.0).alias("size")
        ),
    ).cast(LEVELS_DDL)
    event = lambda kind, bids, asks, last: F.struct(
        F.lit(kind).alias("event_type"),
        token.alias("asset_id"),
        bids.alias("bids"),
        asks.alias("asks"),
        last.alias("last_trade_price"),
    )
    none = F.lit(None).cast(LEVELS_DDL)
    book = F.to_json(
        F.array(
            event(
                "book",
                level((F.col("user_id") % 4).cast("int"), -1.0),
                level((F.col("user_id") % 3).cast("int"), 1.0),
                _text(F.col("value")),
            ),
            event("tick_size_change", none, none, F.lit(None).cast("string")),
        )
    )
    e = F.col("event_type")
    return d.select(
        "event_id",
        "recv_ts",
        F.when(e == "view", view).when(e == "signup", signup).otherwise(book).alias("raw"),
    )


def bind_catalogue(events: DataFrame) -> DataFrame:
    """Market catalogue: one row per slug seen in view / signup events.

    Volume is the summed event value. By the smallest event id of the slug: every 7th has a
    short outcomes list, every 11th malformed token text, every 13th no tokens at all.
    """
    d = _described(events).where(F.col("event_type").isin("view", "signup"))
    per_slug = d.groupBy("_slug", "_asset").agg(
        F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("volume"),
        F.min("event_id").alias("position"),
    )
    up, down = F.concat("_slug", F.lit("#Up")), F.concat("_slug", F.lit("#Down"))
    pos = F.col("position")
    tokens = (
        F.when(pos % 13 == 0, F.lit(None).cast("string"))
        .when(pos % 11 == 0, F.concat(F.lit("[\""), up))
        .otherwise(F.to_json(F.array(up, down)))
    )
    outcomes = F.when(pos % 7 == 0, F.to_json(F.array(F.lit("Up")))).otherwise(
        F.to_json(F.array(F.lit("Up"), F.lit("Down")))
    )
    return per_slug.select(
        "position",
        F.concat(F.upper("_asset"), F.lit(" up or down")).alias("question"),
        F.col("_slug").alias("slug"),
        "volume",
        F.lit(None).cast("string").alias("endDate"),
        tokens.alias("clobTokenIds"),
        outcomes.alias("outcomes"),
    )

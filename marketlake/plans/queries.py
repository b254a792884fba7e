"""Registered queries: one per operator, each over the whole shared tables.

A query binds the `events` table as feed messages, runs one operator and names its result
columns; `oracle.py` states the same result in SQL. Floating point results are rounded to
six digits, since two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from marketlake.functions.pricing import (
    DRIFT_BANDS,
    PROBABILITY_BANDS,
    band,
    bps,
    implied_forecast,
    prob_up,
    probability_leg,
    spot_leg,
)
from marketlake.functions.times import bucket, rolling_slug, slug_end, slug_start
from marketlake.operators import arma, asof, features, metrics, ordered, resample, score, stats
from marketlake.operators.normalize import normalize_ticks
from marketlake.schemas import EXOG, STATS_DDL, TARGET, TOPIC_FORECAST, TOPIC_STATS
from marketlake.session import configure, make_dir, materialize, work_dir
from marketlake.sources import catalogue, envelope, forecasts, frames, models, ticks as archive
from marketlake.sources import shared_tables as bind
from marketlake.sources.shared_tables import SLOW
from marketlake.streaming import pipeline, state, timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Query parameters, shared with the SQL in oracle.py.
SIGMA = 0.0005
PROB_STALE = 18 * 3600
SPOT_STALE = 6 * 3600


def query(fn: Query) -> Query:
    """Register under the function's name (a trailing `_query` avoids clashes with imports)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.removesuffix("_query")] = run
    return run


def rounded(digits: int, *names: str):
    return {n: F.round(F.col(n), digits) for n in names}


def r6(*names: str):
    """Round the named double columns to six digits."""
    return rounded(6, *names)


def r8(*names: str):
    return rounded(8, *names)


def r10(*names: str):
    """Returns are near 5e-4: six digits would compare two or three of them."""
    return rounded(10, *names)


# --- inputs ---------------------------------------------------------------------------


def _events(spark, sf_dir):
    return bind.read_events(spark, sf_dir)


def _envelopes(spark, sf_dir):
    return bind.bind_envelopes(_events(spark, sf_dir))


def _ticks(spark, sf_dir):
    """Typed ticks without the JSON round trip, for queries about later operators."""
    return normalize_ticks(_envelopes(spark, sf_dir), keep=("event_id",))


def _points(spark, sf_dir):
    """Forecast points per asset and second, not yet filled."""
    return stats.forecast_stats(_ticks(spark, sf_dir), SIGMA, "10 minutes").withColumn(
        "sec", F.col("ts").cast("bigint")
    )


def _filled(spark, sf_dir):
    return features.carry_forward(
        _points(spark, sf_dir), SIGMA, PROB_STALE, SPOT_STALE, SLOW.chunk
    )


def _score_points(spark, sf_dir):
    return _filled(spark, sf_dir).where(
        F.col("btc_mid").isNotNull() & F.col("poly_prob").isNotNull()
    ).select(F.col("asset").alias("series"), "sec", "btc_mid", F.col("poly_prob").alias("poly_p_up"))


def _bars(spark, sf_dir):
    return materialize(features.minute_bars(_score_points(spark, sf_dir), SLOW))


def _training(spark, sf_dir):
    return resample.build_training_table(_ticks(spark, sf_dir), SLOW)


def _split(spark, sf_dir):
    return resample.time_split(_training(spark, sf_dir), chunk=SLOW.chunk)


def _ar1(split):
    return materialize(arma.fit_arx(split, order=(1, 0), chunk=200))


# --- scans, parsing, enrichment -------------------------------------------------------


@query
def parse_envelope(spark, sf_dir):
    parsed = envelope.parse_envelope(bind.bind_noisy_messages(_events(spark, sf_dir)))
    return parsed.where(F.col("type").isNotNull()).select(
        "topic", "source", "type", "recv_ts", "symbol", "asset_id",
        F.col("market.slug").alias("slug"), F.col("market.outcome").alias("outcome"),
        F.col("payload.p").try_cast("double").alias("p"),
        F.col("payload.b").try_cast("double").alias("bid"),
        F.col("payload.B").try_cast("double").alias("bid_qty"),
        F.col("payload.price").try_cast("double").alias("price"),
        F.col("payload.m").alias("m"),
    )


@query
def parse_rejects(spark, sf_dir):
    rejects = envelope.parse_rejects(bind.bind_noisy_messages(_events(spark, sf_dir)))
    return rejects.groupBy("topic", "reason").agg(F.count("*").alias("n"))


@query
def to_envelope(spark, sf_dir):
    """Round trip: columns to envelope text and back."""
    back = envelope.parse_envelope(bind.bind_messages(_events(spark, sf_dir)))
    return back.groupBy("topic", "source", "type").agg(
        F.count("*").alias("n"),
        F.sum(F.floor("recv_ts")).alias("recv_sec_sum"),
        F.count("symbol").alias("n_symbol"),
        F.count("asset_id").alias("n_asset_id"),
    )


@query
def decode_spot_frames(spark, sf_dir):
    rows = frames.decode_spot_frames(bind.bind_spot_frames(_events(spark, sf_dir)))
    return rows.select(
        "event_id", "source", "symbol", "type",
        F.col("payload.p").try_cast("double").alias("p"),
        F.col("payload.b").try_cast("double").alias("bid"),
        F.col("payload.A").try_cast("double").alias("ask_qty"),
    )


@query
def route_topic(spark, sf_dir):
    rows = frames.decode_spot_frames(bind.bind_spot_frames(_events(spark, sf_dir)))
    return rows.groupBy("topic", "type").agg(F.count("*").alias("n"))


@query
def flatten_book_frames(spark, sf_dir):
    rows = frames.flatten_book_frames(bind.bind_book_frames(_events(spark, sf_dir)), drop_noise=True)
    return rows.select(
        "event_id", "type", "asset_id", "source",
        F.round(F.col("payload.price").try_cast("double"), 6).alias("price"),
        F.col("payload.size").try_cast("double").alias("size"),
        F.col("payload.last_trade_price").try_cast("double").alias("last_trade_price"),
    )


@query
def token_map(spark, sf_dir):
    return catalogue.token_map(bind.bind_catalogue(_events(spark, sf_dir)))


@query
def enrich_market(spark, sf_dir):
    events = _events(spark, sf_dir)
    tokens = catalogue.token_map(bind.bind_catalogue(events))
    rows = frames.flatten_book_frames(bind.bind_book_frames(events), drop_noise=True)
    return catalogue.enrich_market(rows, tokens).select(
        "event_id", "type", "asset_id",
        F.col("market.slug").alias("slug"),
        F.col("market.outcome").alias("outcome"),
    )


@query
def top_markets(spark, sf_dir):
    return catalogue.top_markets(bind.bind_catalogue(_events(spark, sf_dir)), n=20).select(
        "slug", F.round("volume", 6).alias("volume")
    )


@query
def top_markets_keyword(spark, sf_dir):
    return catalogue.top_markets(
        bind.bind_catalogue(_events(spark, sf_dir)), n=20, keyword="ETH"
    ).select("slug", F.round("volume", 6).alias("volume"))


def _resolved(spark, sf_dir):
    events = _events(spark, sf_dir)
    spot = _envelopes(spark, sf_dir).where(F.col("source") == "binance")
    wanted = spot.select(
        F.regexp_replace("symbol", "usdt$", "").alias("asset"), F.floor("recv_ts").alias("at")
    )
    return catalogue.resolve_rolling_market(wanted, bind.bind_catalogue(events))


@query
def resolve_rolling_market(spark, sf_dir):
    return _resolved(spark, sf_dir).select("asset", "at", "slug", "is_live")


@query
def missing_markets(spark, sf_dir):
    return catalogue.missing_markets(_resolved(spark, sf_dir)).groupBy("asset").agg(
        F.count("*").alias("n_missing"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


@query
def rediscovery_deadline(spark, sf_dir):
    return catalogue.rediscovery_deadline(_resolved(spark, sf_dir))


@query
def slug_window(spark, sf_dir):
    env = _envelopes(spark, sf_dir).where(F.col("asset_id").isNotNull())
    slug = F.when(F.col("event_id") % 30 == 0, "will-it-rain").otherwise(F.col("market.slug"))
    return env.select("event_id", "recv_ts", slug.alias("slug")).select(
        "event_id",
        "slug",
        slug_start("slug").alias("window_start"),
        slug_end("slug", 5, F.col("recv_ts")).alias("window_end"),
        rolling_slug(F.substring_index("slug", "-", 1), F.floor("recv_ts"), 5, 1).alias("next_slug"),
    )


def _archived(spark, sf_dir):
    root = work_dir(spark, "ticks")
    archive.write_ticks(_ticks(spark, sf_dir).drop("event_id"), root)
    return root


@query
def read_ticks(spark, sf_dir):
    """Archive round trip, read with folder and column pruning."""
    rows = archive.read_ticks(spark, _archived(spark, sf_dir)).where(
        (F.col("source") == "binance") & (F.col("hour") < 12)
    )
    return rows.groupBy("date", "ident", "type").agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("price_sum")
    )


@query
def compact_ticks(spark, sf_dir):
    root, target = _archived(spark, sf_dir), work_dir(spark, "compacted")
    archive.compact_ticks(spark, root, target)
    return archive.read_ticks(spark, target).groupBy("source", "date").agg(
        F.count("*").alias("n"),
        F.countDistinct("hour").alias("hours"),
        F.round(F.max("price"), 6).alias("price_max"),
    )


@query
def compact_changed(spark, sf_dir):
    """An archive that grows after its first compaction: folders rewritten by the second run, all rows, and a third run."""
    root, target = work_dir(spark, "ticks"), work_dir(spark, "compacted")
    ticks = materialize(_ticks(spark, sf_dir).drop("event_id"))
    late = F.expr("source = 'binance' AND hour >= 20")
    archive.write_ticks(ticks.where(~late), root)
    archive.compact_changed(spark, root, target)
    archive.write_ticks(ticks.where(late), root)
    second = archive.compact_changed(spark, root, target).select("source", "date", "hour", F.lit(True).alias("late"))
    third = archive.compact_changed(spark, root, target).select("source", "date", "hour", F.lit(True).alias("again"))
    folders = archive.read_ticks(spark, target).groupBy("source", "date", "hour").agg(F.count("*").alias("n"))
    same = ["source", "date", "hour"]
    return folders.join(second, same, "left").join(third, same, "left").fillna(False, ["late", "again"])


@query
def sigma_lookup(spark, sf_dir):
    """σ per asset; one asset's metadata is text, another's is implausible."""
    ticks = _ticks(spark, sf_dir)
    meta = ticks.groupBy(F.col("asset").alias("series")).agg(F.count("*").alias("n")).select(
        "series",
        F.when(F.col("series") == "ETH", "not a number")
        .when(F.col("series") == "SOL", "50")
        .otherwise((F.col("n") / 1e7).cast("string"))
        .alias("sigma_log"),
    )
    keys = ticks.groupBy(F.col("series").alias("label"), F.col("asset").alias("series")).agg(
        F.count("*").alias("n")
    )
    return models.sigma_lookup(keys, meta).select("label", "n", F.round("sigma_log", 9).alias("sigma_log"))


@query
def read_forecast_points(spark, sf_dir):
    """Forecast messages written and read back; some carry ts_unix, some NaN text, some no JSON."""
    rows = _filled(spark, sf_dir)
    msgs = forecasts.forecast_messages(rows)
    odd = rows.select(
        "asset",
        F.to_json(
            F.struct(
                "asset",
                F.when(F.col("sec") / 600 % 3 == 0, F.col("sec") + 0.25).alias("ts_unix"),
                F.col("sec").cast("string").alias("ts"),
                F.when(F.col("sec") / 600 % 5 == 0, F.lit("NaN"))
                .otherwise(F.col("btc_mid").cast("string"))
                .alias("btc_mid"),
                "poly_prob",
            )
        ).alias("value"),
    ).select("value")
    both = msgs.select("value").unionByName(odd)
    return forecasts.read_forecast_points(both).groupBy("series", "sec").agg(
        F.count("*").alias("n"),
        F.round(F.max("btc_mid"), 6).alias("btc_mid"),
        F.round(F.max("poly_p_up"), 6).alias("poly_p_up"),
    )


@query
def top_of_book(spark, sf_dir):
    return frames.top_of_book(bind.bind_book_frames(_events(spark, sf_dir))).select(
        "event_id", "asset_id",
        F.round("best_bid", 6).alias("best_bid"), F.round("best_ask", 6).alias("best_ask"),
        "bid_depth", "ask_depth", "last_trade",
    )


@query
def book_features(spark, sf_dir):
    return frames.book_features(bind.bind_book_frames(_events(spark, sf_dir))).select(
        "event_id", F.round("spread", 6).alias("spread"), "bid_size", "ask_size",
        F.round("imbalance", 6).alias("imbalance"),
    )


# --- projections ----------------------------------------------------------------------


@query
def normalize_ticks_query(spark, sf_dir):
    rows = normalize_ticks(envelope.parse_envelope(bind.bind_messages(_events(spark, sf_dir))))
    return rows.withColumn("hour", F.col("hour").cast("bigint")).withColumns(r6("price", "price_bucket"))



@query
def price_bucket(spark, sf_dir):
    return _ticks(spark, sf_dir).groupBy("source", "price_bucket").agg(
        F.count("*").alias("n"),
        F.round(F.min("price"), 6).alias("price_min"),
        F.round(F.max("price"), 6).alias("price_max"),
    )


@query
def leg_predicates(spark, sf_dir):
    return (
        _ticks(spark, sf_dir)
        .groupBy("asset", "type")
        .agg(
            F.count("*").alias("n"),
            F.sum(spot_leg().cast("bigint")).alias("n_spot"),
            F.sum(F.coalesce(probability_leg().cast("bigint"), F.lit(0))).alias("n_prob"),
        )
    )


@query
def implied_forecast_query(spark, sf_dir):
    rows = _training(spark, sf_dir)
    cols = implied_forecast("btc_mid", "poly_p_up", F.lit(SIGMA))
    return rows.select(
        "series", "t", *[F.round(c, 6).alias(n) for n, c in cols.items()]
    )



@query
def prob_up_query(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return rows.select(
        "series", "t", F.round(prob_up("log_return_5m", F.lit(1.5)), 6).alias("p_up")
    )



@query
def forecast_json(spark, sf_dir):
    """Rows to JSON values and back through the parser, with absent fields kept as null."""
    msgs = forecasts.forecast_messages(_points(spark, sf_dir).drop("ts"))
    body = F.from_json("value", "asset STRING, ts STRING, btc_mid DOUBLE, poly_prob DOUBLE, drift DOUBLE")
    return msgs.select("key", body.alias("m"), "value").select(
        "key", "m.ts", F.round("m.btc_mid", 6).alias("btc_mid"), F.round("m.poly_prob", 6).alias("poly_prob"),
        F.col("value").contains('"drift":null').alias("drift_is_null"),
    )


@query
def bands(spark, sf_dir):
    rows = _filled(spark, sf_dir)
    return rows.groupBy(
        band("poly_prob", PROBABILITY_BANDS).alias("prob_band"), band("drift", DRIFT_BANDS).alias("drift_band")
    ).agg(F.count("*").alias("n"))


@query
def basis_points(spark, sf_dir):
    return _training(spark, sf_dir).select(
        "series", "t", F.round(bps("log_return_5m"), 4).alias("label_bps"),
        F.round(bps("btc_volatility_5m"), 4).alias("vol_bps"),
    )


# --- aggregations ---------------------------------------------------------------------

STAT_FLOATS = ("price_bucket", "price_min", "price_max", "price_avg", "price_var")


@query
def windowed_stats(spark, sf_dir):
    ticks = normalize_ticks(envelope.parse_envelope(bind.bind_messages(_events(spark, sf_dir))))
    return stats.windowed_stats(ticks, "1 hour").withColumns(r6(*STAT_FLOATS))


@query
def sliding_stats(spark, sf_dir):
    return stats.sliding_stats(_ticks(spark, sf_dir), "2 hours", "1 hour").withColumns(r6(*STAT_FLOATS))


@query
def forecast_stats(spark, sf_dir):
    return _points(spark, sf_dir).drop("sec").withColumns(
        r6("btc_mid", "poly_prob", "log_return", "drift", "forecast", "sigma")
    )


@query
def last_per_bucket(spark, sf_dir):
    return resample.last_per_bucket(_ticks(spark, sf_dir), SLOW).withColumns(r6("btc_mid", "poly_p_up"))


@query
def event_mix(spark, sf_dir):
    return stats.event_mix(_envelopes(spark, sf_dir)).withColumns(r6("share_pct"))


@query
def throughput_summary(spark, sf_dir):
    return stats.throughput_summary(_envelopes(spark, sf_dir)).withColumns(r6("avg_rate"))


@query
def rolling_rate(spark, sf_dir):
    return stats.rolling_rate(_envelopes(spark, sf_dir), window_s=600.0, chunk_s=86_400)


@query
def message_rates(spark, sf_dir):
    return stats.message_rates(_envelopes(spark, sf_dir), interval_s=3600, window_s=600.0).withColumns(
        r6("interval_rate", "avg_rate")
    )


@query
def latency_summary(spark, sf_dir):
    """Event values as latencies, per event type."""
    rows = _events(spark, sf_dir)
    return stats.latency_summary(rows, F.col("value"), ("event_type",)).withColumns(
        r6("mean_us", "p50_us", "p95_us", "p99_us", "max_us", "throughput")
    )


@query
def feature_summary(spark, sf_dir):
    out = stats.feature_summary(
        _training(spark, sf_dir), (*EXOG, "btc_mid", "btc_return_5m", TARGET), ("series",), (TARGET,)
    )
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query
def split_summary(spark, sf_dir):
    return stats.split_summary(_split(spark, sf_dir), TARGET).withColumns(
        {c: F.round(c, 4) for c in ("mean_bps", "std_bps")}
    )


@query
def regression_metrics(spark, sf_dir):
    split = _split(spark, sf_dir)
    rows = metrics.with_baselines(split, metrics.sigma_by_series(split))
    return metrics.regression_metrics(rows, TARGET, ("market", "zero"), ("series", "split")).withColumns(
        r6("rmse", "mae", "dir_acc")
    )


@query
def sigma_by_series(spark, sf_dir):
    return metrics.sigma_by_series(_split(spark, sf_dir)).withColumns(r6("sigma_log"))


@query
def coverage_report(spark, sf_dir):
    return stats.coverage_report(_ticks(spark, sf_dir), SLOW.second)


# --- time series ----------------------------------------------------------------------


@query
def ffill_bounded(spark, sf_dir):
    seconds = resample.last_per_bucket(_ticks(spark, sf_dir), SLOW)
    return resample.ffill_bounded(
        seconds, ["asset"], "sec", {"btc_mid": SLOW.spot_fill, "poly_p_up": SLOW.prob_fill},
        SLOW.chunk, trim=True,
    ).withColumns(r6("btc_mid", "poly_p_up"))


@query
def snapshot_grid(spark, sf_dir):
    cells = materialize(resample.minute_cells(_ticks(spark, sf_dir), SLOW))
    return resample.snapshot_grid(cells, SLOW).withColumns(r6("btc_mid", "poly_p_up"))


@query
def build_training_table(spark, sf_dir):
    return _training(spark, sf_dir).drop("ts").withColumns(
        r6("btc_mid", "poly_p_up", "btc_return_5m", "btc_volatility_5m", "poly_p_up_change_5m", "log_return_5m")
    )


@query
def time_split(spark, sf_dir):
    return _split(spark, sf_dir).select("series", "t", "idx", "split")


@query
def latest_values(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return stats.latest_values(
        rows, "sec", ("btc_mid", "poly_prob", "sigma", "drift"), ("asset",)
    ).withColumns(r6("btc_mid", "poly_prob", "sigma", "drift"))


@query
def last_n(spark, sf_dir):
    rows = _ticks(spark, sf_dir)
    newest = stats.last_n(rows, F.unix_micros("ts"), 100, ("source",), ("event_id",), slot_s=3600)
    return newest.select("source", "event_id", F.col("rn").cast("bigint").alias("rn"), F.round("price", 6).alias("price"))


@query
def gap_check(spark, sf_dir):
    return features.gap_check(_bars(spark, sf_dir), SLOW).select("series", "t", "gap_s", "contiguous")


@query
def latest_stats(spark, sf_dir):
    table = stats.windowed_stats(_ticks(spark, sf_dir), "1 hour")
    messages = table.select(F.to_json(F.struct("*")).alias("value"))
    return stats.latest_stats(messages).withColumns(r6(*STAT_FLOATS))


# --- joins ----------------------------------------------------------------------------


def _asof_sides(spark, sf_dir):
    ticks = _ticks(spark, sf_dir).withColumn("t_us", F.unix_micros("ts"))
    trades = ticks.where(F.col("type") == "aggTrade").select("event_id", "asset", "t_us", "price")
    quotes = ticks.where(F.col("type") == "bookTicker").select("asset", "t_us", F.col("price").alias("mid"))
    return trades, quotes


@query
def asof_join(spark, sf_dir):
    """Each trade with the newest quote of its asset, at most an hour old."""
    trades, quotes = _asof_sides(spark, sf_dir)
    out = asof.asof_join(
        trades, quotes, ["asset"], "t_us", ["mid"], 3600 * 1_000_000, 6 * 3600 * 1_000_000
    )
    return out.select("event_id", "asset", F.col("_right_t").alias("quote_us"), F.round("mid", 6).alias("mid"))


@query
def asof_join_unbounded(spark, sf_dir):
    trades, quotes = _asof_sides(spark, sf_dir)
    out = asof.asof_join(trades, quotes, ["asset"], "t_us", ["mid"], None, 6 * 3600 * 1_000_000)
    return out.select("event_id", "asset", F.col("_right_t").alias("quote_us"), F.round("mid", 6).alias("mid"))


@query
def asof_scan(spark, sf_dir):
    """asof_join by ranges of rows instead of chunks of time."""
    trades, quotes = _asof_sides(spark, sf_dir)
    out = asof.asof_scan(trades, quotes, ["asset"], "t_us", ["mid"], 3600 * 1_000_000)
    return out.select("event_id", "asset", F.col("_right_t").alias("quote_us"), F.round("mid", 6).alias("mid"))


@query
def asof_scan_unbounded(spark, sf_dir):
    trades, quotes = _asof_sides(spark, sf_dir)
    out = asof.asof_scan(trades, quotes, ["asset"], "t_us", ["mid"])
    return out.select("event_id", "asset", F.col("_right_t").alias("quote_us"), F.round("mid", 6).alias("mid"))


@query
def asof_anchor_scan(spark, sf_dir):
    bars = materialize(_bars(spark, sf_dir))
    out = asof.asof_anchor_scan(bars, ["series"], "t", ["poly_p_up"], 5 * 3600)
    return out.select(
        "series", "t", "anchor_t", F.round("poly_p_up_anchor", 6).alias("poly_p_up_anchor")
    )


@query
def asof_anchor(spark, sf_dir):
    out = asof.asof_anchor(_bars(spark, sf_dir), ["series"], "t", ["poly_p_up"], 5 * 3600, 86_400)
    return out.select(
        "series", "t", "anchor_t", F.round("poly_p_up_anchor", 6).alias("poly_p_up_anchor")
    )


@query
def realized_label(spark, sf_dir):
    out = asof.realized_label(
        _bars(spark, sf_dir), ["series"], "t", "btc_mid", SLOW.minute, 5, SLOW.chunk
    )
    return out.select("series", "t", "origin_t", F.round("realized", 6).alias("realized"))


@query
def union_streams(spark, sf_dir):
    """Forecast points and stats as one stream; columns a side lacks are NULL."""
    left = _points(spark, sf_dir).select("asset", "sec", "btc_mid", "forecast")
    right = _ticks(spark, sf_dir).groupBy("asset", bucket("ts", 3600).alias("sec")).agg(
        F.count("*").alias("n")
    )
    return stats.union_streams(left, right).withColumns(r6("btc_mid", "forecast"))


@query
def baseline_comparison(spark, sf_dir):
    split = materialize(_split(spark, sf_dir))
    model = arma.walk_forward(split, _ar1(split), delay=5, chunk=200)
    return metrics.baseline_comparison(split, model, metrics.sigma_by_series(split)).withColumns(
        r6("rmse", "mae", "dir_acc")
    )


# --- stream-shaped operators in batch form --------------------------------------------


@query
def carry_forward(spark, sf_dir):
    return _filled(spark, sf_dir).withColumns(
        r6("btc_mid", "poly_prob", "log_return", "drift", "forecast", "sigma")
    )


@query
def minute_bars(spark, sf_dir):
    return _bars(spark, sf_dir).withColumns(r6("btc_mid", "poly_p_up"))


@query
def bar_features(spark, sf_dir):
    return features.bar_features(_bars(spark, sf_dir), SLOW).select(
        "series", "t", "contiguous", *[F.round(c, 6).alias(c) for c in ("x_prob", "x_change", "x_vol")]
    )


@query
def live_features(spark, sf_dir):
    points = materialize(_score_points(spark, sf_dir))
    out = features.live_features(points, features.minute_bars(points, SLOW), SIGMA, SLOW)
    return out.select(
        "series", "sec", "feature_mode", *[F.round(c, 6).alias(c) for c in ("x_prob", "x_change", "x_vol")]
    )


@query
def throttle(spark, sf_dir):
    rows = _ticks(spark, sf_dir).select("series", bucket("ts", 1).alias("sec"), "price")
    return features.throttle(rows.where(F.col("series").isNotNull()), ["series"], "sec", 3600).withColumns(
        r6("price")
    )


@query
def score_batch(spark, sf_dir):
    points = materialize(_score_points(spark, sf_dir))
    params = _ar1(materialize(_split(spark, sf_dir)))
    out = score.score_batch(points, features.minute_bars(points, SLOW), params, SLOW, chunk=200)
    return _score_columns(out)


def _score_columns(out):
    return out.withColumn("target_horizon_s", F.col("target_horizon_s").cast("bigint")).withColumns(
        r6(
            "sarimax_input_btc_mid", "sarimax_poly_prob", "log_return_pred", "sarimax_prob_up", "sigma_log"
        )
    ).withColumns({c: F.round(c, 3) for c in ("sarimax_forecast", "sarimax_drift")})


# --- modelling ------------------------------------------------------------------------


@query
def exog_gram(spark, sf_dir):
    out = arma.exog_gram(_split(spark, sf_dir))
    return out.select(
        "series", "n_train", F.posexplode("gram").alias("pos", "v")
    ).select("series", "n_train", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v"))


@query
def fit_arx(spark, sf_dir):
    """AR(1) errors for every series."""
    out = _ar1(materialize(_split(spark, sf_dir)))
    return out.select(
        "series", "status", "n_train",
        *[F.round(F.col("beta")[i], 6).alias(f"beta{i + 1}") for i in range(3)],
        F.round(F.col("phi")[0], 6).alias("phi1"),
        F.round("sigma_log", 6).alias("sigma_log"),
    )


def _train_errors(split):
    return arma.residuals(split.where(F.col("split") == "train"), arma.fit_exog(split).select("series", "beta"))


@query
def order_grid(spark, sf_dir):
    """Orders up to (1, 1), with a long autoregression of order 1; larger orders are tested in pytest."""
    grid = arma.order_grid(_train_errors(materialize(_split(spark, sf_dir))), 1, 1, chunk=200, long_ar=1)
    return grid.select("series", "p", "q", "n", F.round("aic", 4).alias("aic"), F.round("sigma2", 10).alias("sigma2"))


@query
def select_order(spark, sf_dir):
    split = materialize(_split(spark, sf_dir))
    grid = arma.order_grid(_train_errors(split), 1, 1, chunk=200, long_ar=1)
    return arma.fit_arx(split, chunk=200, grid=grid).select(
        "series", "status", "n_train", "p", "q", F.round("aic", 4).alias("aic")
    )


@query
def walk_forward(spark, sf_dir):
    """AR(1), parameters frozen, labels known five rows later."""
    split = materialize(_split(spark, sf_dir))
    out = arma.walk_forward(split, _ar1(split), delay=5, chunk=200)
    return out.withColumns(r10("y", "pred"))


@query
def in_sample_fit(spark, sf_dir):
    split = materialize(_split(spark, sf_dir))
    out = arma.walk_forward(split, _ar1(split), delay=0, chunk=200)
    return out.where(F.col("split") == "train").select(
        "series", "idx", F.round("pred", 10).alias("fitted")
    )


@query
def walk_forward_arma(spark, sf_dir):
    """ARMA(1, 1) errors with given φ and θ around the fitted regression."""
    split = materialize(_split(spark, sf_dir))
    given = _ar1(split).withColumns(
        {"q": F.lit(1), "phi": F.when(F.col("status") == "ok", F.array(F.lit(0.5))),
         "theta": F.when(F.col("status") == "ok", F.array(F.lit(0.3)))}
    )
    return arma.walk_forward(split, given, delay=0, chunk=200).withColumns(r10("y", "pred"))


@query
def walk_forward_refit(spark, sf_dir):
    """AR(1) errors, re-estimated at every holdout row."""
    split = materialize(_split(spark, sf_dir))
    return arma.walk_forward_refit(split, _ar1(split), delay=0, chunk=200).withColumns(r8("y", "pred"))


@query
def coef_table(spark, sf_dir):
    """AR(1): coefficients of the regression and of the error process."""
    split = materialize(_split(spark, sf_dir))
    return arma.coef_table(split, _ar1(split), chunk=200, orders=(1, 0)).withColumns(r6("coef", "std_err", "z"))


@query
def model_round_trip(spark, sf_dir):
    path = work_dir(spark, "model")
    models.save_model(_ar1(materialize(_split(spark, sf_dir))), path)
    return models.load_model(spark, path).select(
        "series", "status", "n_train", F.round(F.col("beta")[0], 6).alias("beta1"),
        F.round("sigma_log", 6).alias("sigma_log"), F.concat_ws(",", "exog").alias("exog"), "target",
    )


# --- documented but never built there -------------------------------------------------


def _probabilities(spark, sf_dir):
    split = materialize(_split(spark, sf_dir))
    params = _ar1(split)
    pred = arma.walk_forward(split, params, delay=5, chunk=200)
    rows = split.where(F.col("split") == "holdout").select("series", "idx", "poly_p_up", TARGET)
    scored = rows.join(pred.select("series", "idx", "pred"), ["series", "idx"]).join(
        params.select("series", "sigma_log"), "series"
    )
    return metrics.with_prob_up(scored)


@query
def calibration(spark, sf_dir):
    out = metrics.calibration(
        _probabilities(spark, sf_dir).withColumnRenamed("poly_p_up", "market_prob"),
        TARGET, ("model_prob", "market_prob"),
    )
    return out.withColumns(r6("mean_prob", "up_rate"))


@query
def edge_signal(spark, sf_dir):
    out = metrics.edge_signal(_probabilities(spark, sf_dir), "model_prob", "poly_p_up")
    return out.select(
        "series", "idx", F.round("model_prob", 6).alias("model_prob"), F.round("edge", 6).alias("edge"), "alert"
    )


def _trades(spark, sf_dir) -> DataFrame:
    return (
        _envelopes(spark, sf_dir)
        .where(F.col("type") == "aggTrade")
        .withColumn("t_us", F.unix_micros(F.col("recv_ts").cast("timestamp")))
    )


@query
def cumulative_volume_delta(spark, sf_dir):
    trades = _trades(spark, sf_dir)
    out = stats.cumulative_volume_delta(trades, "t_us", 86_400_000_000, order=("t_us", "event_id"))
    return out.select("event_id", "symbol", F.round("cvd", 4).alias("cvd"))


@query
def cumulative_volume_exact(spark, sf_dir):
    out = stats.cumulative_volume_exact(_trades(spark, sf_dir), ("t_us", "event_id"))
    return out.select("event_id", "symbol", F.col("cvd").cast("string").alias("cvd"))


@query
def number_rows(spark, sf_dir):
    """All ticks numbered in the order of time, without gaps."""
    ticks = _ticks(spark, sf_dir).select("event_id", F.unix_micros("ts").alias("t_us"))
    return ordered.number_rows(ticks, "t_us", "event_id")


# --- streams over the events table, drained and read back -----------------------------


def _stream_ticks(spark, sf_dir):
    messages = bind.bind_messages(bind.stream_events(spark, sf_dir))
    return normalize_ticks(envelope.parse_envelope(messages))


def _drained(spark, rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into a table and read that table."""
    base = work_dir(spark, name)
    sink = {"format": "parquet", "path": f"{base}/out"}
    pipeline.drain([pipeline.run_stream(rows, name, f"{base}/checkpoint", sink, trigger=pipeline.DRAIN)])
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query
def stream_windowed_stats(spark, sf_dir):
    """Windows the watermark (2 hours) has closed by the end of the input."""
    out = stats.windowed_stats(_stream_ticks(spark, sf_dir), "1 hour", "2 hours")
    return _drained(spark, out, "stats").withColumns(r6(*STAT_FLOATS))


@query
def stream_sliding_stats(spark, sf_dir):
    out = stats.sliding_stats(_stream_ticks(spark, sf_dir), "2 hours", "1 hour", "2 hours")
    return _drained(spark, out, "sliding").withColumns(r6(*STAT_FLOATS))


@query
def stream_forecast(spark, sf_dir):
    """Ten-minute forecast points of the closed windows, carried forward by keyed state."""
    base = work_dir(spark, "forecast")
    config = pipeline.PipelineConfig(
        output=base, checkpoint=f"{base}/checkpoint", forecast_grain="10 minutes", forecast_watermark="1 hour",
        sigma_log=SIGMA, prob_stale=PROB_STALE, spot_stale=SPOT_STALE,
    )
    ticks = _stream_ticks(spark, sf_dir)
    pipeline.drain([pipeline.sink_forecast_points(ticks, config, pipeline.DRAIN)])
    return _drained(spark, pipeline.live_forecast(spark, config), "carried").withColumns(
        r6("btc_mid", "poly_prob", "log_return", "drift", "forecast", "sigma")
    )


@query
def stream_ticks(spark, sf_dir):
    """Streaming archive sink, read back."""
    base = work_dir(spark, "archive")
    pipeline.drain(
        [
            pipeline.sink_ticks(
                _stream_ticks(spark, sf_dir), f"{base}/ticks", f"{base}/checkpoint", pipeline.DRAIN, 1
            )
        ]
    )
    return archive.read_ticks(spark, f"{base}/ticks").groupBy("source", "date").agg(
        F.count("*").alias("n"),
        F.countDistinct("hour").alias("hours"),
        F.round(F.max("price"), 6).alias("price_max"),
    )


@query
def score_stream(spark, sf_dir):
    """Forecast messages through the live scorer; the same result as the batch scorer."""
    base = work_dir(spark, "scoring")
    points = _filled(spark, sf_dir)
    forecasts.forecast_messages(points).write.json(f"{base}/forecast")
    params = _ar1(materialize(_split(spark, sf_dir)))
    messages = spark.readStream.schema("key STRING, value STRING").json(f"{base}/forecast")
    scored = state.score_stream(forecasts.read_forecast_points(messages), params, SLOW)
    return _score_columns(_drained(spark, scored, "score"))


def _point_stream(spark, sf_dir, base: str) -> DataFrame:
    """The points of the scorer as a stream over a table."""
    points = _score_points(spark, sf_dir)
    points.write.parquet(f"{base}/points")
    return spark.readStream.schema(points.schema).parquet(f"{base}/points")


@query
def stream_minute_bars(spark, sf_dir):
    """Bars that the watermark (1 hour) has closed, also of minutes after which no point came."""
    stream = _point_stream(spark, sf_dir, work_dir(spark, "bars"))
    return _drained(spark, timers.timed_bars(stream, SLOW), "bars").withColumns(r6("btc_mid", "poly_p_up"))


@query
def stream_throttle(spark, sf_dir):
    """One tick of a series per hour at most, as far as the watermark (1 hour) has come."""
    rows = _stream_ticks(spark, sf_dir).select("series", bucket("ts", 1).alias("sec"), "price")
    kept = timers.throttle_stream(rows.where(F.col("series").isNotNull()), ["series"], "sec", 3600)
    return _drained(spark, kept, "throttle").withColumns(r6("price"))


@query
def live_pipeline(spark, sf_dir):
    """All queries of the live pipeline side by side over the messages; rows per sink and key."""
    base = work_dir(spark, "live")
    config = pipeline.PipelineConfig(
        output=base, checkpoint=f"{base}/checkpoint", window="1 hour", watermark="2 hours", forecast_grain="10 minutes",
        forecast_watermark="1 hour", sigma_log=SIGMA, prob_stale=PROB_STALE, spot_stale=SPOT_STALE, salts=1,
        # the archive of one batch has a file per source and hour; all of them are one batch of the later queries
        files_per_trigger=1_000_000, trigger={"processingTime": "1 second"},
    )
    running = pipeline.run_pipeline(bind.bind_messages(bind.stream_events(spark, sf_dir)), config)
    try:
        for q in running:  # in the order of the hops
            q.processAllAvailable()
    finally:
        for q in running:
            q.stop()
    ticks = archive.read_ticks(spark, f"{base}/ticks").select(F.lit("ticks").alias("sink"), F.col("source").alias("key"))
    points = spark.read.schema(pipeline.POINTS_DDL).parquet(f"{base}/forecast_points")
    found = ticks.unionByName(points.select(F.lit("forecast_points").alias("sink"), F.col("asset").alias("key")))
    for sink, topic in (("stats", TOPIC_STATS), ("forecast", TOPIC_FORECAST)):
        messages = spark.read.schema("key STRING, value STRING").json(f"{base}/{topic}")
        found = found.unionByName(messages.select(F.lit(sink).alias("sink"), "key"))
    return found.groupBy("sink", "key").agg(F.count("*").alias("n"))


@query
def stream_state_eviction(spark, sf_dir):
    """Bars per series and day, and what each key still holds at the end: days gone by hold nothing."""
    base = work_dir(spark, "eviction")
    stream = _point_stream(spark, sf_dir, base).withColumn("day", F.floor(F.col("sec") / 86_400))
    bars = timers.timed_bars(stream, SLOW, ("series", "day"))
    sink = {"format": "parquet", "path": f"{base}/out"}
    pipeline.drain([pipeline.run_stream(bars, "eviction", f"{base}/checkpoint", sink, trigger=pipeline.DRAIN)])
    held = timers.open_state(spark, f"{base}/checkpoint/eviction").select(
        "key.series", "key.day", "open_minutes", F.col("passed").isNotNull().alias("carried")
    )
    closed = spark.read.schema(bars.schema).parquet(f"{base}/out").groupBy("series", "day").agg(F.count("*").alias("n_bars"))
    return closed.join(held, ["series", "day"], "full").fillna(0, ["n_bars", "open_minutes"]).fillna(False, ["carried"])


@query
def stream_stats_topic(spark, sf_dir):
    """Statistics through their JSON topic, read back and typed."""
    base = work_dir(spark, "topic")
    out = stats.windowed_stats(_stream_ticks(spark, sf_dir), "1 hour", "2 hours")
    sent = pipeline.stats_messages(out)
    pipeline.drain(
        [pipeline.sink_messages(sent, "stats", TOPIC_STATS, f"{base}/checkpoint", "files", base, pipeline.DRAIN)]
    )
    messages = spark.read.schema("key STRING, value STRING").json(f"{base}/{TOPIC_STATS}")
    typed = messages.select(F.from_json("value", out.schema.simpleString()).alias("s")).select("s.*")
    return typed.withColumns(r6(*STAT_FLOATS))


@query
def stream_ordered_output(spark, sf_dir):
    """Statistics published as one ordered partition: files written, rows, and whether all are in order."""
    base = work_dir(spark, "ordered")
    out = stats.windowed_stats(_stream_ticks(spark, sf_dir), "1 hour", "2 hours")
    sent = pipeline.stats_messages(out).withColumn("ts", F.get_json_object("value", "$.window_start"))
    pipeline.drain(
        [
            pipeline.sink_messages(
                sent, "ordered", TOPIC_STATS, f"{base}/checkpoint", "files", base, pipeline.DRAIN,
                order_by="ts", single_partition=True,
            )
        ]
    )
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{base}/{TOPIC_STATS}", lineSep="\n").where("value <> ''")
    start = F.get_json_object(F.get_json_object("value", "$.value"), "$.window_start")
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        start.alias("t"), F.monotonically_increasing_id().alias("line"),
    )
    return _files_in_order(rows)


def _files_in_order(rows: DataFrame) -> DataFrame:
    """Files, rows, and whether each file's (block, line) are in the order of t, NULL last; no task reads more than a block."""

    def follows(before: Column, t: Column) -> Column:
        return t.isNull() | F.coalesce(before <= t, F.lit(False))

    earlier = F.lag("t").over(Window.partitionBy("file", "block").orderBy("line"))
    first = F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) == 1
    blocks = rows.select("*", (first | follows(earlier, F.col("t"))).alias("ok")).groupBy("file", "block").agg(
        F.count("*").alias("n"), F.bool_and("ok").alias("ok"),
        F.min_by(F.struct("t"), "line").alias("first"), F.max_by(F.struct("t"), "line").alias("last"),
    )
    # one row per block of a file
    before = F.lag("last").over(Window.partitionBy("file").orderBy("block"))
    joined = before.isNull() | follows(F.col("before.t"), F.col("first.t"))
    files = blocks.select("*", before.alias("before")).select("*", joined.alias("joined"))
    return files.agg(
        F.countDistinct("file").alias("n_files"),
        F.sum("n").alias("n_rows"),
        F.bool_and(F.col("ok") & F.col("joined")).alias("in_order"),
    )


@query
def stream_numbered_output(spark, sf_dir):
    """Statistics published in a total order by several tasks: the number of each row."""
    base = work_dir(spark, "numbered")
    out = stats.windowed_stats(_stream_ticks(spark, sf_dir), "1 hour", "2 hours")
    sent = out.select(F.col("series").alias("key"), F.to_json(F.struct("*")).alias("value"), "window_start", *stats.STAT_KEYS)
    pipeline.drain(
        [
            pipeline.sink_numbered(
                sent, "numbered", TOPIC_STATS, f"{base}/checkpoint", base, ["window_start", *stats.STAT_KEYS], pipeline.DRAIN, 4
            )
        ]
    )
    rows = spark.read.schema("key string, value string, seq long").json(f"{base}/{TOPIC_STATS}")
    fields = ", ".join(f"{k} {out.schema[k].dataType.simpleString()}" for k in ("window_start", *stats.STAT_KEYS))
    return rows.select("seq", F.from_json("value", fields).alias("v")).select("seq", "v.*").withColumns(r6("price_bucket"))


def _parts(spark, sf_dir, cuts, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The events as a stream that grows by one cut after the other; `start` takes up each cut as one micro-batch."""
    base = make_dir(spark, work_dir(spark, "parts"))
    messages = bind.bind_messages(spark.readStream.schema(bind.EVENTS_DDL).parquet(base))
    ticks = normalize_ticks(envelope.parse_envelope(messages))
    for cut in cuts(_events(spark, sf_dir)):
        cut.write.mode("append").parquet(base)
        pipeline.drain([start(ticks)])


@query
def stream_late_rows(spark, sf_dir):
    """Rows that come again after the watermark has passed them count once."""

    def cuts(events):
        last = F.lit(events.agg(F.max("ts")).first()[0])
        newest = F.col("ts") >= last - F.expr("INTERVAL 6 HOURS")
        # lateness is judged by the watermark of the batch before
        return events.where(~newest), events.where(newest), events.where(F.col("ts") < last - F.expr("INTERVAL 24 HOURS"))

    base = work_dir(spark, "late")
    sink = {"format": "parquet", "path": f"{base}/out"}

    def start(ticks: DataFrame) -> StreamingQuery:
        out = stats.windowed_stats(ticks, "1 hour", "2 hours")
        return pipeline.run_stream(out, "late", f"{base}/checkpoint", sink, trigger=pipeline.DRAIN)

    _parts(spark, sf_dir, cuts, start)
    return spark.read.schema(STATS_DDL).parquet(f"{base}/out").withColumns(r6(*STAT_FLOATS))


@query
def stream_update_mode(spark, sf_dir):
    """Statistics in update mode over three micro-batches; the newest row of each window and key."""
    base = work_dir(spark, "update")

    def cuts(events):
        low, high = events.agg(F.min("ts"), F.max("ts")).first()
        step = (high - low) / 3
        edges = [low, low + step, low + 2 * step]
        return [
            events.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)) if b else F.col("ts") >= F.lit(a))
            for a, b in zip(edges, [*edges[1:], None])
        ]

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    def start(ticks: DataFrame) -> StreamingQuery:
        out = stats.windowed_stats(ticks, "1 hour", "2 hours")
        return pipeline.run_stream(out, "update", f"{base}/checkpoint", mode="update", trigger=pipeline.DRAIN, each_batch=land)

    _parts(spark, sf_dir, cuts, start)
    out = spark.createDataFrame([], STATS_DDL)
    rows = spark.read.schema(StructType([*out.schema.fields]).add("batch", IntegerType())).parquet(f"{base}/out")
    keys = [c for c in out.columns if not c.startswith("price_m") and c not in ("price_avg", "price_var", "n")]
    rest = [c for c in out.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
    return newest.select(*out.columns).withColumns(r6(*STAT_FLOATS))


SIGMAS = {"BTC": 0.0004, "ETH": 0.0007}


@query
def stream_forecast_sigmas(spark, sf_dir):
    """As stream_forecast, with a σ of its own for two of the three series."""
    base = work_dir(spark, "sigmas")
    sigmas = spark.createDataFrame(list(SIGMAS.items()), "series STRING, sigma_log DOUBLE")
    config = pipeline.PipelineConfig(
        output=base, checkpoint=f"{base}/checkpoint", forecast_grain="10 minutes", forecast_watermark="1 hour",
        sigma_log=SIGMA, sigmas=sigmas, prob_stale=PROB_STALE, spot_stale=SPOT_STALE,
    )
    pipeline.drain([pipeline.sink_forecast_points(_stream_ticks(spark, sf_dir), config, pipeline.DRAIN)])
    return _drained(spark, pipeline.live_forecast(spark, config), "carried").withColumns(
        r6("btc_mid", "poly_prob", "log_return", "drift", "forecast", "sigma")
    )

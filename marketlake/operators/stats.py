"""Windowed statistics, feed reports and dashboard reads.

Everything here is a partial + final aggregate (so a hot key is combined on the map
side first) or an ordered operation over time chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.pricing import bps, implied_forecast, probability_leg, spot_leg
from marketlake.functions.times import MICROS, bucket
from marketlake.operators.chunks import chunk_window, core_only, running_columns, with_halo
from marketlake.operators.ordered import running_exact
from marketlake.operators.quantiles import summary_with_percentiles
from marketlake.schemas import DEFAULT_SIGMA_LOG, STATS_DDL

STAT_KEYS = ("source", "ident", "asset", "series", "market_outcome", "price_bucket")


def windowed_stats(
    ticks: DataFrame,
    window: str = "1 minute",
    watermark: str | None = None,
    slide: str | None = None,
) -> DataFrame:
    """Min / max / mean / sample variance / count per window and tick label.

    Give a watermark for a stream. With `slide`, windows overlap.
    """
    rows = ticks.withWatermark("ts", watermark) if watermark else ticks
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        rows.groupBy(win, *STAT_KEYS)
        .agg(
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
            F.avg("price").alias("price_avg"),
            F.var_samp("price").alias("price_var"),
            F.count("*").alias("n"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *STAT_KEYS,
            "price_min",
            "price_max",
            "price_avg",
            "price_var",
            "n",
        )
    )


def sliding_stats(
    ticks: DataFrame,
    window: str = "5 minutes",
    slide: str = "1 minute",
    watermark: str | None = None,
) -> DataFrame:
    return windowed_stats(ticks, window, watermark, slide)


def forecast_stats(
    ticks: DataFrame,
    sigma_log: float | Column = DEFAULT_SIGMA_LOG,
    grain: str = "1 second",
    watermark: str | None = None,
    slug_suffix: str = "-updown-5m-",
) -> DataFrame:
    """Market-implied forecast per asset and second.

    Both legs are conditional averages of one group-by, so no stream-stream join is
    needed; a second with one leg only gives a row with NULLs.
    """
    spot, prob = spot_leg(), probability_leg(slug_suffix)
    rows = ticks.withWatermark("ts", watermark) if watermark else ticks
    sigma = sigma_log if isinstance(sigma_log, Column) else F.lit(float(sigma_log))
    return (
        rows.where(F.col("asset").isNotNull())
        .select(
            "ts",
            "asset",
            F.when(spot, F.col("price")).alias("_spot"),
            F.when(prob, F.col("price")).alias("_prob"),
        )
        .groupBy(F.window("ts", grain), "asset")
        .agg(F.avg("_spot").alias("btc_mid"), F.avg("_prob").alias("poly_prob"))
        .select(
            "asset",
            F.unix_timestamp("window.start").cast("double").alias("ts"),
            "btc_mid",
            "poly_prob",
            *[c.alias(n) for n, c in implied_forecast("btc_mid", "poly_prob", sigma).items()],
        )
        .select(
            "asset", "ts", "btc_mid", "poly_prob",
            "log_return", "drift", "forecast", "sigma", "sigma_log",
        )
    )


def event_mix(envelopes: DataFrame) -> DataFrame:
    """Message count and share per (source, type)."""
    counts = envelopes.groupBy(
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce("type", F.lit("?")).alias("type"),
    ).agg(F.count("*").alias("n"))
    # the window runs over one row per event type, not over messages
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", share)


def throughput_summary(envelopes: DataFrame, target: float = 4000.0) -> DataFrame:
    """Messages and mean rate per topic plus a TOTAL row with the verdict on the target."""
    per_group = envelopes.rollup("topic").agg(
        F.grouping("topic").alias("_total"),
        F.count("*").alias("n"),
        F.min("recv_ts").alias("_first"),
        F.max("recv_ts").alias("_last"),
    )
    # one row per topic from here on
    elapsed = F.max(F.col("_last") - F.col("_first")).over(Window.partitionBy())
    rate = F.try_divide(F.col("n").cast("double"), elapsed)
    return per_group.select(
        F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("topic")).alias("topic"),
        "n",
        rate.alias("avg_rate"),
        F.when(
            F.col("_total") == 1, F.when(rate >= target, "PASS").otherwise("BELOW TARGET")
        ).alias("verdict"),
    )


def rolling_rate(
    envelopes: DataFrame, window_s: float = 1.0, chunk_s: int = 60, keys: tuple[str, ...] = ("topic",)
) -> DataFrame:
    """At each distinct receive time, the messages of the last `window_s` seconds per key.

    Messages of one microsecond are pre-counted, so a chunk holds a bounded number of
    rows however busy the topic is.
    """
    keys = list(keys)
    span = int(window_s * MICROS)
    length = max(chunk_s * MICROS, span)
    micros = F.unix_micros(F.col("recv_ts").cast("timestamp"))
    counts = (
        envelopes.where(F.col("recv_ts").isNotNull())
        .groupBy(*keys, micros.alias("t_us"))
        .agg(F.count("*").alias("n"))
    )
    w = chunk_window(keys, "t_us").rangeBetween(-(span - 1), 0)
    return core_only(
        with_halo(counts, "t_us", length, before=span).withColumn("rate", F.sum("n").over(w))
    )


def message_rates(envelopes: DataFrame, interval_s: int = 60, window_s: float = 1.0) -> DataFrame:
    """Per topic and interval: count, interval rate, peak rolling rate and overall rate."""
    rolling = rolling_rate(envelopes, window_s)
    start = (F.floor(F.col("t_us") / (interval_s * MICROS)) * interval_s).cast("bigint")
    per_interval = rolling.groupBy("topic", start.alias("interval_start")).agg(
        F.sum("n").alias("n"),
        F.max("rate").alias("peak_rate"),
        F.min("t_us").alias("_first"),
        F.max("t_us").alias("_last"),
    )
    # one row per topic, joined back to its intervals
    elapsed = (F.max("_last") - F.min("_first")) / float(MICROS)
    whole = per_interval.groupBy(F.col("topic").alias("_topic")).agg(
        F.try_divide(F.sum("n").cast("double"), elapsed).alias("avg_rate")
    )
    return per_interval.join(whole, F.col("topic").eqNullSafe(F.col("_topic"))).select(
        "topic",
        "interval_start",
        "n",
        (F.col("n") / float(interval_s)).alias("interval_rate"),
        "peak_rate",
        "avg_rate",
    )


def latency_summary(rows: DataFrame, value: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, interpolated p50 / p95 / p99, max and throughput of microsecond latencies."""
    v = F.col(value) if isinstance(value, str) else value
    values = rows.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    fractions = {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}
    return summary_with_percentiles(values, by, "_v", fractions).select(
        *by,
        "n",
        F.col("mean").alias("mean_us"),
        *fractions,
        F.col("max").alias("max_us"),
        F.try_divide(F.lit(1e6), "mean").alias("throughput"),
    )


def feature_summary(
    table: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = (), in_bps: tuple[str, ...] = ()
) -> DataFrame:
    """Count, mean, std, min, quartiles and max of each column; `in_bps` columns scaled by 10⁴."""
    stacked = table.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        (bps(c) if c in in_bps else F.col(c)).cast("double").alias("v"),
                    )
                    for c in columns
                ]
            )
        ).alias("_e"),
    ).select(*by, "_e.feature", "_e.v")
    fractions = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return summary_with_percentiles(stacked, (*by, "feature"), "v", fractions)


def split_summary(split: DataFrame, target: str, by: tuple[str, ...] = ("series", "split")) -> DataFrame:
    """Mean and standard deviation of the target, in basis points, per part of the split."""
    return split.groupBy(*by).agg(
        F.count("*").alias("n"),
        bps(F.avg(target)).alias("mean_bps"),
        bps(F.stddev_samp(target)).alias("std_bps"),
    )


def coverage_report(
    ticks: DataFrame, grain: int = 1, slug_suffix: str = "-updown-5m-", training: DataFrame | None = None
) -> DataFrame:
    """Per asset: rows, time span and number of seconds with each leg; with the training table
    (one row per `series` and minute) also how many rows of it survived.

    Ticks are first reduced to one row per (asset, second), so counting distinct seconds
    needs no distinct aggregate over ticks.
    """
    spot, prob = spot_leg(), probability_leg(slug_suffix)
    seconds = ticks.groupBy("asset", bucket("ts", grain).alias("sec")).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(spot.cast("int")).alias("_spot"),
        F.max(prob.cast("int")).alias("_prob"),
    )
    report = seconds.groupBy("asset").agg(
        F.sum("n").alias("n_rows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum(F.coalesce("_spot", F.lit(0))).cast("bigint").alias("spot_seconds"),
        F.sum(F.coalesce("_prob", F.lit(0))).cast("bigint").alias("prob_seconds"),
    )
    if training is None:
        return report
    rows = training.groupBy(F.col("series").alias("_asset")).agg(F.count("*").alias("_n"))
    return report.join(rows, F.col("asset").eqNullSafe(F.col("_asset")), "left").select(
        *report.columns, F.coalesce("_n", F.lit(0)).alias("surviving_rows")
    )


def latest_values(rows: DataFrame, t: str, fields: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Last non-null value of each field, one hash aggregate."""
    when_set = lambda c: F.when(F.col(c).isNotNull(), F.col(t))
    return rows.groupBy(*by).agg(*[F.max_by(c, when_set(c)).alias(c) for c in fields])


def last_n(
    rows: DataFrame,
    t: Column,
    n: int = 7200,
    by: tuple[str, ...] = (),
    tiebreak: tuple[str, ...] = (),
    slot_s: int = 60,
) -> DataFrame:
    """The newest `n` rows per key (`t` in microseconds), marked `rn` = 1 for the newest.

    A count per time slot finds the slot each key's n-th newest row lies in; only rows
    from that slot on are ranked. The ranking therefore sorts about n rows per key rather
    than every row of a hot key.
    """
    by = list(by)
    slotted = rows.withColumn("_t", t).withColumn("_slot", F.floor(F.col("_t") / (slot_s * MICROS)))
    newer = (
        Window.partitionBy(*by).orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = (
        slotted.groupBy(*by, "_slot")
        .agg(F.count("*").alias("_n"))
        .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .where(F.col("_newer") < n)
        .select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_slot").alias("_s"))
    )
    # rows whose key is NULL form a group like any other
    same = F.col("_slot") == F.col("_s")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    rank = F.row_number().over(
        Window.partitionBy(*by).orderBy(F.col("_t").desc(), *[F.col(c).desc() for c in tiebreak])
    )
    return (
        slotted.join(needed, same, "left_semi")
        .withColumn("rn", rank)
        .where(F.col("rn") <= n)
        .drop("_t", "_slot")
    )


def latest_stats(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Stats messages (JSON text) as a typed table, newest window first."""
    table = (
        messages.select(F.from_json(F.col("value").cast("string"), STATS_DDL).alias("s"))
        .where(F.col("s.window_start").isNotNull())
        .select(
            "s.window_start", "s.series", "s.asset", "s.source", "s.market_outcome",
            "s.price_bucket", "s.price_min", "s.price_max", "s.price_avg", "s.price_var", "s.n",
        )
        .orderBy(F.col("window_start").desc())
    )
    return table if limit is None else table.limit(limit)


def union_streams(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a stream lacks become NULL."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def _signed_volume() -> Column:
    """Seller-initiated trades (buyer is maker) count negative."""
    qty = F.col("payload.q").try_cast("double")
    return F.when(F.col("payload.m"), -qty).otherwise(qty)


def cumulative_volume_delta(
    trades: DataFrame, t: str, length: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ()
) -> DataFrame:
    """Running signed volume."""
    return running_columns(trades, list(keys), t, length, {"cvd": _signed_volume()}, *(order or (t,)))


def cumulative_volume_exact(
    trades: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = ("symbol",), parts: int | None = None
) -> DataFrame:
    """Running signed volume as exact decimal sums over ranges of equally many trades.

    A symbol's trades of one day, or of one instant, spread over all tasks, and the result does not
    depend on where the ranges end. trades must be reproducible: a scan, or materialised.
    """
    return running_exact(trades, list(keys), {"cvd": _signed_volume()}, *order, parts=parts)

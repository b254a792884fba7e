"""Minute bars, bar features and live scoring features, plus stream-shaped batch helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.pricing import implied_forecast
from marketlake.functions.times import align_down
from marketlake.operators.asof import asof_join
from marketlake.operators.chunks import chunk_window, core_only, row_index, with_halo
from marketlake.operators.resample import Grains, ffill_bounded
from marketlake.schemas import DEFAULT_SIGMA_LOG

# Bars a live scorer keeps, and the consecutive bars an exact feature vector needs.
KEPT_BARS = 12
EXACT_BARS = 10


def carry_forward(
    points: DataFrame,
    sigma_log: float | Column = DEFAULT_SIGMA_LOG,
    prob_stale: int = 1800,
    spot_stale: int | None = None,
    chunk: int = 21_600,
    keys: tuple[str, ...] = ("asset",),
    t: str = "sec",
) -> DataFrame:
    """Fill forecast points from earlier ones until they go stale, then recompute the forecast.

    Staleness is measured from the last observed value; the spot limit is at most 30 s
    unless given. Only earlier values fill, whatever the arrival order.
    """
    spot_stale = min(prob_stale, 30) if spot_stale is None else spot_stale
    sigma = sigma_log if isinstance(sigma_log, Column) else F.lit(float(sigma_log))
    filled = ffill_bounded(
        points.select(*keys, t, "btc_mid", "poly_prob"),
        list(keys),
        t,
        {"btc_mid": spot_stale, "poly_prob": prob_stale},
        chunk,
    )
    derived = implied_forecast("btc_mid", "poly_prob", sigma)
    return filled.select(
        *keys, t, "btc_mid", "poly_prob", *[derived[n].alias(n) for n in
        ("log_return", "drift", "forecast", "sigma", "sigma_log")],
    )


def throttle(rows: DataFrame, keys: list[str], t: str, interval: int = 1, chunk: int = 86_400) -> DataFrame:
    """Rows whose time lies at least `interval` seconds after the last one kept, per key.

    Times are whole seconds; of several rows in one second the first in column order counts.
    Whether a row is kept depends on all before it, but what a chunk of time does to that chain
    depends only on where the chain enters it. So each chunk is reduced to a table from each
    possible first row to the last one kept, these tables (at most `interval` + 1 entries) are
    followed in order, and each chunk is then walked from its true first row.
    """
    columns = [c for c in rows.columns if c not in keys and c != t]
    of_second = (
        rows.groupBy(*keys, t)
        .agg(F.min(F.struct(*columns)).alias("_f"))
        .select(*keys, t, *[F.col(f"_f.{c}").alias(c) for c in columns])
    )
    if interval <= 1:
        return of_second
    length = max(chunk, interval)
    # one text for the whole key: NULLs are values like others
    keyed = of_second.withColumn("_k", F.to_json(F.struct(*keys))).withColumn("_t", F.col(t).cast("long"))
    times = keyed.select("_k", "_t", F.floor(F.col("_t") / length).alias("_c"))
    return keyed.join(_kept_times(times, interval, length), ["_k", "_t"], "left_semi").drop("_k", "_t")


def _kept_times(times: DataFrame, interval: int, length: int) -> DataFrame:
    """(_k, _t) of the rows that `throttle` keeps, from distinct (_k, _t) with their chunk _c."""

    def follow(t: np.ndarray) -> np.ndarray:
        """Position of the next row kept after each one."""
        return np.searchsorted(t, t + interval)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        step = follow(t)
        last = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if step[i] < len(t):
                last[i] = last[step[i]]
        # the chain enters among the rows of the first interval, or at the first one after it
        n = int(np.searchsorted(t, pdf["_c"].iloc[0] * length + interval)) + 1
        return pdf.iloc[:1][["_k", "_c"]].assign(starts=[t[:n]], ends=[last[:n]])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        last, out = None, []
        for starts, ends in zip(pdf["starts"], pdf["ends"]):
            i = 0 if last is None else int(np.searchsorted(starts, last + interval))
            out.append(int(starts[i]) if i < len(starts) else None)
            last = int(ends[i]) if i < len(starts) else last
        return pdf[["_k", "_c"]].assign(_first=pd.array(out, dtype="Int64"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        step, kept = follow(t), []
        i = int(np.searchsorted(t, pdf["_first"].iloc[0]))
        while i < len(t):
            kept.append(t[i])
            i = step[i]
        return pd.DataFrame({"_k": pdf["_k"].iloc[0], "_t": kept})

    tables = times.groupBy("_k", "_c").applyInPandas(reduce, "_k string, _c long, starts array<long>, ends array<long>")
    # a row per key and chunk from here on
    entries = tables.groupBy("_k").applyInPandas(enter, "_k string, _c long, _first long").where("_first IS NOT NULL")
    return times.join(entries, ["_k", "_c"]).groupBy("_k", "_c").applyInPandas(walk, "_k string, _t long")


def minute_bars(
    points: DataFrame, grains: Grains = Grains(), keys: tuple[str, ...] = ("series",), opened: bool = True
) -> DataFrame:
    """Bars at minute boundaries, closed by the first point of the new minute.

    A boundary gets a bar only if both values are fresh there (at most `spot_stale` / `prob_stale`
    old) and, if `opened`, some point lies in the minute it opens. Each point is offered to the
    boundaries it can serve, so this is one aggregate with no join.
    """
    step = grains.minute
    own = align_down("sec", step)
    # a minute's newest point serves every later boundary, so reduce to it before fanning out
    on_time = F.col("sec") == own
    newest = lambda c, cond=F.lit(True): F.max_by(
        c, F.when(F.col(c).isNotNull() & cond, F.col("sec"))
    )
    stamp = lambda c, cond=F.lit(True): F.max(F.when(F.col(c).isNotNull() & cond, F.col("sec")))
    per_minute = points.groupBy(*keys, own.alias("m")).agg(
        newest("btc_mid").alias("mid"),
        stamp("btc_mid").alias("mid_sec"),
        newest("poly_p_up").alias("prob"),
        stamp("poly_p_up").alias("prob_sec"),
        newest("btc_mid", on_time).alias("mid_at"),
        newest("poly_p_up", on_time).alias("prob_at"),
    )
    last = align_down(
        F.greatest(
            F.col("m"),
            F.col("mid_sec") + grains.spot_stale,
            F.col("prob_sec") + grains.prob_stale,
        ),
        step,
    )
    offers = per_minute.withColumn(
        "t", F.explode(F.sequence("m", last, F.lit(step).cast("bigint")))
    )
    opens = F.col("t") == F.col("m")
    mid = F.when(opens, F.col("mid_at")).otherwise(F.col("mid"))
    mid_sec = F.when(opens, F.when(F.col("mid_at").isNotNull(), F.col("m"))).otherwise(F.col("mid_sec"))
    prob = F.when(opens, F.col("prob_at")).otherwise(F.col("prob"))
    prob_sec = F.when(opens, F.when(F.col("prob_at").isNotNull(), F.col("m"))).otherwise(F.col("prob_sec"))
    fresh_mid = F.when(F.col("t") - mid_sec <= grains.spot_stale, mid_sec)
    fresh_prob = F.when(F.col("t") - prob_sec <= grains.prob_stale, prob_sec)
    return (
        offers.groupBy(*keys, "t")
        .agg(
            F.max_by(mid, fresh_mid).alias("btc_mid"),
            F.max_by(prob, fresh_prob).alias("poly_p_up"),
            F.max(opens.cast("int")).alias("_opened"),
        )
        .where(((F.col("_opened") == 1) | F.lit(not opened)) & F.col("btc_mid").isNotNull() & F.col("poly_p_up").isNotNull())
        .drop("_opened")
    )


def bar_features(bars: DataFrame, grains: Grains = Grains(), keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Exact features of each bar from its last ten bars, NULL unless they are consecutive.

    p_up, its change over five bars, and the sample deviation of five 5-bar returns; an
    unusable price gives return 0 here, not NULL.
    """
    step, steps = grains.minute, grains.steps
    span = (EXACT_BARS - 1) * step
    rows = with_halo(bars, "t", max(grains.chunk, span + step), before=span)
    w = chunk_window(list(keys), "t")
    at = lambda c, offset: F.first(c).over(w.rangeBetween(offset, offset))
    contiguous = F.count("*").over(w.rangeBetween(-span, 0)) == EXACT_BARS
    rows = (
        rows.withColumn("contiguous", contiguous)
        .withColumn("_back", at("btc_mid", -steps * step))
        .withColumn("_prob_back", at("poly_p_up", -steps * step))
    )
    usable = (F.col("_back") > 0) & (F.col("btc_mid") > 0)
    rows = rows.withColumn(
        "_ret", F.when(usable, F.log(F.col("btc_mid") / F.col("_back"))).otherwise(0.0)
    ).withColumn("_vol", F.stddev_samp("_ret").over(w.rangeBetween(-(steps - 1) * step, 0)))
    ok = F.col("contiguous")
    return core_only(rows).select(
        *keys,
        "t",
        "btc_mid",
        "poly_p_up",
        "contiguous",
        F.when(ok, F.col("poly_p_up")).alias("x_prob"),
        F.when(ok, F.col("poly_p_up") - F.col("_prob_back")).alias("x_change"),
        F.when(ok, F.col("_vol")).alias("x_vol"),
    )


def _with_history(bars: DataFrame, keys: list[str], grains: Grains) -> DataFrame:
    """Each bar with its up to twelve newest bars (itself included), oldest first."""
    indexed = row_index(bars, keys, "t", grains.chunk)
    rows = with_halo(indexed, "idx", max(grains.chunk_rows, KEPT_BARS), before=KEPT_BARS - 1)
    w = chunk_window(keys, "idx").rowsBetween(-(KEPT_BARS - 1), 0)
    entry = F.struct("t", "btc_mid", "poly_p_up")
    return core_only(rows.withColumn("hist", F.collect_list(entry).over(w))).drop("idx")


def live_features(
    points: DataFrame,
    bars: DataFrame,
    sigma_log: Column | float = DEFAULT_SIGMA_LOG,
    grains: Grains = Grains(),
    strict: bool = False,
    keys: tuple[str, ...] = ("series",),
) -> DataFrame:
    """Feature vector for each scoring point, as a live scorer would have it then.

    `exact` once the ten newest closed bars are consecutive (features of the newest bar),
    else `warm`: change against the newest kept bar at least five minutes old (or the oldest
    kept one), and the deviation of recent one-bar returns scaled to five bars, with
    `sigma_log` as prior. With `strict`, only exact rows are kept.
    """
    keys = list(keys)
    sigma = sigma_log if isinstance(sigma_log, Column) else F.lit(float(sigma_log))
    history = _with_history(bar_features(bars, grains, tuple(keys)), keys, grains)
    seen = asof_join(
        points.withColumn("_at", F.col("sec")),
        history.withColumnRenamed("t", "_at"),
        keys,
        "_at",
        ["x_prob", "x_change", "x_vol", "contiguous", "hist"],
        None,
        grains.chunk,
    )
    exact = F.coalesce(F.col("contiguous"), F.lit(False))
    if strict:
        seen = seen.where(exact)
    now = F.struct(F.col("sec").alias("t"), "btc_mid", "poly_p_up")
    hist = F.coalesce("hist", F.array().cast("array<struct<t:bigint,btc_mid:double,poly_p_up:double>>"))
    ends_now = F.coalesce(F.get(hist, F.size(hist) - 1)["t"] == F.col("sec"), F.lit(False))
    seen = seen.withColumn("_l", F.when(ends_now, hist).otherwise(F.array_append(hist, now)))
    five_ago = F.filter("_l", lambda b: b["t"] <= F.col("sec") - grains.steps * grains.minute)
    anchor = F.coalesce(
        F.get(five_ago, F.size(five_ago) - 1)["poly_p_up"], F.get("_l", F.lit(0))["poly_p_up"]
    )
    pairs = F.zip_with(
        F.slice("_l", 1, F.size("_l") - 1),
        F.slice("_l", 2, F.size("_l")),
        lambda a, b: F.when(
            (a["btc_mid"] > 0) & (b["btc_mid"] > 0), F.log(b["btc_mid"] / a["btc_mid"])
        ),
    )
    seen = seen.withColumn("_rets", F.filter(pairs, lambda r: r.isNotNull())).withColumn(
        "_recent",
        F.when(F.size("_rets") > 5, F.slice("_rets", -5, 5)).otherwise(F.col("_rets")),
    )
    n = F.size("_recent")
    mean = F.aggregate("_recent", F.lit(0.0), lambda acc, r: acc + r) / n
    squares = F.aggregate(
        F.transform("_recent", lambda r: (r - F.col("_mean")) * (r - F.col("_mean"))),
        F.lit(0.0),
        lambda acc, r: acc + r,
    )
    seen = seen.withColumn("_mean", F.when(n >= 2, mean))
    warm_vol = F.when(
        n >= 2,
        F.greatest(F.sqrt(squares / (n - 1)) * F.sqrt(F.lit(5.0)), sigma * 0.25),
    ).otherwise(sigma)
    return seen.select(
        *points.columns,
        F.when(exact, "exact").otherwise("warm").alias("feature_mode"),
        F.when(exact, F.col("x_prob")).otherwise(F.col("poly_p_up")).alias("x_prob"),
        F.when(exact, F.col("x_change")).otherwise(F.col("poly_p_up") - anchor).alias("x_change"),
        F.when(exact, F.col("x_vol")).otherwise(warm_vol).alias("x_vol"),
    )


def gap_check(bars: DataFrame, grains: Grains = Grains(), keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Per bar: seconds since the previous bar and whether its last ten bars are consecutive."""
    keys = list(keys)
    indexed = row_index(bars, keys, "t", grains.chunk)
    rows = with_halo(indexed, "idx", max(grains.chunk_rows, EXACT_BARS), before=EXACT_BARS - 1)
    w = chunk_window(keys, "idx")
    span = F.col("t") - F.lag("t", EXACT_BARS - 1).over(w)
    return core_only(
        rows.withColumn("gap_s", F.col("t") - F.lag("t", 1).over(w)).withColumn(
            "contiguous", F.coalesce(span == (EXACT_BARS - 1) * grains.minute, F.lit(False))
        )
    ).drop("idx")

"""Keyed state for streams: carry-forward and live scoring.

State lives in the query's checkpoint, one small row per series, so a restart resumes where
the stream stopped. A micro-batch is worked on as arrays: the rows kept from earlier batches
are put in front of it in time order, and fills, as-of look-ups, returns and label origins are
searches in sorted arrays. What the next batch needs of the result is kept.

The source bounds a micro-batch (files or offsets per trigger, see `tick_source` and
`live_forecast`), and with it the rows of one series that are in memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlake.functions.pricing import implied_forecast
from marketlake.operators.arma import _recursion, forecast_weights, longest
from marketlake.operators.features import EXACT_BARS, KEPT_BARS
from marketlake.operators.resample import Grains
from marketlake.operators.score import score_rows
from marketlake.schemas import DEFAULT_SIGMA_LOG

DAY_MS = 86_400_000
# Rows this much older than the newest are dropped, as a live scorer ignores older minutes.
# Spark reports their number as numRowsDroppedByWatermark of the query's progress.
LATENESS = "1 hour"


def on_event_time(points: DataFrame, seconds: str, lateness: str) -> DataFrame:
    """State is evicted by event time: a processing-time timeout would keep a draining query alive."""
    return points.withColumn("event_time", F.col(seconds).cast("timestamp")).withWatermark(
        "event_time", lateness
    )


def _expire_after(state: GroupState, newest_s: float, idle_ms: int) -> None:
    state.setTimeoutTimestamp(max(int(newest_s * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))


def with_sigma(points: DataFrame, sigmas: DataFrame | None, key: str, default: float) -> DataFrame:
    """Add sigma_log from a table (key, sigma_log); series it lacks get the default."""
    if sigmas is None:
        return points.withColumn("sigma_log", F.lit(float(default)))
    known = sigmas.select(F.col(sigmas.columns[0]).alias(key), F.col("sigma_log").alias("_sigma"))
    return (
        points.join(known, key, "left")
        .withColumn("sigma_log", F.coalesce("_sigma", F.lit(float(default))))
        .drop("_sigma")
    )


def latest_known(t: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a time-ordered leg, the last finite value at or before it and its time."""
    at = np.maximum.accumulate(np.where(np.isfinite(value), np.arange(len(value)), -1))
    none = at < 0
    return np.where(none, np.nan, value[at]), np.where(none, -np.inf, t[at])


def carry_forward_stream(
    points: DataFrame,
    sigma_log: float = DEFAULT_SIGMA_LOG,
    prob_stale: int = 1800,
    spot_stale: int | None = None,
    idle_ms: int = DAY_MS,
    lateness: str = LATENESS,
    sigmas: DataFrame | None = None,
) -> DataFrame:
    """Streaming form of `carry_forward` over (asset, ts, btc_mid, poly_prob).

    The state is the newest observed value of each leg with its time; a series whose
    newest message lies `idle_ms` behind the stream is forgotten. σ comes from `sigmas`
    (series, sigma_log) and is `sigma_log` for series it lacks.
    """
    limits = {"btc_mid": min(prob_stale, 30) if spot_stale is None else spot_stale, "poly_prob": prob_stale}

    def fill(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get) if state.exists else [None] * 4
        new = pd.concat(list(batches))[["ts", "btc_mid", "poly_prob", "sigma_log"]]
        seeds = pd.DataFrame(
            {
                "ts": kept[1::2],
                "btc_mid": [kept[0], None],
                "poly_prob": [None, kept[2]],
                "sigma_log": None,
            },
            dtype=float,
        ).dropna(subset=["ts"])
        rows = pd.concat([seeds.assign(own=False), new.assign(own=True)]).sort_values("ts", kind="stable")
        t = rows["ts"].to_numpy(float)
        out, kept = rows[["ts", "sigma_log"]].copy(), []
        for leg, limit in limits.items():
            value, since = latest_known(t, rows[leg].to_numpy(float))
            out[leg] = np.where(t - since <= limit, value, np.nan)
            kept += [float(value[-1]), float(since[-1])] if np.isfinite(value[-1]) else [None, None]
        state.update(tuple(kept))
        _expire_after(state, float(t[-1]), idle_ms)
        out = out[rows["own"].to_numpy(bool)]
        legs = {leg: out[leg].astype(object).where(out[leg].notna(), None) for leg in limits}
        yield pd.DataFrame(
            {"asset": key[0], "sec": out["ts"].astype("int64"), **legs, "sigma_log": out["sigma_log"]}
        )

    rows = points.select("asset", "ts", "btc_mid", "poly_prob")
    filled = (
        on_event_time(with_sigma(rows, sigmas, "asset", sigma_log), "ts", lateness)
        .groupBy("asset")
        .applyInPandasWithState(
            fill,
            "asset string, sec bigint, btc_mid double, poly_prob double, sigma_log double",
            "mid double, mid_ts double, prob double, prob_ts double",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    derived = implied_forecast("btc_mid", "poly_prob", F.col("sigma_log"))
    return filled.select(
        "asset", "sec", "btc_mid", "poly_prob",
        *[derived[n].alias(n) for n in ("log_return", "drift", "forecast", "sigma", "sigma_log")],
    )


SCORE_STATE_DDL = (
    "secs array<bigint>, mids array<double>, probs array<double>, last_minute bigint, "
    "bar_t array<bigint>, bar_mid array<double>, bar_prob array<double>, "
    "u array<double>, e array<double>, last_emit bigint"
)
FEATURES_DDL = (
    "series string, sec bigint, btc_mid double, poly_p_up double, feature_mode string, "
    "x_prob double, x_change double, x_vol double, ahead double"
)


def _log_ratio(new: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(new / old) and where both prices are usable; 0 elsewhere."""
    with np.errstate(invalid="ignore"):
        usable = (new > 0) & (old > 0)
    return np.log(np.where(usable, new, 1.0) / np.where(usable, old, 1.0)), usable


def feature_vectors(
    bars: np.ndarray, known: np.ndarray, now: np.ndarray, sigma: float, g: Grains, strict: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each vector is exact, whether there is one, and the vectors (p_up, change, volatility).

    bars: rows (t, mid, prob) in time order; known: how many of them each point may use, of
    which the newest KEPT_BARS count; now: rows (t, mid, prob) of the points.
    """
    n, m = len(now), KEPT_BARS
    padded = np.vstack([np.full((m, 3), np.nan), bars.reshape(-1, 3)])
    # per point its newest bars, oldest first; NaN where there are fewer
    t, mid, prob = np.moveaxis(padded[known[:, None] + np.arange(m)], 2, 0)

    exact = t[:, -1] - t[:, -EXACT_BARS] == (EXACT_BARS - 1) * g.minute
    returns, _ = _log_ratio(mid[:, -g.steps :], mid[:, -2 * g.steps : -g.steps])
    x = np.column_stack([prob[:, -1], prob[:, -1] - prob[:, -1 - g.steps], returns.std(axis=1, ddof=1)])
    if strict:
        return exact, exact, x

    # path to the current point: the bars, then the point itself unless it is the newest bar
    at_bar = t[:, -1] == now[:, 0]
    steps, usable = _log_ratio(
        np.column_stack([mid[:, 1:], np.where(at_bar, np.nan, now[:, 1])]), mid
    )
    # the newest five usable one-step returns
    usable &= np.cumsum(usable[:, ::-1], axis=1)[:, ::-1] <= 5
    count = usable.sum(axis=1)
    mean = np.where(usable, steps, 0.0).sum(axis=1) / np.maximum(count, 1)
    var = np.where(usable, (steps - mean[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(count - 1, 1)
    vol = np.where(count >= 2, np.maximum(np.sqrt(var * 5.0), sigma * 0.25), sigma)
    # the newest bar old enough, else the oldest there is, else the point itself
    old = t <= now[:, :1] - g.steps * g.minute
    anchor = np.where(old.any(axis=1), m - 1 - np.argmax(old[:, ::-1], axis=1), m - np.minimum(known, m))
    first = np.column_stack([prob, now[:, 2]])[np.arange(n), np.minimum(anchor, m)]
    warm = np.column_stack([now[:, 2], now[:, 2] - first, vol])
    return exact, np.ones(n, bool), np.where(exact[:, None], x, warm)


def spaced(t: np.ndarray, last: int, interval: int) -> np.ndarray:
    """Positions in sorted t at least `interval` after `last` and after each other."""
    chosen, i = [], int(np.searchsorted(t, last + interval))
    while i < len(t):
        chosen.append(i)
        i = int(np.searchsorted(t, t[i] + interval))
    return np.array(chosen, int)


def score_stream(
    points: DataFrame,
    params: DataFrame,
    grains: Grains = Grains(),
    strict: bool = False,
    emit_interval: int = 1,
    idle_ms: int = DAY_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Live scoring of (series, sec, btc_mid, poly_p_up) with fitted parameters.

    Per series the state holds recent points, enough bars to restate the features of any bar
    whose label is still to come, and the newest u and e values of the error process. A label
    enters once its bar lies `horizon` bars back, and forecasts reach from that last known
    label to the current bar. Emission is throttled and monotone in time.
    """
    g, horizon = grains, grains.horizon
    lag = max(*longest(params), 1)
    usable = params.where(F.col("status") == "ok").select(
        "series", "beta", "phi", "theta", "sigma_log",
        forecast_weights(horizon, lag)("phi", "theta").alias("w"),
    )
    keep_s = 2 * max(g.spot_stale, g.prob_stale)
    keep_bars = KEPT_BARS + horizon + 1

    def score(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            secs, mids, probs, last_minute, bar_t, bar_mid, bar_prob, u, e, last_emit = state.get
        else:
            secs, mids, probs, bar_t, bar_mid, bar_prob = [[]] * 6
            u, e, last_minute, last_emit = [0.0] * lag, [0.0] * lag, -1, -(2**60)
        new = pd.concat(list(batches)).sort_values("sec", kind="stable")
        first = new.iloc[0]
        beta, weights, sigma = np.array(first["beta"]), np.array(first["w"]), float(first["sigma_log"])
        phi, theta = np.array(first["phi"], float), np.array(first["theta"], float)
        now = new[["sec", "btc_mid", "poly_p_up"]].to_numpy(float)
        # one point per second, the last that arrived
        seen = np.vstack([np.column_stack([secs, mids, probs]).reshape(-1, 3), now])
        seen = seen[np.argsort(seen[:, 0], kind="stable")]
        seen = seen[np.append(seen[1:, 0] != seen[:-1, 0], True)]

        # bars close at the minutes that these points open, from the newest point before
        opened = np.unique(now[:, 0] // g.minute)
        close = opened[opened > last_minute] * g.minute
        source = np.searchsorted(seen[:, 0], close, "right") - 1
        fresh = (source >= 0) & (close - seen[source, 0] <= min(g.spot_stale, g.prob_stale))
        old_bars = np.column_stack([bar_t, bar_mid, bar_prob]).reshape(-1, 3)
        bars = np.vstack([old_bars, np.column_stack([close, seen[source, 1:]])[fresh]])

        # labels of the new bars: return since the bar `horizon` bars and minutes back
        end = np.arange(len(old_bars), len(bars))
        end = end[end >= horizon]
        end = end[bars[end, 0] - bars[end - horizon, 0] == horizon * g.minute]
        origin = bars[end - horizon]
        _, there, x = feature_vectors(bars, end - horizon + 1, origin, sigma, g, strict)
        end, origin, x = end[there], origin[there], x[there]
        realized, _ = _log_ratio(bars[end, 1], origin[:, 1])
        errors = np.concatenate([np.array(u, float)[::-1], realized - x @ beta])
        v = errors[lag:].copy()
        for k, c in enumerate(phi):
            v -= c * errors[lag - 1 - k : len(errors) - 1 - k]
        shocks = np.concatenate([np.array(e, float)[::-1], _recursion(v, theta, np.array(e, float))])
        # forecast after no, one, two, ... of the new labels
        window = np.arange(len(end) + 1)[:, None] + np.arange(lag - 1, -1, -1)
        ahead = errors[window] @ weights[:lag] + shocks[window] @ weights[lag:]

        minute = now[:, 0] // g.minute * g.minute
        known = np.searchsorted(bars[:, 0], np.maximum(minute, last_minute * g.minute), "right")
        exact, there, x = feature_vectors(bars, known, now, sigma, g, strict)
        of_label = np.searchsorted(bars[end, 0], np.maximum(minute, last_minute * g.minute), "right")
        able = np.flatnonzero(there)
        emit = able[spaced(now[able, 0], last_emit, max(emit_interval, 1))]

        last_emit = int(now[emit[-1], 0]) if len(emit) else last_emit
        last_minute = int(max(last_minute, opened[-1]))
        seen = seen[seen[:, 0] >= now[-1, 0] - keep_s]
        bars = bars[-keep_bars:]
        state.update(
            (
                seen[:, 0].astype(int).tolist(), seen[:, 1].tolist(), seen[:, 2].tolist(), last_minute,
                bars[:, 0].astype(int).tolist(), bars[:, 1].tolist(), bars[:, 2].tolist(),
                errors[::-1][:lag].tolist(), shocks[::-1][:lag].tolist(), last_emit,
            )
        )
        _expire_after(state, float(now[-1, 0]), idle_ms)
        yield pd.DataFrame(
            {
                "series": key[0],
                "sec": now[emit, 0].astype(int),
                "btc_mid": now[emit, 1],
                "poly_p_up": now[emit, 2],
                "feature_mode": np.where(exact[emit], "exact", "warm"),
                "x_prob": x[emit, 0],
                "x_change": x[emit, 1],
                "x_vol": x[emit, 2],
                "ahead": ahead[of_label[emit]],
            }
        )

    vectors = (
        on_event_time(points, "sec", lateness)
        .join(usable, "series")
        .groupBy("series")
        .applyInPandasWithState(
            score, FEATURES_DDL, SCORE_STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return score_rows(
        vectors.join(usable.select("series", "beta", "sigma_log"), "series"), grains
    )

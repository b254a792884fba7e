"""Column expressions for prices, labels and forecast arithmetic.

All of these are built-in expressions, so they stay inside whole-stage codegen.
Text prices go through try_cast: under ANSI mode one bad quote must not fail a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlake.schemas import PREDICTION_SOURCE, SPOT_SOURCE, UP_OUTCOMES

BPS = 10_000.0

# Abramowitz & Stegun 7.1.26, |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Display bands of the probability and drift panels.
PROBABILITY_BANDS = ((0.4, "red"), (0.5, "orange"), (0.6, "gray"), (0.7, "blue"), (None, "green"))
DRIFT_BANDS = ((-5.0, "red"), (5.0, "gray"), (None, "green"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text to double; NULL when it is not a number."""
    return _col(c).try_cast("double")


def finite(c: Column | str) -> Column:
    """The value, or NULL for NaN and infinities."""
    c = _col(c)
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (c != inf) & (c != -inf), c)


def event_price(kind: Column | str, payload: str = "payload") -> Column:
    """Usable price of an event, by event type; NULL when it carries none."""
    kind = _col(kind)
    return (
        F.when(kind == "aggTrade", number(f"{payload}.p"))
        .when(kind == "bookTicker", (number(f"{payload}.b") + number(f"{payload}.a")) / 2)
        .when(kind.isin("price_change", "last_trade_price"), number(f"{payload}.price"))
        .when(kind == "book", number(f"{payload}.last_trade_price"))
    )


def price_bucket(
    source: Column | str, price: Column | str, spot_width: float = 100.0, prob_steps: float = 10.0
) -> Column:
    """Price range label: spot in steps of `spot_width`, probability in 1/`prob_steps`."""
    source, price = _col(source), _col(price)
    return F.when(
        source == SPOT_SOURCE, F.floor(price / spot_width).cast("double") * spot_width
    ).when(source == PREDICTION_SOURCE, F.floor(price * prob_steps).cast("double") / prob_steps)


def asset_label(source: Column | str, symbol: Column | str, slug: Column | str) -> Column:
    """Asset name: symbol without its quote currency, or the first word of the slug."""
    return F.when(
        _col(source) == SPOT_SOURCE, F.upper(F.regexp_replace(_col(symbol), "(?i)usdt$", ""))
    ).otherwise(F.upper(F.substring_index(_col(slug), "-", 1)))


def series_label(
    source: Column | str, ident: Column | str, asset: Column | str, outcome: Column | str
) -> Column:
    return F.when(_col(source) == SPOT_SOURCE, F.upper(_col(ident))).otherwise(
        F.concat(_col(asset), F.lit(" "), _col(outcome))
    )


def spot_leg() -> Column:
    """Ticks that carry an asset's spot mid price."""
    return (
        (F.col("source") == SPOT_SOURCE)
        & (F.col("type") == "bookTicker")
        & (F.col("ident") == F.concat(F.lower("asset"), F.lit("usdt")))
    )


def probability_leg(slug_suffix: str = "-updown-5m-") -> Column:
    """Ticks that carry the up-probability of an asset's rolling market."""
    return (
        (F.col("source") == PREDICTION_SOURCE)
        & F.startswith(F.col("market_slug"), F.concat(F.lower("asset"), F.lit(slug_suffix)))
        & F.col("market_outcome").isin(*UP_OUTCOMES)
    )


def implied_log_return(prob: Column | str, sigma_log: Column | str) -> Column:
    return (_col(prob) * 2 - 1) * _col(sigma_log)


def implied_forecast(
    mid: Column | str, prob: Column | str, sigma_log: Column | str
) -> dict[str, Column]:
    """Market-implied forecast columns from a mid price and an up-probability."""
    mid, sigma_log = _col(mid), _col(sigma_log)
    log_return = implied_log_return(prob, sigma_log)
    forecast = mid * F.exp(log_return)
    return {
        "log_return": log_return,
        "forecast": forecast,
        "drift": forecast - mid,
        "sigma": mid * sigma_log,
        "sigma_log": sigma_log,
    }


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def prob_up(log_return: Column | str, sigma_log: Column | str) -> Column:
    """P(return > 0) for a normal return with the given mean and deviation, in [0, 1]."""
    z = _col(log_return) / F.greatest(_col(sigma_log), F.lit(1e-12))
    p = 0.5 * (1.0 + erf(z / F.sqrt(F.lit(2.0))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def band(value: Column | str, bands: tuple[tuple[float | None, str], ...]) -> Column:
    """First band whose upper edge lies above the value; NULL stays NULL."""
    value = _col(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in bands:
        out = out.otherwise(F.lit(label)) if edge is None else out.when(value < edge, label)
    return out


def bps(c: Column | str) -> Column:
    return _col(c) * BPS

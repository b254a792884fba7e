"""Column expressions for event time, time buckets and rolling-market slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(ts: Column | str, grain: int) -> Column:
    """Start of the `grain`-second bucket of a timestamp, as whole unix seconds."""
    micros = F.unix_micros(_col(ts).cast("timestamp"))
    return (F.floor(micros / (grain * MICROS)) * grain).cast("bigint")


def align_down(seconds: Column | str, step: int) -> Column:
    return (F.floor(_col(seconds) / step) * step).cast("bigint")


def align_up(seconds: Column | str, step: int) -> Column:
    return (F.ceil(_col(seconds) / step) * step).cast("bigint")


def to_timestamp(seconds: Column | str) -> Column:
    return _col(seconds).cast("timestamp")


def iso_millis(ts: Column | str) -> Column:
    """ISO-8601 text with milliseconds and a Z suffix."""
    return F.date_format(_col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_seconds(raw: Column | str) -> Column:
    """Unix seconds from a numeric or ISO-8601 text; NULL when it is neither."""
    raw = F.trim(_col(raw))
    iso = F.unix_micros(F.try_to_timestamp(F.when(raw.contains("-") & raw.contains(":"), raw)))
    return F.coalesce(raw.try_cast("double"), iso / MICROS)


def slug_start(slug: Column | str) -> Column:
    """Window start written as the last part of a rolling slug; NULL if there is none."""
    return F.substring_index(_col(slug), "-", -1).try_cast("bigint")


def slug_end(slug: Column | str, window_min: int, now: Column | None = None) -> Column:
    """Window end; with `now`, slugs without a start fall back to now + one window."""
    end = slug_start(slug) + window_min * 60
    return end if now is None else F.coalesce(end.cast("double"), now + window_min * 60.0)


def rolling_slug(asset: Column | str, at: Column | str, window_min: int, offset: int = 0) -> Column:
    """Slug of the rolling market open at unix second `at`, `offset` windows later."""
    start = align_down(at, window_min * 60) + offset * window_min * 60
    return F.concat(
        F.lower(_col(asset)), F.lit(f"-updown-{window_min}m-"), start.cast("string")
    )

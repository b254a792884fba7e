"""Work that waits for the watermark: bars and throttled rows released by event-time timers.

`minute_bars` waits for the first point of the next minute before it closes a bar. Here the watermark
closes it: a minute that has points holds one entry of a map state, an append touches that entry alone, and
a key that goes silent still gets its bars, as long as its values are fresh. Once no value can serve a later
boundary the key holds no state at all, so state follows the keys that are live and not those ever seen.
A key has one timer, at the first time at which it has something to release.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketlake.operators.resample import Grains
from marketlake.streaming.state import LATENESS, on_event_time, spaced

LEGS_DDL = "mid double, mid_sec bigint, prob double, prob_sec bigint"
#: names of the two states, by which `open_state` finds them
OPEN, CARRIED = "open_minutes", "carried"
NOTHING = (None, None, None, None)


def newer(old: tuple, new: tuple) -> tuple:
    """Of each leg the value observed last; of two at one time, the new one."""
    out: tuple = ()
    for i in (0, 2):
        use = new if old[i + 1] is None or (new[i + 1] is not None and new[i + 1] >= old[i + 1]) else old
        out += use[i : i + 2]
    return out


def fresh(legs: tuple, t: int, grains: Grains) -> tuple[bool, bool]:
    """Whether each leg may serve the boundary t."""
    limits = ((legs[1], grains.spot_stale), (legs[3], grains.prob_stale))
    return tuple(sec is not None and t - sec <= limit for sec, limit in limits)


def close_minutes(
    legs: tuple, at: int, minutes: list[tuple[int, tuple]], until: int, grains: Grains
) -> tuple[list[tuple], tuple, int]:
    """Bars (t, mid, prob) of the boundaries after `at` up to `until`, the legs known there, and the last one passed.

    minutes: (boundary, legs) in order. Stretches in which nothing is fresh are skipped, not walked.
    """
    bars, coming = [], iter(minutes)
    minute = next(coming, None)
    while True:
        t = at + grains.minute
        if not any(fresh(legs, t, grains)):
            t, legs = (minute[0], NOTHING) if minute else (until + 1, NOTHING)
        if t > until:
            return bars, legs, at
        if minute and minute[0] == t:
            legs, minute = newer(legs, minute[1]), next(coming, None)
        if all(fresh(legs, t, grains)):
            bars.append((t, legs[0], legs[2]))
        at = t


def wake_at(handle, t: int) -> None:
    """Have the key's one timer fire once the watermark lies behind second t, or earlier if it is set so."""
    due = t * 1000 - 1  # a timer fires once the watermark lies beyond it
    timers = list(handle.listTimers())
    for later in timers:
        if later > due:
            handle.deleteTimer(later)
    if not any(set_for <= due for set_for in timers):
        handle.registerTimer(due)


def drop(entries, due: list[int], n: int) -> None:
    """Remove the entries that are due, of the n there are."""
    if len(due) == n:
        entries.clear()
        return
    for t in due:
        entries.removeKey((t,))


class _Bars(StatefulProcessor):
    def __init__(self, keys: list[str], grains: Grains):
        self.keys, self.grains = keys, grains

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState(OPEN, "t bigint", LEGS_DDL)
        self.carried = handle.getValueState(CARRIED, f"{LEGS_DDL}, passed bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step = self.grains.minute
        new = pd.concat(list(rows))[["sec", "btc_mid", "poly_p_up"]].sort_values("sec", kind="stable")
        minute = -(-new["sec"] // step) * step
        legs = []
        for leg in ("btc_mid", "poly_p_up"):
            last = new[new[leg].notna()].groupby(minute)[["sec", leg]].last()
            legs.append({int(t): (float(v), int(s)) for t, s, v in last.itertuples()})
        minutes = sorted({*legs[0], *legs[1]})
        waiting = self.open.exists()
        for t in minutes:
            seen = (*legs[0].get(t, NOTHING[:2]), *legs[1].get(t, NOTHING[:2]))
            known = self.open.getValue((t,)) if waiting else None
            self.open.updateValue((t,), seen if known is None else newer(tuple(known), seen))
        if minutes:
            wake_at(self.handle, minutes[0])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step = self.grains.minute
        until = timerValues.getCurrentWatermarkInMs() // 1000 // step * step
        minutes = sorted((int(k[0]), tuple(v)) for k, v in self.open.iterator())
        due = [m for m in minutes if m[0] <= until]
        *legs, at = self.carried.get() if self.carried.exists() else (*NOTHING, due[0][0] - step if due else until)
        bars, legs, at = close_minutes(tuple(legs), at, due, until, self.grains)
        drop(self.open, [t for t, _ in due], len(minutes))
        waiting = [t for t, _ in minutes[len(due) : len(due) + 1]]
        if any(fresh(legs, at + step, self.grains)):
            self.carried.update((*legs, at))
            waiting.append(at + step)
        else:
            self.carried.clear()
        if waiting:
            self.handle.registerTimer(min(waiting) * 1000 - 1)
        if bars:
            named = {k: [v] * len(bars) for k, v in zip(self.keys, key)}
            t, mid, prob = zip(*bars)
            yield pd.DataFrame({**named, "t": t, "btc_mid": mid, "poly_p_up": prob})

    def close(self) -> None:
        pass


def timed_bars(
    points: DataFrame, grains: Grains = Grains(), keys: tuple[str, ...] = ("series",), lateness: str = LATENESS
) -> DataFrame:
    """Streaming bars of (keys, sec, btc_mid, poly_p_up): `minute_bars(opened=False)` up to the watermark.

    Values may be NULL; a point whose values are both NULL adds nothing. Rows at or behind the watermark
    are dropped, so a boundary closes once and for good. Of two values of a key and second the one
    that arrived last counts.
    """
    named = [f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys]
    rows = on_event_time(points.select(*keys, "sec", "btc_mid", "poly_p_up"), "sec", lateness)
    schema = ", ".join([*named, "t bigint, btc_mid double, poly_p_up double"])
    return rows.groupBy(*keys).transformWithStateInPandas(_Bars(list(keys), grains), schema, "append", "eventTime")


def open_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What `timed_bars` holds, read back from a query's checkpoint.

    One row per key (a struct `key`) that still has state: open_minutes, how many minutes wait for the
    watermark, and passed, the last boundary behind the values carried on (NULL if none are).
    """
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    minutes = read(OPEN).select("key", F.lit(1).alias("n"), F.lit(None).cast("long").alias("passed"))
    carried = read(CARRIED).select("key", F.lit(0).alias("n"), F.col("value.passed").alias("passed"))
    return minutes.unionAll(carried).groupBy("key").agg(F.sum("n").alias("open_minutes"), F.max("passed").alias("passed"))


#: Seconds whose waiting rows share an entry of the throttle's state.
STRETCH = 3600


class _Throttle(StatefulProcessor):
    def __init__(self, keys: list[str], t: str, columns: list[str], ddl: str, interval: int):
        self.t, self.columns, self.ddl, self.interval = t, columns, ddl, interval
        self.row = Row(*keys, t, *columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint", self.ddl)
        self.last = handle.getValueState("last", "t bigint")

    def held(self, start: int) -> dict[int, tuple]:
        """The rows that wait in the stretch from `start` on, by second."""
        seconds, *values = self.waiting.getValue((start,))
        return {int(t): row for t, *row in zip(seconds, *values)}

    def hold(self, start: int, rows: dict[int, tuple]) -> None:
        """Put a stretch's rows into the state: the seconds, and an array per column."""
        self.waiting.updateValue((start,), (list(rows), *map(list, zip(*rows.values()))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best: dict[int, tuple] = {}
        for row in rows:
            t, values = int(row[self.t]), tuple(row[c] for c in self.columns)
            best[t] = min(best[t], values, key=in_column_order) if t in best else values
        stretches: dict[int, dict[int, tuple]] = {}
        for t, values in best.items():
            stretches.setdefault(t // STRETCH * STRETCH, {})[t] = values
        waiting = self.waiting.exists()
        for start, rows_of in stretches.items():
            if waiting and self.waiting.containsKey((start,)):
                known = self.held(start)
                for t, values in rows_of.items():
                    known[t] = min(tuple(known[t]), values, key=in_column_order) if t in known else values
                rows_of = known
            self.hold(start, rows_of)
        wake_at(self.handle, min(best))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        starts = sorted(int(k[0]) for k in self.waiting.keys())
        last = int(self.last.get()[0]) if self.last.exists() else -(2**60)
        done: list[int] = []
        later: list[int] = []
        for start in starts:
            if start > passed:
                later.append(min(self.held(start)))
                break
            rows = self.held(start)
            seconds = sorted(rows)
            due = [t for t in seconds if t <= passed]
            for i in spaced(np.array(due, dtype="int64"), last, self.interval):
                last = due[i]
                yield self.row(*key, last, *rows[last])
            if len(due) < len(seconds):
                later.append(seconds[len(due)])
                if due:
                    self.hold(start, {t: rows[t] for t in seconds[len(due) :]})
                break
            done.append(start)
        drop(self.waiting, done, len(starts))
        if last + self.interval > passed:  # it may still hold a row back
            self.last.update((last,))
            later.append(last + self.interval)
        else:
            self.last.clear()
        if later:
            self.handle.registerTimer(min(later) * 1000 - 1)

    def close(self) -> None:
        pass


def in_column_order(values: tuple) -> tuple:
    """Order of structs: NULL first, NaN last."""
    return tuple((v is not None, v != v, 0 if v is None else v) for v in values)


def throttle_stream(
    rows: DataFrame, keys: list[str], t: str, interval: int = 1, lateness: str = LATENESS
) -> DataFrame:
    """Streaming form of `throttle`: the same rows, each released once the watermark has passed its second.

    A second that waits holds one row, whatever came in it; those of one STRETCH share an entry of the state, since
    every access to an entry is a round trip. The last row kept is held for `interval` seconds. Repeated and late rows therefore change nothing, in whatever order rows arrive.
    """
    columns = [c for c in rows.columns if c not in keys and c != t]
    of = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields}
    ddl = ", ".join(of[c] for c in columns)
    held = ", ".join(["t array<bigint>", *(f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in columns)])
    timed = on_event_time(rows.withColumn(t, F.col(t).cast("bigint")), t, lateness)
    schema = ", ".join([*[of[k] for k in keys], f"`{t}` bigint", ddl])
    work = _Throttle(keys, t, columns, held, interval)
    return timed.groupBy(*keys).transformWithState(work, schema, "append", "eventTime")

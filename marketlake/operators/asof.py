"""As-of joins and exact-offset labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.chunks import CHUNK, chunk_of, chunk_window, core_only, with_halo
from marketlake.operators.ordered import PART, PLACE, in_order, inherited, take_over


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    tolerance: int | None = None,
    chunk: int = 3600,
    matched: str = "_right_t",
) -> DataFrame:
    """For each left row, the newest right row at or before it (backward as-of).

    `on` is a whole-number time column of both sides. With a tolerance, right rows are also
    sent to the chunks their tolerance reaches, and one window per (key, chunk) answers
    every left row in a single shuffle. Without one, a chunk inherits the newest right row
    of all earlier chunks from a one-row-per-chunk table, so no window spans a whole key.
    Left rows without a match keep NULLs; `matched` holds the time of the right row.
    """
    payload = F.struct(F.col(on).alias("t"), *values)
    lefts = left.withColumn("_side", F.lit(1))
    # as in any equi-join, a NULL key matches nothing; such left rows stay, unmatched
    rights = right.dropna(subset=[*by, on]).select(*by, on, payload.alias("_r"))
    lefts = lefts.withColumn("_r", F.lit(None).cast(rights.schema["_r"].dataType))
    if tolerance is not None:
        # a shorter chunk would copy each right row into every chunk it reaches over
        chunk = max(chunk, tolerance)
        rights = with_halo(rights, on, chunk, before=tolerance).drop("_core")
    else:
        rights = rights.withColumn(CHUNK, chunk_of(on, chunk))
    lefts = lefts.withColumn(CHUNK, chunk_of(on, chunk))
    both = lefts.unionByName(rights.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    # several right rows at one time: the greatest wins, so the result is repeatable
    newest = F.last("_r", ignorenulls=True).over(
        chunk_window(by, on, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    )
    out = both.withColumn("_m", newest).where(F.col("_side") == 1)
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.col(on) - F.col("_m.t") <= tolerance, F.col("_m")))
    else:
        # every (key, chunk) that has right rows hands its newest on to later chunks
        tails = rights.groupBy(*by, CHUNK).agg(F.max("_r").alias("_tail"))
        wanted = lefts.select(*by, CHUNK).distinct()
        carried = (
            wanted.withColumn("_tail", F.lit(None).cast(tails.schema["_tail"].dataType))
            .withColumn("_want", F.lit(True))
            # a chunk inherits from earlier chunks only, so its request sorts before its own tail
            .unionByName(tails.withColumn("_want", F.lit(False)))
            .withColumn(
                "_carry",
                F.last("_tail", ignorenulls=True).over(
                    Window.partitionBy(*by)
                    .orderBy(CHUNK, F.col("_want").desc())
                    .rowsBetween(Window.unboundedPreceding, 0)
                ),
            )
            .where("_want")
            .select(*by, CHUNK, "_carry")
        )
        out = out.join(carried, [*by, CHUNK], "left").withColumn("_m", F.coalesce("_m", "_carry"))
    return out.select(
        *left.columns, F.col("_m.t").alias(matched), *[F.col(f"_m.{v}").alias(v) for v in values]
    )


def asof_scan(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    tolerance: int | None = None,
    parts: int | None = None,
    matched: str = "_right_t",
) -> DataFrame:
    """What asof_join gives, by one ordered scan over range partitions of both sides.

    Rows are dealt by their place in the order (key, time, right before left), so that parts are about equal
    however many rows a key, a second or a single instant holds; only the right row a part ends with is
    handed on, one row per part. Fit for keys and times of unknown density; where a chunk of time
    surely fits a task, asof_join shuffles once less. Both sides must be reproducible: scans or materialised.
    """
    payload = F.struct(F.col(on).alias("t"), *values)
    rights = right.dropna(subset=[*by, on]).select(*by, on, payload.alias("_r"), F.lit(0).alias("_side"))
    lefts = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(rights.schema["_r"].dataType))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    placed = in_order(both, *by, on, "_side", "_r", parts=parts)
    seen = Window.partitionBy(PART, *by).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_m", F.last("_r", ignorenulls=True).over(seen)).where(F.col("_side") == 1)
    tails = placed.groupBy(*by, PART).agg(F.max("_r").alias("_tail"))
    carried = inherited(tails, by, "_tail", lambda w: F.last("_tail", ignorenulls=True).over(w))
    out = take_over(out, carried, by).withColumn("_m", F.coalesce("_m", "_carried"))
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.col(on) - F.col("_m.t") <= tolerance, F.col("_m")))
    return out.select(
        *left.columns, F.col("_m.t").alias(matched), *[F.col(f"_m.{v}").alias(v) for v in values]
    )


def _with_anchor(found: DataFrame, renamed: DataFrame, bars: DataFrame, by: list[str], on: str, names: list[str]) -> DataFrame:
    """Bars without an anchor take their key's earliest one."""
    first = renamed.groupBy(*by).agg(
        F.min(F.struct(F.col(on).alias("t"), *names)).alias("_first")
    )
    return (
        found.withColumn(on, F.col("_at"))
        .join(first, by)
        .select(
            *bars.columns,
            F.coalesce("anchor_t", F.col("_first.t")).alias("anchor_t"),
            *[
                F.when(F.col("anchor_t").isNotNull(), F.col(n)).otherwise(F.col(f"_first.{n}")).alias(n)
                for n in names
            ],
        )
    )


def asof_anchor(
    bars: DataFrame, by: list[str], on: str, values: list[str], lag: int = 300, chunk: int = 3600
) -> DataFrame:
    """Per bar, the newest bar at least `lag` seconds older, else the key's earliest bar.

    Anchor columns carry the suffix `_anchor`.
    """
    renamed = bars.select(*by, on, *[F.col(v).alias(f"{v}_anchor") for v in values])
    names = [f"{v}_anchor" for v in values]
    shifted = bars.withColumn("_at", F.col(on)).withColumn(on, F.col(on) - lag)
    found = asof_join(shifted, renamed, by, on, names, None, chunk, matched="anchor_t")
    return _with_anchor(found, renamed, bars, by, on, names)


def asof_anchor_scan(
    bars: DataFrame, by: list[str], on: str, values: list[str], lag: int = 300, parts: int | None = None
) -> DataFrame:
    """What asof_anchor gives, by an ordered scan: for keys whose bars outgrow a chunk. bars must be reproducible."""
    renamed = bars.select(*by, on, *[F.col(v).alias(f"{v}_anchor") for v in values])
    names = [f"{v}_anchor" for v in values]
    shifted = bars.withColumn("_at", F.col(on)).withColumn(on, F.col(on) - lag)
    found = asof_scan(shifted, renamed, by, on, names, None, parts, matched="anchor_t")
    return _with_anchor(found, renamed, bars, by, on, names)


def realized_label(
    bars: DataFrame, by: list[str], on: str, mid: str, step: int, horizon: int = 5, chunk: int | None = None
) -> DataFrame:
    """The return realised at each bar: log(mid / mid exactly `horizon` steps ago).

    NULL unless the bar `horizon` bars back lies exactly that many steps back, that is, unless
    no bar between is missing; 0 for unusable prices.
    """
    back = horizon * step
    rows = with_halo(bars, on, max(chunk or step * 4096, back), before=back)
    w = chunk_window(by, on)
    unbroken = F.count("*").over(w.rangeBetween(-back, 0)) == horizon + 1
    origin = F.first(mid).over(w.rangeBetween(-back, -back))
    rows = rows.withColumn("origin_mid", F.when(unbroken, origin))
    positive = (F.col("origin_mid") > 0) & (F.col(mid) > 0)
    label = F.when(
        F.col("origin_mid").isNotNull(),
        F.when(positive, F.log(F.col(mid) / F.col("origin_mid"))).otherwise(0.0),
    )
    return core_only(rows.withColumn("realized", label)).withColumn(
        "origin_t", F.when(F.col("origin_mid").isNotNull(), F.col(on) - back)
    )

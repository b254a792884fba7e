"""Time-chunk helpers: ordered work on one series without one task per series.

A popular series may hold a third of all rows, so nothing here opens a window
over a whole series of ticks. Two shapes cover every ordered operator:

* bounded look-back / look-ahead (fills, lags, rolling statistics): rows are cut
  into chunks along the order column and the rows within reach of a chunk border
  are also sent to the neighbour chunk (`with_halo`). One shuffle, exact.
* unbounded look-back (row numbers, running sums, last value ever): each chunk
  is reduced to one row by a map-side-combined aggregate, the small chunk table is
  scanned in order, and what a chunk inherits is joined back (`row_index`,
  `running_columns`, and the as-of join).

Keys and the order column must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
CORE = "_core"


def chunk_of(t: str, length: int) -> Column:
    return F.floor(F.col(t) / length).cast("bigint")


def with_halo(df: DataFrame, t: str, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """Add `_chunk`, repeating rows that a neighbour chunk needs; `_core` marks the owner.

    A chunk sees every row up to `before` units ahead of its start and up to
    `after` units behind its end. Only border rows are repeated.
    """
    own = chunk_of(t, length)
    if not before and not after:
        return df.withColumn(CHUNK, own).withColumn(CORE, F.lit(True))
    first = F.floor((F.col(t) - after) / length).cast("bigint")
    last = F.floor((F.col(t) + before) / length).cast("bigint")
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(CHUNK) == own
    )


def core_only(df: DataFrame) -> DataFrame:
    """Drop the repeated border rows and the helper columns."""
    return df.where(CORE).drop(CHUNK, CORE)


def chunk_window(keys: list[str], *order: Column | str):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def row_index(
    df: DataFrame, keys: list[str], t: str, length: int, *order: Column | str, total: str | None = None
) -> DataFrame:
    """0-based position `idx` in time order per key; optionally the key's row count too.

    Positions inside a chunk come from a window over that chunk only; the number of
    rows in earlier chunks comes from a count per chunk.
    """
    rows = df.withColumn(CHUNK, chunk_of(t, length))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    local = F.row_number().over(chunk_window(keys, *(order or (t,))))
    return (
        rows.withColumn("_local", local)
        .join(offsets.drop("_n"), [*keys, CHUNK])
        .withColumn("idx", (F.col("_local") + F.col("_offset") - 1).cast("bigint"))
        .drop("_local", "_offset", CHUNK)
    )


def carry_sums(
    rows: DataFrame, keys: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Per chunk, the sum of each expression over the key's earlier chunks.

    `rows` must already carry `_chunk`. The result has one row per (keys, chunk).
    """
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = rows.groupBy(*keys, CHUNK).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    return per_chunk.select(
        *keys, CHUNK, *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(n) for n in sums]
    )


def running_columns(
    df: DataFrame, keys: list[str], t: str, length: int, sums: dict[str, Column], *order: Column | str
) -> DataFrame:
    """Add running totals per key in the given order, one column per expression."""
    values = {f"_v_{n}": e for n, e in sums.items()}
    rows = df.withColumn(CHUNK, chunk_of(t, length)).withColumns(values)
    carried = carry_sums(rows, keys, {f"_c_{n}": F.col(f"_v_{n}") for n in sums})
    w = chunk_window(keys, *(order or (t,))).rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"_v_{n}": F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0.0)) for n in sums}
    return rows.withColumns(inside).join(carried, [*keys, CHUNK]).select(
        *df.columns, *[(F.col(f"_v_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    )

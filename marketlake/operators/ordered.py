"""Total order and ordered scans over range partitions.

Work that follows an order through a whole table (numbering, running sums, the last value seen) is
cut here by *rows*, not by time: a range shuffle on the order deals the rows into parts of about
equal length, whatever key or instant is busy, and each part is sorted and written once. What a
part inherits from those before it is one row per part, found from a table of one row per part and
carried on. A key that holds all rows of a table, or all of them in one instant, spreads over all
tasks.

The input is read twice (Spark samples it to choose the ranges) and must be reproducible: a scan, or
a materialised table, without a shuffle after it. The parts are written below the shared folder, so
that all passes see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marketlake.session import materialize

PART = "_part"
PLACE = "_place"
#: monotonically_increasing_id() holds the partition above this bit and the row's place below it.
PLACE_BITS = 33


def in_order(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """Add `_part` and `_place`: rows ordered by (_part, _place) follow the given order.

    Rows that tie in the order are dealt by their position in the input, so that ties too spread
    over parts. `parts` defaults to the session's shuffle partitions.
    """
    row = "_in_row"
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumn(row, F.monotonically_increasing_id())
    by = [*keys, F.col(row)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    at = F.monotonically_increasing_id()
    placed = dealt.sortWithinPartitions(*by).drop(row).withColumn("_in_place", at)
    return materialize(
        placed.withColumns(
            {
                PART: F.shiftright("_in_place", PLACE_BITS).cast("int"),
                PLACE: F.col("_in_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
            }
        ).drop("_in_place")
    )


def part_sizes(placed: DataFrame) -> DataFrame:
    """One row per part: its rows and those of all parts before it."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def number_rows(df: DataFrame, *order: Column | str, name: str = "seq", parts: int | None = None) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order, without gaps and without one task."""
    placed = in_order(df, *order, parts=parts)
    # one row per part
    return numbered(placed, F.broadcast(part_sizes(placed)), name)


def numbered(placed: DataFrame, sizes: DataFrame, name: str = "seq") -> DataFrame:
    """Number the rows of in_order(); sizes: its part_sizes()."""
    return (
        placed.join(sizes, PART)
        .withColumn(name, F.col("_before") + F.col(PLACE))
        .drop(PART, PLACE, "_rows", "_before")
    )


def inherited(summary: DataFrame, keys: list[str], state: str, carried: Callable[[WindowSpec], Column]) -> DataFrame:
    """What a key's rows in a part take over from the parts before.

    summary: one row per (keys, part) with a column `state`. Only the first key of a part can have rows in
    an earlier one, so the result has at most one row per part. `carried` gives the value taken over,
    for a window of the key's earlier parts.
    """
    spanning = summary.groupBy(*keys).agg(F.min(PART).alias("_first"), F.max(PART).alias("_last")).where("_first < _last")
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    same = [summary[k].eqNullSafe(spanning[k]) for k in keys]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    # a key spans at most as many parts as there are
    return (
        summary.join(spanning, condition, "left_semi")
        .withColumn("_carried", carried(earlier))
        .where(F.col("_carried").isNotNull())
        .drop(state)
    )


def take_over(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Join `_carried` to the rows of the keys and parts that inherit something; at most one row per part is sent."""
    own = carried.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(PART).alias("_of_part"), "_carried")
    condition = rows[PART] == own["_of_part"]
    for k in keys:
        condition = condition & rows[k].eqNullSafe(own[f"_of_{k}"])
    return rows.join(F.broadcast(own), condition, "left").drop("_of_part", *[f"_of_{k}" for k in keys])


def running_exact(
    df: DataFrame,
    keys: list[str],
    sums: dict[str, Column],
    *order: Column | str,
    scale: int = 10,
    parts: int | None = None,
) -> DataFrame:
    """Add running totals per key in the given order, as decimals of `scale` places.

    Each value is rounded to `scale` places; sums of decimals are exact, so the totals do not depend
    on how rows are dealt into parts. NULL values add nothing; a total starts at 0.
    """
    names = list(sums)
    values = {f"_v_{n}": F.coalesce(e.cast(f"decimal(28,{scale})"), F.lit(0).cast(f"decimal(28,{scale})")) for n, e in sums.items()}
    placed = in_order(df.withColumns(values), *keys, *order, parts=parts)
    w = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({f"_t_{n}": F.sum(f"_v_{n}").over(w) for n in names})
    totals = placed.groupBy(*keys, PART).agg(F.struct(*[F.sum(f"_v_{n}").alias(n) for n in names]).alias("_total"))
    before = inherited(totals, keys, "_total", lambda w: F.struct(*[F.sum(f"_total.{n}").over(w).alias(n) for n in names]))
    out = take_over(inside, before, keys)
    return out.select(
        *df.columns,
        *[(F.col(f"_t_{n}") + F.coalesce(F.col(f"_carried.{n}"), F.lit(0))).cast(f"decimal(38,{scale})").alias(n) for n in names],
    )

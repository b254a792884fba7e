"""Exact interpolated percentiles without holding or sorting a group's values in one task.

The source is scanned once, into one counted cell per distinct value of a group; whatever is asked of the
values is answered from the cells. A percentile is a rank, and a rank is found by narrowing an
interval of values: a mergeable KLL sketch of the cells in the interval, kept per task and merged, gives
cut points; counting the rows between them, combined on the map side, tells which piece holds the rank; the
interval becomes that piece, and so on until a piece has few enough cells to be laid out as one bounded list.
The sketch only chooses cut points, so its error changes no result. Every round leaves about 1 / SPLITS of an
interval: a thousand million different values take five rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.session import materialize

#: Pieces of an interval per round, and cells of a piece that are laid out as a list.
SPLITS = 32
LISTED = 4096
INTERVAL = ["_g", "lo", "hi"]


def value_cells(rows: DataFrame, by: tuple[str, ...], value: Column | str) -> DataFrame:
    """(_g, v, c): rows per group and distinct value, NULL values included; written once."""
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("_all"))
    v = F.col(value) if isinstance(value, str) else value
    return materialize(rows.select(key.alias("_g"), v.cast("double").alias("v")).groupBy("_g", "v").agg(F.count(F.lit(1)).alias("c")))


def weighted_summary(cells: DataFrame) -> DataFrame:
    """n, mean, std (sample), min and max of the values of every group, from its cells."""
    n = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0))
    first = cells.groupBy("_g").agg(
        n.alias("n"),
        F.try_divide(F.sum(F.col("v") * F.col("c")), n).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    spread = (
        cells.where("v IS NOT NULL")
        .join(first.select("_g", "mean"), "_g")
        .groupBy("_g")
        .agg(F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), F.lit(2))).alias("_ss"))
    )
    std = F.sqrt(F.try_divide(F.col("_ss"), F.col("n") - 1))
    return first.join(spread, "_g", "left").withColumn("std", std).drop("_ss")


def _inside(cells: DataFrame, state: DataFrame) -> DataFrame:
    """The cells of every interval; ranks that share an interval share its cells."""
    intervals = state.select(*INTERVAL).distinct()
    return cells.join(intervals, "_g").where(F.col("v").between(F.col("lo"), F.col("hi")))


def _at_rank(pieces: Column, k: Column, fields: str) -> Column:
    """Of an ordered list of counted pieces, the one that holds row k, and the rows before it."""
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast(fields).alias("piece"))

    def step(at: Column, x: Column) -> Column:
        here = at["piece"].isNull() & (k < at["before"] + x["c"])
        passed = at["piece"].isNull() & ~here
        return F.struct(
            F.when(passed, at["before"] + x["c"]).otherwise(at["before"]).alias("before"),
            F.when(here, x).otherwise(at["piece"]).alias("piece"),
        )

    return F.aggregate(pieces, start, step)


def rows_at(cells: DataFrame, wanted: DataFrame, listed: int = LISTED) -> DataFrame:
    """The value of the k-th smallest row (from 0) of a group, for every (_g, probe, k) wanted.

    cells must hold no NULL values.
    """
    span = cells.groupBy("_g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("cells"))
    state = materialize(wanted.join(span, "_g"))
    cuts = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    while (state.agg(F.max("cells")).first()[0] or 0) > listed:
        wide = state.where(F.col("cells") > listed)
        inside = _inside(cells, wide)
        sketch = F.kll_sketch_agg_double("v")
        bounds = inside.groupBy(*INTERVAL).agg(sketch.alias("_s")).select(
            *INTERVAL, F.kll_sketch_get_quantile_double("_s", cuts).alias("cuts")
        )
        # a sketch ignores NaN, which is above all numbers: a piece of its own
        piece = F.when(F.isnan("v"), F.lit(SPLITS)).otherwise(F.size(F.filter("cuts", lambda x: x <= F.col("v"))))
        pieces = (
            inside.join(bounds, INTERVAL)
            .groupBy(*INTERVAL, piece.alias("piece"))
            .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("cells"), F.min("v").alias("low"), F.max("v").alias("high"))
            .groupBy(*INTERVAL)  # at most SPLITS + 1 rows each
            .agg(F.array_sort(F.collect_list(F.struct("low", "high", "c", "cells"))).alias("_p"))
        )
        at = _at_rank(F.col("_p"), F.col("k"), "struct<low:double,high:double,c:bigint,cells:bigint>")
        narrowed = wide.join(pieces, INTERVAL).withColumn("_at", at).select(
            "_g",
            "probe",
            (F.col("k") - F.col("_at.before")).alias("k"),
            F.col("_at.piece.low").alias("lo"),
            F.col("_at.piece.high").alias("hi"),
            F.col("_at.piece.cells").alias("cells"),
        )
        state = materialize(narrowed.unionByName(state.where(F.col("cells") <= listed).select(narrowed.columns)))
    lists = (
        _inside(cells, state)
        .groupBy(*INTERVAL)  # at most `listed` rows each
        .agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("_p"))
    )
    at = _at_rank(F.col("_p"), F.col("k"), "struct<v:double,c:bigint>")
    return state.join(lists, INTERVAL).select("_g", "probe", at["piece"]["v"].alias("v"))


def percentiles_of(cells: DataFrame, fractions: dict[str, float], listed: int = LISTED) -> DataFrame:
    """One row per _g with a column per named fraction, from the cells of its values; NULL values are ignored."""
    known = cells.where(F.col("v").isNotNull())
    sizes = known.groupBy("_g").agg(F.sum("c").alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f).alias("f")) for name, f in fractions.items()]))
    places = sizes.select("_g", "n", names.alias("_q")).select(
        "_g", F.col("_q.name").alias("name"), ((F.col("n") - 1) * F.col("_q.f")).alias("pos")
    )
    low, high = F.floor("pos").cast("long"), F.ceil("pos").cast("long")
    probes = places.select(
        "_g",
        F.explode(
            F.array(
                F.struct(F.struct("name", F.lit(0).alias("side")).alias("probe"), low.alias("k")),
                F.struct(F.struct("name", F.lit(1).alias("side")).alias("probe"), high.alias("k")),
            )
        ).alias("_p"),
    ).select("_g", "_p.probe", "_p.k")
    found = rows_at(known, probes, listed).groupBy("_g", F.col("probe.name").alias("name")).agg(
        F.max(F.when(F.col("probe.side") == 0, F.col("v"))).alias("v0"),
        F.max(F.when(F.col("probe.side") == 1, F.col("v"))).alias("v1"),
    )
    part = F.col("pos") - F.floor("pos")
    q = F.when(part == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part)
    return (
        places.join(found, ["_g", "name"])
        .groupBy("_g")
        .agg(*[F.max(F.when(F.col("name") == name, q)).alias(name) for name in fractions])
    )


def exact_percentiles(
    rows: DataFrame, by: tuple[str, ...], value: Column | str, fractions: dict[str, float], listed: int = LISTED
) -> DataFrame:
    """One row per group with a column per named fraction; NULL values are ignored."""
    found = percentiles_of(value_cells(rows, by, value), fractions, listed)
    return found.select(*[F.col(f"_g.{c}").alias(c) for c in by], *fractions)


def summary_with_percentiles(
    rows: DataFrame, by: tuple[str, ...], value: Column | str, fractions: dict[str, float]
) -> DataFrame:
    """n, mean, std, min, max and the named percentiles per group, from one scan of the rows.

    Without groups an empty table gives one row with n = 0.
    """
    cells = value_cells(rows, by, value)
    summary, found = weighted_summary(cells), percentiles_of(cells, fractions)
    out = summary.join(found, "_g", "left").select(
        *[F.col(f"_g.{c}").alias(c) for c in by], "n", "mean", "std", "min", *fractions, "max"
    )
    if by:
        return out
    one = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("_none"))
    return one.join(F.broadcast(out), how="left").withColumn("n", F.coalesce("n", "_none")).drop("_none")  # one row each

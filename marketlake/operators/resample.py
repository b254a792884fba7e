"""Ticks to regular grids, forward fill and the training table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.pricing import probability_leg, spot_leg
from marketlake.functions.times import MICROS, align_down, align_up, bucket, to_timestamp
from marketlake.operators.chunks import (
    CHUNK,
    chunk_of,
    chunk_window,
    core_only,
    row_index,
    with_halo,
)
from marketlake.session import materialize


@dataclass(frozen=True)
class Grains:
    """Time scales in seconds. The defaults are those of a live tick feed."""

    second: int = 1
    minute: int = 60
    spot_fill: int = 10
    prob_fill: int = 120
    steps: int = 5
    horizon: int = 5
    spot_stale: int = 30
    prob_stale: int = 180
    chunk_rows: int = 4096
    slug_suffix: str = "-updown-5m-"

    @property
    def chunk(self) -> int:
        """Chunk length of minute-grid work: at most `chunk_rows` rows per series."""
        return self.minute * self.chunk_rows


def recency(ts: Column | str, start: Column, length: int, tie: Column | str) -> Column:
    """Sort key "newest in the bucket" as one long, so `max_by` stays a hash aggregate.

    High bits: microseconds since the bucket start; low bits: a hash of the tie-break,
    which makes equal timestamps repeatable. A struct key would force sort aggregation.
    """
    bits = 62 - (length * MICROS).bit_length()
    offset = F.unix_micros(ts) - start * MICROS
    return F.shiftleft(offset, bits).bitwiseOR(F.xxhash64(tie).bitwiseAND(F.lit((1 << bits) - 1)))


def last_per_bucket(ticks: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Last price of each leg per (asset, second): one hash aggregate for both legs."""
    spot, prob = spot_leg(), probability_leg(grains.slug_suffix)
    rows = ticks.where(spot | prob).select(
        "asset",
        bucket("ts", grains.second).alias("sec"),
        F.col("ts").cast("timestamp").alias("ts"),
        "price",
        spot.alias("_spot"),
    )
    newest = recency("ts", F.col("sec"), grains.second, "price")
    is_spot = F.col("_spot")
    return rows.groupBy("asset", "sec").agg(
        F.max_by("price", F.when(is_spot, newest)).alias("btc_mid"),
        F.max_by("price", F.when(~is_spot, newest)).alias("poly_p_up"),
    )


def ffill_bounded(
    df: DataFrame,
    keys: list[str],
    t: str,
    limits: dict[str, int],
    chunk: int,
    trim: bool = False,
) -> DataFrame:
    """Carry each column's last non-null value forward for at most its limit (in units of `t`).

    With `trim`, a column is not carried past its own last observation of the key, as a
    resampled series ends there.
    """
    reach = max(limits.values())
    out = with_halo(df, t, max(chunk, reach), before=reach)
    for c, limit in limits.items():
        w = chunk_window(keys, t).rangeBetween(-limit, 0)
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(w))
    out = core_only(out)
    if not trim:
        return out
    ends = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_end_{c}") for c in limits]
    )
    out = out.join(ends, keys)
    for c in limits:
        out = out.withColumn(c, F.when(F.col(t) <= F.col(f"_end_{c}"), F.col(c)))
    return out.drop(*[f"_end_{c}" for c in limits])


def minute_cells(ticks: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Newest price of each leg in the seconds that lead up to each grid minute.

    This is the only pass over the ticks: one hash aggregate whose output has one row per
    (asset, minute). The second of a tick is its bucket start, so the snapshot at minute T
    may use ticks up to the end of second T.
    """
    spot, prob = spot_leg(), probability_leg(grains.slug_suffix)
    rows = (
        ticks.where(spot | prob)
        .select("asset", "ts", "price", spot.alias("_spot"), bucket("ts", grains.second).alias("sec"))
        .withColumn("cell", align_up("sec", grains.minute))
    )
    length = grains.minute + grains.second
    newest = recency("ts", F.col("cell") - grains.minute, length, "price")
    is_spot = F.col("_spot")
    return rows.groupBy("asset", "cell").agg(
        F.max_by("price", F.when(is_spot, newest)).alias("spot_px"),
        F.max(F.when(is_spot, F.col("sec"))).alias("spot_sec"),
        F.min(F.when(is_spot, F.col("sec"))).alias("spot_first"),
        F.max_by("price", F.when(~is_spot, newest)).alias("prob_px"),
        F.max(F.when(~is_spot, F.col("sec"))).alias("prob_sec"),
    )


def sampled_minutes(cells: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Minutes for which a leg has a fresh enough value, with those values.

    Each cell offers its newest price to the grid minutes its fill limit reaches; the newest
    offer wins. Minutes outside the spot leg's span are dropped, and no leg is carried past
    its own last second.
    """
    ends = cells.groupBy("asset").agg(
        F.min("spot_first").alias("_spot_first"),
        F.max("spot_sec").alias("_spot_end"),
        F.max("prob_sec").alias("_prob_end"),
    )
    last = align_down(
        F.greatest(F.col("spot_sec") + grains.spot_fill, F.col("prob_sec") + grains.prob_fill),
        grains.minute,
    )
    offers = cells.where(last >= F.col("cell")).withColumn(
        "t", F.explode(F.sequence("cell", last, F.lit(grains.minute).cast("bigint")))
    )
    spot_ok = F.col("t") - F.col("spot_sec") <= grains.spot_fill
    prob_ok = F.col("t") - F.col("prob_sec") <= grains.prob_fill
    grid = offers.groupBy("asset", "t").agg(
        F.max_by("spot_px", F.when(spot_ok, F.col("spot_sec"))).alias("btc_mid"),
        F.max_by("prob_px", F.when(prob_ok, F.col("prob_sec"))).alias("_prob"),
    )
    return (
        grid.join(ends, "asset")
        .where(
            (F.col("t") >= align_up("_spot_first", grains.minute))
            & (F.col("t") <= align_down("_spot_end", grains.minute))
        )
        .select(
            "asset",
            "t",
            "btc_mid",
            F.when(F.col("t") <= F.col("_prob_end"), F.col("_prob")).alias("poly_p_up"),
        )
    )


def snapshot_grid(cells: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Every minute between the first and last spot price of each asset, values where known.

    Minutes are generated chunk by chunk, so a long history is never one row's array.
    """
    bounds = cells.groupBy("asset").agg(
        align_up(F.min("spot_first"), grains.minute).alias("_from"),
        align_down(F.max("spot_sec"), grains.minute).alias("_to"),
    )
    step = F.lit(grains.minute).cast("bigint")
    minutes = (
        bounds.where(F.col("_from") <= F.col("_to"))
        .withColumn(
            CHUNK, F.explode(F.sequence(chunk_of("_from", grains.chunk), chunk_of("_to", grains.chunk)))
        )
        .repartition("asset", CHUNK)
        .select(
            "asset",
            F.explode(
                F.sequence(
                    F.greatest(F.col("_from"), F.col(CHUNK) * grains.chunk),
                    F.least(F.col("_to"), (F.col(CHUNK) + 1) * grains.chunk - grains.minute),
                    step,
                )
            ).alias("t"),
        )
    )
    return minutes.join(sampled_minutes(cells, grains), ["asset", "t"], "left")


def snapshot_features(grid: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Returns, volatility, probability change and forward label on the minute grid.

    Offsets are range frames on time, so absent minutes count as NULL without being
    materialised. All frames share one partitioning and sort; neighbour rows within reach
    of a chunk border travel with the chunk.
    """
    step = grains.minute
    back = grains.steps * step
    rows = with_halo(
        grid,
        "t",
        max(grains.chunk, (2 * grains.steps + 1) * step),
        before=back + (grains.steps - 1) * step,
        after=grains.horizon * step,
    )
    w = chunk_window(["asset"], "t")
    at = lambda c, offset: F.first(c).over(w.rangeBetween(offset, offset))
    recent = w.rangeBetween(-(grains.steps - 1) * step, 0)
    rows = (
        rows.withColumn("_mid_back", at("btc_mid", -back))
        .withColumn("_prob_back", at("poly_p_up", -back))
        .withColumn("_mid_next", at("btc_mid", grains.horizon * step))
        .withColumn("btc_return_5m", F.log(F.try_divide("btc_mid", "_mid_back")))
    )
    full = F.count("btc_return_5m").over(recent) == grains.steps
    return core_only(
        rows.withColumn(
            "btc_volatility_5m", F.when(full, F.stddev_samp("btc_return_5m").over(recent))
        )
    ).select(
        F.col("asset").alias("series"),
        "t",
        to_timestamp("t").alias("ts"),
        "btc_mid",
        "poly_p_up",
        "btc_return_5m",
        "btc_volatility_5m",
        (F.col("poly_p_up") - F.col("_prob_back")).alias("poly_p_up_change_5m"),
        F.log(F.try_divide("_mid_next", "btc_mid")).alias("log_return_5m"),
    )


NEEDED = (
    "btc_mid",
    "btc_return_5m",
    "btc_volatility_5m",
    "poly_p_up",
    "poly_p_up_change_5m",
    "log_return_5m",
)


def build_training_table(ticks: DataFrame, grains: Grains = Grains()) -> DataFrame:
    """Tick archive to feature / label rows: one per series and minute with all six values.

    The per-minute cells are materialised: they are the archive's one large reduction and
    feed several small steps.
    """
    cells = materialize(minute_cells(ticks, grains))
    return snapshot_features(sampled_minutes(cells, grains), grains).dropna(subset=list(NEEDED))


def time_split(
    table: DataFrame,
    holdout: float = 0.2,
    keys: tuple[str, ...] = ("series",),
    t: str = "t",
    chunk: int = 60 * 4096,
    min_train: int = 10,
    min_holdout: int = 5,
) -> DataFrame:
    """Time-ordered index and chronological split; too short series get `insufficient`."""
    rows = row_index(table, list(keys), t, chunk, total="_total")
    cutoff = F.floor(F.col("_total") * F.lit(1.0 - holdout))
    too_short = (cutoff < min_train) | (F.col("_total") - cutoff < min_holdout)
    split = (
        F.when(too_short, "insufficient")
        .when(F.col("idx") < cutoff, "train")
        .otherwise("holdout")
    )
    return rows.withColumn("split", split).drop("_total")

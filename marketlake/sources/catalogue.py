"""Market catalogue: token map, enrichment, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.times import rolling_slug, slug_end

GRACE_SECONDS = 5.0
DEFAULT_TOP = 20
DEFAULT_TOP_ALL = 100


def _text_array(c: str) -> Column:
    return F.from_json(F.col(c), "ARRAY<STRING>")


def token_map(catalogue: DataFrame, order: str = "position") -> DataFrame:
    """token id → question, slug, outcome; outcomes pair with tokens by position.

    A missing outcome is NULL, malformed token text gives no rows, and the market that
    comes later in `order` wins a token listed twice.
    """
    tokens = catalogue.select(
        F.col(order).alias("_order"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("slug", F.lit("")).alias("slug"),
        _text_array("outcomes").alias("_outcomes"),
        F.posexplode(_text_array("clobTokenIds")).alias("_pos", "asset_id"),
    )
    entry = F.struct("question", "slug", F.get("_outcomes", F.col("_pos")).alias("outcome"))
    return (
        tokens.where(F.col("asset_id").isNotNull())
        .groupBy("asset_id")
        .agg(F.max_by(entry, F.struct("_order", "_pos")).alias("m"))
        .select("asset_id", "m.question", "m.slug", "m.outcome")
    )


def enrich_market(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Attach market metadata by asset id; unknown assets keep an empty market.

    No broadcast hint: the token map grows with the number of markets, so the planner
    decides from its measured size, and adaptive execution splits a hot token.
    """
    lookup = tokens.select("asset_id", F.struct("question", "slug", "outcome").alias("market"))
    return events.join(lookup, "asset_id", "left")


def top_markets(catalogue: DataFrame, n: int | None = None, keyword: str | None = None) -> DataFrame:
    """The `n` largest active markets by volume that have tokens, keyword on question or slug.

    `n` defaults to DEFAULT_TOP with a keyword and to DEFAULT_TOP_ALL for all markets.
    """
    if n is None:
        n = DEFAULT_TOP if keyword else DEFAULT_TOP_ALL
    wanted = catalogue
    if "active" in catalogue.columns:
        wanted = wanted.where("active")
    if keyword:
        k = keyword.lower()
        wanted = wanted.where(F.lower("question").contains(k) | F.lower("slug").contains(k))
    has_tokens = F.coalesce(F.length("clobTokenIds"), F.lit(0)) > 0
    return wanted.where(has_tokens).orderBy(F.col("volume").desc_nulls_last(), F.col("slug").asc()).limit(n)


def resolve_rolling_market(
    wanted: DataFrame, catalogue: DataFrame, window_min: int = 5
) -> DataFrame:
    """For each (asset, at): the market of the window open at `at`, else of the next window.

    Both candidate slugs are computed, so this is one equi-join on the slug; no search.
    """
    markets = catalogue.groupBy("slug").agg(
        F.min(F.struct("question", "clobTokenIds", "outcomes")).alias("m")
    )
    candidates = wanted.select(
        "asset",
        "at",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("rank"), rolling_slug("asset", "at", window_min).alias("slug")),
                F.struct(F.lit(1).alias("rank"), rolling_slug("asset", "at", window_min, 1).alias("slug")),
            )
        ).alias("c"),
    ).select("asset", "at", "c.rank", "c.slug")
    found = candidates.join(markets, "slug", "left")
    best = F.min(F.when(F.col("m").isNotNull(), F.struct("rank", "slug", "m"))).alias("b")
    return (
        found.groupBy("asset", "at")
        .agg(best)
        .select(
            "asset",
            "at",
            F.col("b.slug").alias("slug"),
            F.col("b.m.question").alias("question"),
            F.col("b.m.clobTokenIds").alias("clobTokenIds"),
            F.col("b.m.outcomes").alias("outcomes"),
            F.when(F.col("b").isNotNull(), F.col("b.rank") == 0).alias("is_live"),
        )
    )


def missing_markets(resolved: DataFrame) -> DataFrame:
    """Requests for which neither window has a market."""
    return resolved.where(F.col("slug").isNull()).select("asset", "at")


def rediscovery_deadline(resolved: DataFrame, window_min: int = 5) -> DataFrame:
    """Per request time: found and missing assets, and when to look again."""
    end = slug_end("slug", window_min, F.col("at").cast("double"))
    return resolved.groupBy("at").agg(
        F.count("slug").alias("n_found"),
        F.sum(F.col("slug").isNull().cast("bigint")).alias("n_missing"),
        (F.min(F.when(F.col("slug").isNotNull(), end)) + GRACE_SECONDS).alias("deadline"),
    )

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges no longer
    change. Each round is written to the shared folder; smallest neighbours come from partially
    aggregated minima, so that a hub is no single task.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node attach to its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours attach to the smallest of them."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()

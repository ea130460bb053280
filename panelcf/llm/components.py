"""Connected components by alternating large and small stars, one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a vertex moves to the least vertex around it."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours all move to the least of these."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each vertex that has an edge with the least vertex it can reach.

    ``edges``: long columns a, b in any order, repeats and loops allowed. Returns (vertex, root); roots are
    not listed. Each round costs a few shuffles of the edges; a hub's rows meet a single row in each join, so
    adaptive execution may split them. Raises if the labels still move after ``max_rounds``.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        e = stored(_small_star(_large_star(e)), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

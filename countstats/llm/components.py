"""Connected components by alternating large and small stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize


# The smallest neighbours are written before they are joined: so the join meets two plain exchanges, and
# the rows of a hub, or of a large component's root, can be split over tasks.


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node in its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")))
    own = least.select(F.col("m").alias("a"), "b")
    rest = edges.join(least, "b").filter(F.col("a") > F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.union(rest).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the component's smallest node.

    Loops are ignored and edges may repeat. Each round is written to the checkpoint folder; the
    rounds end when a round leaves the edges as they are. No edges give no rows.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct())
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            stars = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
            return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        before = state
        edges = materialize(_small_star(materialize(_large_star(edges))))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

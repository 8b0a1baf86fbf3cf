"""Connected components of a graph in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has two long columns ``a`` and ``b``. Returns (node, root), root being the smallest node of the
    component; nodes without an edge to another node don't appear. Minima are pre-aggregated before the shuffle
    and hubs are joined by joins that adaptive execution may split, so a hub with a third of all edges
    doesn't meet in one task. Every round is a table in the shared folder. Rounds grow with the logarithm of the
    longest path, not with the data.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: (u, v) both ways for large, u > v for small
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = pairs.join(least, "u")
        if large:
            return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)"))).first()
        return tuple(row)

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        big = star(both(now), True)
        big = big.where("a <> b").distinct()
        small = star(big.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        now = materialize(small.where("a <> b").distinct(), "edges")
        then, seen = seen, mark(now)
        if then == seen:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

"""Connected components by alternating large and small stars, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossilframe.llm.common import drop_stored, stored


def _is_forest(e: DataFrame) -> bool:
    """Whether each node of edges (a > b) has one smaller neighbour at most, which has none itself."""
    sides = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    ups = sides.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("all"))
    return ups.filter("ups > 1 OR (ups = 1 AND all > 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (a, b) reaches; nodes that are their own root are left out.

    Each star keeps the graph connected as before and draws nodes to smaller neighbours; the number of rounds grows with
    the logarithm of the longest path. A node's least neighbour comes from partial aggregates and is written down, so
    that the join that follows has plain exchanges on both sides: Spark splits the one task of a node with very many
    neighbours.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _is_forest(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = stored(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        pulled = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        after = stored(pulled.filter("a <> b").distinct())
        drop_stored(e, least, large, small)
        e = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import written


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = _neighbours(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return (
        linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select("u", "m"))
        .where("a <> b")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a root: no node has two edges down, or one down and one from above."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select("b", F.lit(0)))
    held = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return held.where("down > 1 OR (down = 1 AND least = 0)").count() == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a long, b long): component is the least node that can be reached.

    Nodes that are linked to none but themselves are left out. Repeated links, loops and links with a null end are allowed
    and ignored. The links, computed once, and each round are written to the shared folder, which cuts the lineage; rounds
    grow with the logarithm of the longest path. A node with very many links is combined on the map side and its rows are
    split by the adaptive join.
    """
    edges = written(links.select("a", "b").where("a <> b"), "links")
    for _ in range(most_rounds):
        edges = written(_small_star(_large_star(edges)), "stars")
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

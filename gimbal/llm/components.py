"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


# The least neighbours are joined on the complement of the node: both sides are then dealt anew, and Spark
# can split the rows of a node with very many links.


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("c"), F.least("a", "m").alias("m"))
    linked = both.where(F.col("b") > F.col("a")).join(least, F.bitwise_not("a") == F.col("c"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least.select(F.bitwise_not("a").alias("c"), "m"), F.bitwise_not("a") == F.col("c"))
    out = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edge table (a, b); root is the component's least node.

    Self-links are ignored and repeated edges count once; no edges give no rows. Each round is written to the
    shared folder, so that a lost executor costs one round at most. Nothing but two sums reaches the driver.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialise(pairs, "edges"), None
    for _ in range(max_rounds):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or not row[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen, before = tuple(row), now.written
        now = materialise(_small_star(_large_star(now)), "edges")
        discard(edges.sparkSession, before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

MAX_ROUNDS = 60


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root) for each linked node but the roots; root: the smallest node.

    Each round is checkpointed; the number of rounds grows with the logarithm of the longest
    chain. Least neighbours are aggregated before the shuffle, and the joins are plain
    two-sided joins that adaptive execution may split at a node with very many links.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.where("a <> b").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbour(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct())
        least = _least_neighbour(large)
        joined = large.join(least, "a")
        small = joined.select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*")
        edges = cut_lineage(small.where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

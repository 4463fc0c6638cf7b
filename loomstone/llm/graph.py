"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import Tables


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, move to the smallest of them. Here a > b throughout."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60, store: Tables | None = None) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b), in O(log^2 n) rounds.

    A round is two joins and two aggregations of the edges, each aggregated before its shuffle; only
    a count and a checksum of the edges come to the driver. Null ends and loops give no rows. The edges of a round
    are a table in the shared folder, which the next round removes.
    """
    store = store or Tables(edges.sparkSession)
    now = store.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        # a star per component: every a has one b, and no b is an a
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen["n"]:
            break
        mark, before = seen, now
        now = store.cut(_small_star(_large_star(now)))
        store.drop(before)
    else:
        raise RuntimeError(f"components did not converge in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

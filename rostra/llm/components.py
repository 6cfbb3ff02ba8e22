"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round writes its edges to the shared folder. Only sums come to the driver. Joins on a node with very many
    edges are split by adaptive execution; minima are aggregated before the shuffle.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        # large star: every larger neighbour links to the smallest node of the neighbourhood, the node itself included
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node, link to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        now = written(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).head()
        if state == seen or state[0] == state[2] and not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

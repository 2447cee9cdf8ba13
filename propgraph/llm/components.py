"""Connected components of an edge table, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): each is one grouping of the edges, their number never grows, and O(log^2 n) rounds do.
    Every round's edges are checkpointed.  Loops are allowed; an empty table gives no rows.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Of (node, other): every other node of the group is tied to the group's smallest node."""
        least = pairs.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
        return pairs.join(least, "node")

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    while True:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = star(both).where("other > node").select(F.col("other").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        small = star(down).select(F.explode(F.array("node", "other")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

"""Transitive closure of an edge table, and the containment derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """df computed now: in the checkpoint folder, which outlives executors, or (none set, as in tests) in a cache."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    held = df.persist()
    held.count()
    return held


def transitive_closure(edges: DataFrame, most: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) of every path of one or more edges (src, dst), up to `most` edges long (None: any), from `sources` (src; None: any).

    Semi-naive: each round extends only the pairs found new in the last one, and pairs met before are
    dropped, so a cycle ends (and gives its own (a, a) pairs).  Rounds are as many as the longest
    shortest path.  Every round is checkpointed where a checkpoint folder is set, else cached.
    """
    base = edges.select("src", "dst").distinct()
    found = new = keep(base if sources is None else base.join(sources.select("src").distinct(), "src", "left_semi"))
    length = 1
    while (most is None or length < most) and not new.isEmpty():
        step = new.select("src", F.col("dst").alias("mid")).join(base.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = keep(step.join(found, ["src", "dst"], "left_anti"))
        found = found.unionAll(new)  # rounds stay apart, each kept once
        length += 1
    return found


def derived_containment(contains: DataFrame, decomposes: DataFrame) -> DataFrame:
    """(src, dst, derived = true) for what a container's elements decompose into, where no such pair is contained already."""
    below = transitive_closure(decomposes, sources=contains.select(F.col("dst").alias("src"))).select(F.col("src").alias("mid"), "dst")
    reach = contains.select("src", F.col("dst").alias("mid")).join(below, "mid").select("src", "dst").distinct()
    return reach.join(contains.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("derived", F.lit(True))

"""Running rates and label counts of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, key: str, time: str = "ts", amount: str = "value", window: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n, total) of sliding windows; with a watermark, so state is bounded and windows are final once they are past it."""
    spans = events.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("w"), key)
    return spans.agg(F.count("*").alias("n"), F.sum(amount).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def label_counts(nodes: DataFrame) -> DataFrame:
    """(label, n) of a stream of nodes with labels, in update or complete mode."""
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def within_rate(rates_of: DataFrame, most: int, most_amount: float) -> DataFrame:
    """Windows over a rate: more than `most` events or `most_amount` in total."""
    return rates_of.where((F.col("n") > most) | (F.col("total") > most_amount))

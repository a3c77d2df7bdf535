"""Degree and Gram sums kept up to date over a stream of edges or entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out) of a streaming (u, v) table; complete or update mode."""
    both = edges.select(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type; late ones count until ``delay`` behind the newest."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")

"""Metrics that move with the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import half_even, ratio


def windowed_errors(stream: DataFrame, width: str = "5 minutes", delay: str = "10 seconds") -> DataFrame:
    """Events and error rate per tenant and tumbling window; use update mode for live values, append for closed ones."""
    dead = F.count_if(F.col("topic") == "events.deadletter")
    return (stream.withWatermark("processed_at", delay).groupBy(F.window("processed_at", width).alias("w"), "tenant_id")
            .agg(F.count("*").alias("events"), half_even(ratio(dead, F.count("*")), 4).alias("error_rate"))
            .select("tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "error_rate"))


def dropped_late(query) -> int:
    """Rows the state operators dropped because they came behind the watermark, over all progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

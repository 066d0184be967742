"""Degrees kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``(id, degree)`` over a streaming or static ``(src, dst)``; write it in complete or update mode."""
    ends = F.array("src") if directed else F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def windowed_edges(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, end, src, dst, n)``: edges of a stream counted in windows of event time, late ones dropped."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, width).alias("w"), "src", "dst").agg(F.count("*").alias("n")).select("w.start", "w.end", "src", "dst", "n")

"""Graphs from text edge lists."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans.ranked import ranked


def from_edge_list(spark: SparkSession, path: str, directed: bool = False, delimiter: str | None = None, weighted: bool = False, comments: str = "#") -> Graph:
    """Lines ``u v [w]``; blank lines and those that begin with ``comments`` are skipped.

    Fields are parted by white space, or read as CSV with ``delimiter``. The third is read only
    if ``weighted``. What isn't a number raises an error. Large files are read in splits; lines
    are in order of their file's path, their split's place in it and their place in the split.
    """
    split = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = ranked(split, ["file", "block", "at"], "seq").select("seq", "line")
    if delimiter is None:
        fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    else:
        names = ["u", "v", "w"]
        fields = F.array(*(F.trim(F.from_csv("line", ", ".join(f"{n} string" for n in names), {"sep": delimiter})[n]) for n in names))
    rows = lines.withColumn("f", fields).where((F.trim("line") != "") & ~F.coalesce(F.get("f", F.lit(0)), F.lit("")).startswith(comments))
    weight = F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    return Graph.from_frame(rows.select(F.col("seq").cast("long").alias("seq"), F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"), weight.alias("weight")), directed)

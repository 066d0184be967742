"""Places of rows in one order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.cut import cut


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its rows' places, from 0, in ascending ``order``.

    Rows are dealt into ranges and numbered in each; only the ranges' sizes, a row each, are
    added up in one task. The ranges are kept before they are counted, so that a task that runs
    again sees the same ones.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_range").orderBy(*order)
    return parts.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.row_number().over(own) - 1).drop("_range", "_start")

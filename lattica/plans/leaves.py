"""Leaves, which stand one step beyond their only neighbour and are put back after distances are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import round_cut
from lattica.plans.frontiers import batches, levels


def leaves(near: DataFrame) -> DataFrame:
    """``(id, core, weight)`` of nodes with one neighbour in ``near (src, dst, weight)``, both ways and without loops; of two that have but each other, the greater."""
    one = round_cut(near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("core"), F.min("weight").alias("weight")).where("n = 1").drop("n"))
    pair = one.select(F.col("id").alias("core"), F.lit(True).alias("both"))
    return round_cut(one.join(pair, "core", "left").where("both is null or id > core").select("id", "core", "weight"))


def core_of(nodes: DataFrame, near: DataFrame, off: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``near`` without the leaves ``off``."""
    left = near.join(off.select(F.col("id").alias("src")), "src", "left_anti").join(off.select(F.col("id").alias("dst")), "dst", "left_anti")
    return round_cut(nodes.join(off.select("id"), "id", "left_anti")), round_cut(left)


def distance_counts(nodes: DataFrame, near: DataFrame, off: DataFrame | None) -> DataFrame:
    """``(id, d, n)``: how many nodes are ``d`` hops from each, itself at 0.

    Only what is left without the leaves ``off`` is searched from, in batches of bounded rows. A
    leaf sees at ``d`` what its neighbour sees at ``d - 1``, without itself.
    """
    inner, arcs = (nodes, round_cut(near)) if off is None else core_of(nodes, near, off)
    arcs = arcs.select("src", "dst")
    hung = None if off is None else round_cut(off.groupBy(F.col("core").alias("id")).agg(F.count("*").alias("hung")))
    parts = None
    for sources in batches(inner):
        sums = None
        for k, level in enumerate(levels(sources, arcs)):
            if hung is None:
                one = level.groupBy("source").agg(F.count("*").alias("n")).withColumn("d", F.lit(k))
            else:
                both = level.join(hung, "id", "left").groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("hung"), F.lit(0)).alias("m"))
                one = both.select("source", F.explode(F.array(F.struct("n", F.lit(k).alias("d")), F.struct(F.col("m").alias("n"), F.lit(k + 1).alias("d")))).alias("x")).select("source", "x.n", "x.d")
            sums = one if sums is None else sums.unionByName(one)
        made = round_cut(sums.groupBy(F.col("source").alias("id"), "d").agg(F.sum("n").alias("n")).where("n > 0"))
        parts = made if parts is None else parts.unionByName(made)
    if off is None:
        return parts
    beyond = off.select("id", "core").join(parts.withColumnRenamed("id", "core"), "core").select("id", (F.col("d") + 1).alias("d"), (F.col("n") - (F.col("d") == 1).cast("long")).alias("n"))
    own = off.select("id", F.lit(0).alias("d"), F.lit(1).cast("long").alias("n"))
    return parts.select("id", "d", "n").unionByName(beyond.where("n > 0")).unionByName(own)

"""Sides and matchings of bipartite graphs, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.components import components
from lattica.plans.contract import with_sides
from lattica.plans.cut import round_cut
from lattica.plans.ranked import ranked


def sides(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """``(id, side, odd)`` for ``nodes (id, pos)`` and ``near (src, dst)``, both ways: 0 for the side of each part's first node, and whether an odd cycle leaves no sides.

    Each task first puts fewer edges for those that it has. Each node stands twice, and every edge joins either of an
    end to the other of the other, or to the same one if its ends are on one side. A
    part with sides falls into two that way, one for each side of its first node; one with an odd
    cycle stays together.
    """
    k = round_cut(ranked(nodes, ["pos", "id"], "k").select("id", (2 * F.col("k")).alias("k")))
    few = with_sides(near.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("long").alias("odd")))
    ends = few.join(k.withColumnRenamed("id", "u").withColumnRenamed("k", "a"), "u").join(k.withColumnRenamed("id", "v").withColumnRenamed("k", "b"), "v")
    twice = F.explode(F.array(F.struct(F.col("a").alias("u"), (F.col("b") + F.col("odd")).alias("v")), F.struct((F.col("a") + 1).alias("u"), (F.col("b") + 1 - F.col("odd")).alias("v"))))
    roots = round_cut(components(ends.select(twice.alias("e")).select("e.u", "e.v")))
    one = k.join(roots.select(F.col("id").alias("k"), F.col("root").alias("even")), "k", "left").join(roots.select((F.col("id") - 1).alias("k"), F.col("root").alias("odd")), "k", "left")
    return round_cut(one.select("id", F.coalesce((F.col("even") > F.col("odd")).cast("int"), F.lit(0)).alias("side"), F.coalesce(F.col("even") == F.col("odd"), F.lit(False)).alias("odd")))


def _proposed(edges: DataFrame) -> DataFrame:
    """A matching ``(l, r)`` that no edge of ``edges (l, r)`` could be added to: every l asks one r, every r takes one, until none is left to ask."""
    left = round_cut(edges.select("l", "r", F.xxhash64("l", "r").alias("h")))
    mates = left.where(F.lit(False)).select("l", "r")
    while not left.isEmpty():
        asked = left.groupBy("l").agg(F.min(F.struct("h", "r")).alias("x")).select("l", "x.r", "x.h")
        taken = round_cut(asked.groupBy("r").agg(F.min(F.struct("h", "l")).alias("x")).select("x.l", "r"))
        mates = round_cut(mates.unionByName(taken))
        left = round_cut(left.join(taken.select("l"), "l", "left_anti").join(taken.select("r"), "r", "left_anti"))
    return mates


def maximum(edges: DataFrame) -> DataFrame:
    """A maximum matching ``(l, r)`` of the distinct ``edges (l, r)``.

    It begins with one that no edge can be added to. Then, from every l without a mate, trees of
    edges grow together, a level a round: an r joins the tree of the least l that asks for it, and
    its mate after it. As no node is in two trees, each tree whose growth comes to an r without a
    mate gives a path of its own, and along these paths mates are exchanged. When no tree comes to
    one, there is no such path, and the matching is greatest.
    """
    edges = round_cut(edges)
    mates = _proposed(edges)
    while True:
        front = round_cut(edges.select("l").distinct().join(mates.select("l"), "l", "left_anti").withColumn("root", F.col("l")))
        tree = edges.select("r", "l", F.col("l").alias("root")).where(F.lit(False))
        ends = tree.select("r", "root")
        while not front.isEmpty():
            asked = front.join(edges, "l").join(tree.select("r"), "r", "left_anti")
            new = round_cut(asked.groupBy("r").agg(F.min(F.struct("l", "root")).alias("x")).select("r", "x.l", "x.root").join(mates.select("r", F.col("l").alias("mate")), "r", "left"))
            tree = round_cut(tree.unionByName(new.select("r", "l", "root")))
            ends = round_cut(ends.unionByName(new.where("mate is null").groupBy("root").agg(F.min("r").alias("r"))))
            front = round_cut(new.where("mate is not null").select(F.col("mate").alias("l"), "root").join(ends.select("root"), "root", "left_anti"))
        if ends.isEmpty():
            return mates
        at, fresh = ends.select("r"), mates.where(F.lit(False))
        while not at.isEmpty():
            step = round_cut(at.join(tree.select("r", "l"), "r"))
            fresh = round_cut(fresh.unionByName(step.select("l", "r")))
            at = round_cut(step.select("l").join(mates, "l").select("r"))
        mates = round_cut(mates.join(fresh.select("l"), "l", "left_anti").unionByName(fresh))

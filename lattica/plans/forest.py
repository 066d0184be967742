"""Spanning forests, rooted and numbered, in rounds whose number grows with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.components import components
from lattica.plans.cut import round_cut


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges ``(a, b)`` of a forest of ``edges (a, b)``, and ``(id, root)``, the least node of each node's tree.

    Borůvka: every part takes the outgoing edge of least hash, which makes no cycle, and parts
    that edges join become one. Parts halve at least, and edges inside a part are dropped.
    """
    label = round_cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    live = round_cut(edges.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"), F.xxhash64("a", "b").alias("h")))
    forest = live.where(F.lit(False)).select("a", "b")
    while not live.isEmpty():
        least = live.select(F.explode(F.array("ra", "rb")).alias("part"), F.struct("h", "a", "b", "ra", "rb").alias("e")).groupBy("part").agg(F.min("e").alias("e"))
        taken = round_cut(least.select("e.*").distinct())
        forest = round_cut(forest.unionByName(taken.select("a", "b")))
        roots = round_cut(components(taken.select(F.col("ra").alias("u"), F.col("rb").alias("v"))))
        label = round_cut(label.join(roots.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root")))
        ends = live.join(roots.select(F.col("id").alias("ra"), F.col("root").alias("na")), "ra").join(roots.select(F.col("id").alias("rb"), F.col("root").alias("nb")), "rb")
        live = round_cut(ends.where("na <> nb").select("a", "b", F.col("na").alias("ra"), F.col("nb").alias("rb"), "h"))
    return forest, label


def list_ranks(links: DataFrame) -> DataFrame:
    """``(u, v, left)``: how many steps it is to the end of the list, for ``links (u, v, nu, nv)`` to the next item, null at the end.

    Every round an item looks as far ahead again as it has looked so far.
    """
    now = round_cut(links.select("u", "v", "nu", "nv", F.col("nu").isNotNull().cast("long").alias("left")))
    while not now.where("nu is not null").isEmpty():
        ahead = now.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nnu"), F.col("nv").alias("nnv"), F.col("left").alias("more"))
        now = round_cut(now.join(ahead, ["nu", "nv"], "left").select("u", "v", F.col("nnu").alias("nu"), F.col("nnv").alias("nv"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    return now.select("u", "v", "left")


def rooted(forest: DataFrame, label: DataFrame) -> DataFrame:
    """``(id, parent, enter, leave)``: the trees hung from their least nodes, whose parent is null.

    A walk round each tree passes every edge down and up; ``enter`` and ``leave`` are the places of
    a node's two passes in it. So what hangs from a node is entered between them.
    """
    arcs = round_cut(forest.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(forest.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    turn = Window.partitionBy("u").orderBy("v")
    around = Window.partitionBy("u")
    spun = arcs.withColumns({"last": F.lead("v").over(turn).isNull(), "after": F.coalesce(F.lead("v").over(turn), F.min("v").over(around))})
    # Coming from u to v, the walk goes on to the neighbour of v that comes after u.
    came = spun.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("u").alias("nu"), F.col("after").alias("nv"), "last")
    tops = label.where("id = root").select(F.col("id").alias("v"), F.lit(True).alias("top"))
    ends = came.join(tops, "v", "left").withColumn("end", F.col("last") & F.col("top").isNotNull())
    ranks = list_ranks(ends.select("u", "v", F.when(~F.col("end"), F.col("nu")).alias("nu"), F.when(~F.col("end"), F.col("nv")).alias("nv")))
    up, down = F.col("u") > F.col("v"), F.col("u") < F.col("v")
    both = ranks.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max(F.when(down, F.col("left"))).alias("ab"), F.max(F.when(up, F.col("left"))).alias("ba"))
    first = F.col("ab") > F.col("ba")
    hung = both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("parent"), (-F.greatest("ab", "ba")).alias("enter"), (-F.least("ab", "ba")).alias("leave"))
    whole = label.where("id = root").select("id", F.lit(None).cast("long").alias("parent"), F.lit(-(1 << 62)).alias("enter"), F.lit(1 << 62).alias("leave"))
    return round_cut(hung.unionByName(whole))


def below(tree: DataFrame) -> DataFrame:
    """``(id, low, high)``: the least ``low`` and greatest ``high`` among a node and all that hangs from it, for ``tree (id, parent, low, high)``.

    After k rounds a node knows all that hangs less than 2^k below it, and its ancestor 2^k above.
    """
    now = round_cut(tree.select("id", F.col("parent").alias("up"), "low", "high"))
    while not now.where("up is not null").isEmpty():
        sent = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        ahead = now.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("next"))
        more = now.join(sent, "id", "left").join(ahead, "up", "left")
        now = round_cut(more.select("id", F.col("next").alias("up"), F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")))
    return now.select("id", "low", "high")

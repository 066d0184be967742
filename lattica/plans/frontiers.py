"""Shortest paths from many sources at once, as frontiers of (source, node) rows.

Sources are taken in batches, so that a batch holds no more than about ``PAIRS`` rows however
large the graph is; in a batch every level of the search is one plan for all its sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import round_cut
from lattica.plans.ranked import ranked

#: Rows of (source, node) that a batch may come to, and levels after which what has been reached is put together.
PAIRS = 4_000_000
TOGETHER = 8


def batches(nodes: DataFrame) -> Iterator[DataFrame]:
    """``(source)`` frames that make up ``nodes (id, pos)``, each small enough to reach all nodes."""
    n = nodes.count()
    size = max(1, PAIRS // max(1, n))
    if n <= size:
        yield nodes.select(F.col("id").alias("source"))
        return
    placed = round_cut(ranked(nodes, ["pos", "id"]).select(F.col("id").alias("source"), F.floor(F.col("rank") / size).alias("batch")))
    for k in range(math.ceil(n / size)):
        yield placed.where(F.col("batch") == k).select("source")


def levels(sources: DataFrame, arcs: DataFrame) -> list[DataFrame]:
    """``(source, id, paths)`` of what is 0, 1, 2, ... hops from each source over ``arcs (src, dst)``, and by how many shortest paths."""
    front = round_cut(sources.select("source", F.col("source").alias("id"), F.lit(1.0).alias("paths")))
    found, seen = [front], front.select("source", "id")
    while True:
        step = front.join(arcs.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = round_cut(step.join(seen, ["source", "id"], "left_anti"))
        if front.isEmpty():
            return found
        found.append(front)
        seen = seen.unionByName(front.select("source", "id"))
        if len(found) % TOGETHER == 0:
            seen = round_cut(seen)


def dependencies(found: list[DataFrame], arcs: DataFrame, mass: DataFrame | None = None) -> list[DataFrame]:
    """``(id, part)``: how much of the sources' shortest paths passes each node, summed over the sources, a frame for each of ``levels``.

    From the last level back, a node hands what hangs on it, and itself, to those before it, by their shares of its paths.
    ``mass (id, mass)`` tells which nodes stand for more than one, as sources and as ends.
    """
    out, behind = [], None
    for k in range(len(found) - 1, 1, -1):
        hung = found[k].withColumn("part", F.lit(0.0)) if behind is None else found[k].join(behind, ["source", "id"], "left").fillna(0.0, ["part"])
        own = F.lit(1)
        if mass is not None:
            hung, own = hung.join(mass, "id", "left"), F.coalesce("mass", F.lit(1))
        asked = hung.select("source", F.col("id").alias("dst"), ((own + F.col("part")) / F.col("paths")).alias("share")).join(arcs, "dst")
        shares = asked.groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        behind = round_cut(found[k - 1].join(shares, ["source", "id"]).select("source", "id", (F.col("paths") * F.col("share")).alias("part")))
        sent = behind if mass is None else behind.join(mass.withColumnRenamed("id", "source"), "source", "left").select("id", (F.col("part") * own).alias("part"))
        out.append(sent.groupBy("id").agg(F.sum("part").alias("part")))
    return out

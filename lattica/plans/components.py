"""Connected components as checkpointed DataFrame supersteps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.contract import contracted
from lattica.plans.cut import round_cut


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(id, root)`` for each endpoint of ``edges (u, v)``; ``root`` is the smallest id reachable.

    Each task first puts fewer edges for those that it has. Then every round looks two parents up, hooks each vertex and its parent onto the smallest
    grandparent next to it, and shortcuts. Parents only fall, so a round that leaves the sum
    of parents unchanged is the last. A round moves one row per edge and vertex, whatever the
    shape of a component; all minima are combined before they are shuffled. Labels that aren't
    settled after ``max_rounds`` raise an error.
    """
    pairs = contracted(edges.where("u <> v"))
    both = round_cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parent = round_cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("root")))
    total = F.sum(F.col("root").cast("decimal(38,0)")).alias("s")
    before = parent.agg(total).first()["s"]
    for _ in range(max_rounds):
        if before is None:
            return parent
        up = parent.select(F.col("id").alias("root"), F.col("root").alias("grand"))
        known = parent.join(up, "root").select("id", "root", "grand")
        near = both.join(known.select(F.col("id").alias("v"), "grand"), "v").groupBy(F.col("u").alias("id")).agg(F.min("grand").alias("best"))
        seen = known.join(near, "id")
        offers = (
            known.select("id", F.col("grand").alias("root"))
            .unionByName(seen.select("id", F.col("best").alias("root")))
            .unionByName(seen.select(F.col("root").alias("id"), F.col("best").alias("root")))
        )
        parent = round_cut(offers.groupBy("id").agg(F.min("root").alias("root")))
        after = parent.agg(total).first()["s"]
        if after == before:
            return parent
        before = after
    raise RuntimeError(f"components aren't settled after {max_rounds} rounds")

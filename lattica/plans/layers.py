"""An order of nodes in which few neighbours come later, by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import cut, written


def layers(edges: DataFrame) -> DataFrame:
    """``(id, layer)`` for the ends of the edges ``(a, b)``.

    A round takes off all nodes of at most twice the mean degree of what is left, which are
    more than half of them; so rounds are logarithmic in the nodes, and a node has at most four
    times the degeneracy of neighbours in its own layer and later ones.
    """
    left = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    ends = left.select(F.col("src").alias("id")).distinct()
    found, k = None, 0
    while True:
        degrees = cut(left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")))
        mean = degrees.agg(F.avg("d").alias("m")).first()["m"]
        if mean is None:
            break
        off = degrees.where(F.col("d") <= 2 * mean).select("id", F.lit(k).alias("layer"))
        found = off if found is None else found.unionByName(off)
        left = written(left.join(off.select(F.col("id").alias("src")), "src", "left_anti").join(off.select(F.col("id").alias("dst")), "dst", "left_anti"))
        k += 1
    if found is None:
        return ends.withColumn("layer", F.lit(0))
    # Who lost all neighbours before its turn comes after them all.
    return cut(ends.join(found, "id", "left").select("id", F.coalesce("layer", F.lit(k)).alias("layer")))


def onward(edges: DataFrame) -> DataFrame:
    """``(x, y, k)``: each edge from the earlier end to the later one in the order of layers and ids, ``k`` being the later one's place."""
    place = layers(edges)
    at = lambda c: place.select(F.col("id").alias(c), F.struct(F.col("layer"), F.col("id")).alias(f"k{c}"))
    both = edges.join(at("a"), "a").join(at("b"), "b")
    first = F.col("ka") < F.col("kb")
    return written(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("ka", "kb").alias("k")))

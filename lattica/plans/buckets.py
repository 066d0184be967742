"""Arcs kept in buckets by their sources, so that rounds of joins never shuffle them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans.cut import discard, shared_dir

#: Arcs of a bucket, which one task joins.
BUCKET_ARCS = 1_000_000


@contextmanager
def bucketed(g: Graph) -> Iterator[DataFrame]:
    """``(src, dst)``: the arcs of ``g`` as a table with buckets by ``src``, which is dropped in the end. Of pairs each is computed once."""
    spark, name = g.spark, f"lattica_arcs_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (g.arcs if g.pairs is None else g.pairs).select("src", "dst").write.parquet(f"{path}_once")
    arcs = spark.read.parquet(f"{path}_once")
    size = arcs.count() * (1 if g.pairs is None else 2)
    if g.pairs is not None:
        arcs = arcs.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("w")).select("w.*")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_ARCS))
    arcs.repartition(n, "src").write.bucketBy(n, "src").option("path", path).saveAsTable(name)
    discard(spark, f"{path}_once")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        discard(spark, path)

"""What several training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans.cut import cut

#: ASCII capitals to small letters; other bytes stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Small letters for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def apart(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where ``condition`` holds, tested after ``df`` is computed.

    A plain filter would be pushed down with all that its columns are made from, which would
    then be computed several times for each row.
    """
    return df.withColumn("_so", F.explode(F.array(condition))).where("_so").drop("_so")


def nested(docs: DataFrame) -> DataFrame:
    """``docs`` as the one column ``_doc``, so that no name made beside it can clash with the caller's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def flat(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``_doc`` again, those in ``new`` anew."""
    return df.select(*(new.get(c, F.col("_doc").getField(c)).alias(c) for c in columns))


def shards_for(rows: int, rows_per_shard: int) -> int:
    """A power of two, so that a shard is the top bits of a hash."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows / rows_per_shard))))


def running(df: DataFrame, group: list[str], order: str, ties: list[str], values: dict[str, Column], rows: int, rows_per_shard: int = 100_000, told: int = 0) -> DataFrame:
    """``df`` with, for each of ``values``, its sum over the group's rows before this one.

    The order in a group is ``order`` (a uniform 64-bit hash) and then ``ties``. A group is cut
    into shards by the top bits of ``order``; only shards are sorted in one task, and a shard
    begins where the sums of the shards before it end. So a group of any size is spread evenly.
    Rows that agree in ``order`` and ``ties`` follow each other in some order. Up to ``told``
    shards' beginnings are broadcast, so that wide rows are shuffled once; more are joined.
    """
    bits = shards_for(rows, rows_per_shard).bit_length() - 1
    flipped = F.col(order).bitwiseXOR(F.lit(-(1 << 63)))
    shard = F.shiftrightunsigned(flipped, 64 - bits) if bits else F.lit(0).cast("long")
    work = df.withColumns({f"_v_{k}": v for k, v in values.items()}).withColumn("_shard", shard)
    within = Window.partitionBy(*group, "_shard").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = work.groupBy(*group, "_shard").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values))
    ahead = Window.partitionBy(*group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_g_{c}") for c in group), F.col("_shard").alias("_g_shard"), *(F.coalesce(F.sum(f"_s_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in values))
    placed = work.withColumns({f"_c_{k}": F.sum(f"_v_{k}").over(within) - F.col(f"_v_{k}") for k in values})
    same = [placed[c].eqNullSafe(starts[f"_g_{c}"]) for c in group] + [placed["_shard"] == starts["_g_shard"]]
    if told:
        starts = cut(starts)
        same = [placed[c].eqNullSafe(starts[f"_g_{c}"]) for c in group] + [placed["_shard"] == starts["_g_shard"]]
        starts = F.broadcast(starts) if starts.count() <= told else starts
    out = placed.join(starts, same, "left")
    return out.select(*df.columns, *((F.col(f"_c_{k}") + F.coalesce(F.col(f"_b_{k}"), F.lit(0))).alias(k) for k in values))

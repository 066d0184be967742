"""Graphs derived from ordinary tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans.cut import cut

#: Lines that a task joins or groups, and ids of a run whose pairs stay together.
TASK_LINES = 250_000
RUN_IDS = 4096
#: Ids of suppliers begin here in graphs that hold parts or customers too.
SUPPLIER = 1 << 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, rows: DataFrame) -> int:
    """Partitions for ``rows`` of a table, in proportion to them, so that what a task holds doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_LINES))


def _distinct(pairs: DataFrame, n: int, *columns: Column) -> DataFrame:
    """Distinct ``(src, dst)`` and ``columns`` over their rows, runs of sources in the same of ``n`` partitions, where most neighbours of some are those of others."""
    runs = pairs.withColumn("_run", F.floor(F.col("src") / RUN_IDS)).repartition(n, "_run")
    return (runs.groupBy("_run", "src", "dst").agg(*columns) if columns else runs.distinct()).drop("_run")


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Which part came from which supplier: bipartite, undirected."""
    lines = read(spark, sf_dir, "lineitem")
    e = lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst"))
    return Graph.from_pairs(_distinct(e, tasks(spark, lines)))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, weight)``: how many orders hold both parts."""
    lines = read(spark, sf_dir, "lineitem")
    n = tasks(spark, lines)
    e = lines.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").distinct()
    a, b = e.withColumnRenamed("l_partkey", "src"), e.withColumnRenamed("l_partkey", "dst")
    return _distinct(a.join(b, "l_orderkey").where("src < dst").select("src", "dst"), n, F.count("*").cast("double").alias("weight"))


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts in the same order, weighted, undirected."""
    return Graph.from_pairs(part_pairs(spark, sf_dir))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, weight)``: lines sold from a customer's nation to a supplier's."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    e = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(suppliers, "l_suppkey")
    return e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Lines sold between nations, directed, weighted by their number."""
    return Graph.from_frame(sales(spark, sf_dir), True)


def region_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Lines sold between the five regions, directed: a graph small enough to try everything."""
    region = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("r"))
    src, dst = (region.select(F.col("n_nationkey").alias(c), F.col("r").alias(f"{c}_r")) for c in ("src", "dst"))
    e = sales(spark, sf_dir).join(src, "src").join(dst, "dst").groupBy(F.col("src_r").alias("src"), F.col("dst_r").alias("dst")).agg(F.sum("weight").alias("weight"))
    return Graph.from_frame(e, True)


def mutual_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, weight)``, src < dst: lines sold either way between two nations."""
    e = sales(spark, sf_dir).where("src <> dst")
    return e.groupBy(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).agg(F.sum("weight").alias("weight"))


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)``: whose event is followed by whose, of the same type on the same day; with repeats."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null")


def user_succession(spark: SparkSession, sf_dir: str) -> Graph:
    """Which user's event follows which user's, of the same type on the same day; directed."""
    return Graph.from_frame(succession(spark, sf_dir).distinct(), True)


def event_dag(spark: SparkSession, sf_dir: str) -> Graph:
    """User succession with arcs from smaller to greater ids alone: a DAG. The table is read once."""
    e = cut(succession(spark, sf_dir).where("src < dst").distinct())
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(nodes.select("id", F.col("id").alias("pos")), e.select("src", "dst", F.lit(1.0).alias("weight"), F.col("dst").alias("pos")), True, True)


def hierarchy(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Root, regions, nations and suppliers, and each nation's step to the next: a DAG over three whole tables."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    e = region.select(F.lit(0).alias("src"), (1000 + F.col("r_regionkey")).alias("dst"))
    e = e.unionByName(nation.select((1000 + F.col("n_regionkey")).alias("src"), (2000 + F.col("n_nationkey")).alias("dst")))
    e = e.unionByName(supplier.select((2000 + F.col("s_nationkey")).alias("src"), (3000 + F.col("s_suppkey")).alias("dst")))
    after = nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"))
    e = e.unionByName(nation.join(after, "n_nationkey").select((2000 + F.col("n_nationkey")).alias("src"), (2001 + F.col("n_nationkey")).alias("dst")))
    return Graph.from_frame(e.withColumn("weight", 1.0 + F.col("dst") % 7), directed)


def nation_links(spark: SparkSession, sf_dir: str) -> Graph:
    """All nations, linked where their mutual trade is above the average: undirected, and small by nature."""
    e = mutual_trade(spark, sf_dir)
    mean = e.agg(F.avg("weight").alias("mean"))
    k = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return Graph.from_frame(e.join(F.broadcast(mean), F.col("weight") > F.col("mean")).select("src", "dst"), False, k)

"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in
    this process (tests, a laptop) a temporary folder stands in; a cluster must name one.
    """
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
    return _OWN[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; its lineage ends there.

    The copy survives lost executors, since it does not live on them. Spark removes it when
    nothing refers to it any more, where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def round_cut(df: DataFrame) -> DataFrame:
    """``cut`` for a round whose result is joined with itself in the next.

    A checkpoint keeps Spark's estimate of its plan's size, and joins multiply those: over many
    rounds the number itself grows beyond all bounds. Here the estimate is left behind.
    """
    spark, there = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(there.queryExecution().toRdd(), there.schema(), False), spark)


def fresh(spark: SparkSession) -> str:
    """The path of a table yet to be written in the shared folder."""
    return f"{shared_dir(spark)}/lattica_table_{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and later readers take the columns they need."""
    path = fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that a job made and needs no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

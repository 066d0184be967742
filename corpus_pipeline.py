"""From raw documents to packed batches: STAGES, one after the other.

Each stage works on all that the one before it kept, which is written as Parquet and read
again. Texts that fail the quality rules go; of near-duplicates one stays; personal data are
masked; sources are repeated to their weights; what is left is packed into batches of token ids,
which are the result.

An empty table, or one whose every text is rejected (null, empty or short ones are), makes an
empty result. Rows that repeat are one after near-dedup, and as many as the mix sees them from
then on; ids can be null. All stages but the last carry every column of the input, whatever its
name; ``n_chars``, where there is one, is made anew when a text is masked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import table
from lattica.llm.mixing import repeated
from lattica.llm.packing import pack
from lattica.llm.pii import redact
from lattica.llm.quality import keep_good
from lattica.llm.simhash import keep_one
from lattica.plans.cut import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("packing", packing),
]

#: Robust scatter, components and permutations have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs, home = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/lattica-corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs

"""Packing documents into batches by optimal length buckets.

The exact histogram of lengths over all documents is brought to the driver, a row for each
distinct length. Dynamic programming then chooses at most ``buckets`` upper bounds so that
the padding of all documents up to their bound is least; the cost has the quadrangle
inequality, so each row of the table is filled by divide and conquer. A bucket's batches hold
as many documents as fit the token budget at its bound, one at least.

Lengths are those of the documents' token ids, an end id included, by the same tokenizer as the
token files'. The ids themselves go along where they are wanted (``with_ids``), so that a row is
a packed sequence whatever else it stands for.

A document's place in its bucket is its rank by a hash, from sums over shards of the hash
(see ``running``); so a bucket with most of the rows is spread over as many tasks as its shards.

Nulls, ties and the like: a null text has the end id alone. Rows
that repeat are each packed. Documents longer than the budget are alone in their batch. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import running, table
from lattica.llm.token_files import END, default_tokenizer, encoder
from lattica.plans.cut import cut, written

BUCKETS = 16
BUDGET = 16_384
#: Rows of a bucket that one task puts in order, without and with their ids.
SHARD, SHARD_WITH_IDS = 100_000, 4_096
#: Shards whose beginnings are broadcast, at most, where rows have their ids.
TOLD = 1_000_000
SPACE = "[\\x20\\x09-\\x0D]+"


def tokens(text_col: str = "text") -> Column:
    """Words of a text and one end token."""
    return (F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), "")) + 1).cast("long")


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets``, of least total padding for a histogram in ascending order."""
    m = len(lengths)
    if not m:
        return []
    at = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    mass = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    top = lengths.astype(float)

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding if lengths i .. j-1 share a bucket."""
        return top[j - 1] * (at[j] - at[i]) - (mass[j] - mass[i])

    best = np.concatenate([[0.0], [cost(np.array([0]), j)[0] for j in range(1, m + 1)]])
    choice = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        now, cut_at = best.copy(), np.zeros(m + 1, np.int64)
        stack = [(1, m, 0, m)]
        while stack:
            low, high, a, b = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            now[j], cut_at[j] = total[k], i[k]
            stack += [(low, j - 1, a, int(i[k])), (j + 1, high, int(i[k]), b)]
        choice.append(cut_at)
        if now[m] >= best[m]:
            choice.pop()
            break
        best = now
    out, j = [], m
    for cut_at in reversed(choice):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut_at[j])
    return sorted(out)


def tokenized(docs: DataFrame, with_ids: bool, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, order, n_tokens[, ids])``, a row for each row of ``docs``; ``order`` is a hash of id and text."""
    last = np.array([END], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            made = [x + last for x in encode(batch.column(2).to_pylist())]
            columns = [*batch.columns[:2], pa.array([len(x) // 4 for x in made], pa.int64())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in made], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "order", "n_tokens", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("order"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, order long, n_tokens long" + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, with_ids: bool = False, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_len, batch, slot, padding[, ids])``, a row for each row of ``docs``.

    ``bucket`` counts from 0 by bound, ``batch`` from 0 in a bucket; ``slot`` is the place in the batch.
    """
    sized = tokenized(docs, with_ids, tokenizer or default_tokenizer(), id_col, text_col)
    sized = written(sized) if with_ids else cut(sized)
    rows = sized.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()
    lengths, counts = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    tops = bounds(lengths, counts, buckets)
    top = F.array(*(F.lit(x).cast("long") for x in tops)) if tops else F.array().cast("array<bigint>")
    filed = sized.withColumn("bucket", F.size(F.filter(top, lambda x: x < F.col("n_tokens"))))
    filed = filed.withColumn("bucket_len", F.get(top, F.col("bucket")))
    ranked = running(filed, ["bucket"], "order", ["doc_id"], {"rank": F.lit(1).cast("long")}, int(counts.sum()), SHARD_WITH_IDS if with_ids else SHARD, TOLD if with_ids else 0)
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1)).cast("long")
    more = ["ids"] if with_ids else []
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / room).cast("long").alias("batch"), (F.col("rank") % room).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), *more)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all documents."""
    return pack(table(spark, sf_dir, "documents"))

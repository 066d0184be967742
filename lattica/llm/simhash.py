"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart have a common variant at most ``r`` bits from
either. So every distinct fingerprint emits its ball of radius ``r`` (65 variants for r = 1,
2,081 for r = 2), the variants are shuffled, and fingerprints that meet at a variant are
compared. A variant has no more fingerprints around it than its ball holds, so no bucket is
hot, whatever the data; copies are folded into one fingerprint before anything is emitted.
Fingerprints that many rows share are few; what is known of them is broadcast to the rows, and
only the rest is joined by shuffle.

Nulls, ties and the like: a null text is empty; an empty text has fingerprint zero, which is
linked as any other. Rows that repeat get a row each. A null ``doc_id`` is left out of the
minimum; where all ids of a component are null, so is ``component_id``. An empty table gives
an empty result. ``keep_one`` keeps one row of those that agree in id and text, and carries all
columns, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, flat, nested, table
from lattica.plans.components import components
from lattica.plans.cut import cut

BITS = 64
#: Shingles that are voted on at a time.
_VOTES = 1 << 15
#: A fingerprint is common from so many rows, or this share of all, so that few are; and dropped rows that are broadcast at most.
COMMON_ROWS, COMMON_SHARE = 1000, 0.001
BROADCAST_ROWS = 200_000


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text, over all its word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[width - 1 :].tolist() or [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _VOTES):
        rows = hashes[at : at + _VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, h, fp)``: a hash of the text and its fingerprint as a signed long, a row for each row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fps = np.array([fingerprint(x or b"", width, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "h", "fp"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.encode(text, "UTF-8").alias("text")).mapInArrow(work, "doc_id long, h long, fp long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(u, v)`` between the distinct ``fp`` at most ``radius`` (2 or 4) bits apart.

    At a variant the fingerprints are put in order and each is linked to the one before it.
    Those around one variant are all within ``radius`` of each other, so this chain joins the
    same fingerprints as all their pairs would; each link is compared once more.
    """
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(BITS)]
    flips = [0, *bits, *((x ^ y for x, y in itertools.combinations(bits, 2)) if radius == 4 else ())]
    ball = fps.select("fp", F.explode(F.array(*(F.lit(x).cast("long") for x in flips))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    chain = ball.withColumn("u", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= radius
    return chain.where(F.col("u").isNotNull() & close).select("u", F.col("fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp, root, component_id)``, a row for each row of ``docs``; ``root`` names
    the component by a fingerprint."""
    each = cut(fingerprints(docs, id_col, text_col, width))
    kinds = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(ball_links(kinds.select("fp"), radius))
    linked = roots.join(kinds, roots["id"] == kinds["fp"]).select("fp", "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = cut(linked.join(best, "root").select("fp", "root", "component"))
    known = cut(kinds.join(moved, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")))
    common = F.col("n") > max(COMMON_ROWS, int(COMMON_SHARE * each.count()))
    told = F.broadcast(known.where(common).drop("n"))
    rest = each.join(told.select("fp"), "fp", "left_anti").join(known.where(~common).drop("n"), "fp")
    return each.join(told, "fp").unionByName(rest).select("doc_id", "h", "fp", "root", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, at 2 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id, and then text's hash."""
    groups = cut(near_duplicates(docs.select("doc_id", "text"), radius, width).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")))
    keep = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("k")).select(F.col("root").alias("_r"), "k.doc_id", "k.h")
    rest = groups.select("root", F.col("doc_id").alias("_i"), F.col("h").alias("_h")).join(keep, (F.col("root") == F.col("_r")) & F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left_anti")
    gone = cut(rest.select("_i", "_h"))
    out = nested(docs).withColumns({"_id": F.col("_doc.doc_id"), "_text": F.xxhash64("_doc.text")})
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_h"))
    kept = out.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if not groups.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_text"])
    return flat(kept, docs.columns)

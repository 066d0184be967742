"""Mixing sources by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of ``alpha``, normalised. The
exponent is bisected: either the entropy of the weights meets a share of the greatest possible
(``target_entropy``), or the most repeated source is seen at most ``repeats`` times as often as
the least repeated one; if both are given the larger exponent counts, which keeps both limits
on repetition. The budget is the smallest at which every source is seen whole (or what is
given). A source is cut into blocks of about ``BLOCK_TOKENS``, and into ``LEAST_BLOCKS`` at least, by
ranges of a hash of its documents; tokens here are words and one end for each text. Its part of the budget is dealt in epochs: each full epoch is a permutation of all
its blocks, and the last one takes the blocks that come first in its own permutation until the
part is used up, the last of these as far as it is needed. A permutation orders blocks by a
keyed hash, drawn for each epoch anew; in a block documents are in order of their hash.

The sources' table (a row a source) is joined by broadcast if it is small and by shuffle
otherwise; the exponent comes from a histogram of shares, rounded to 1/1024 of an octave,
so what comes to the driver is bounded. Only blocks' sums are put in order for a source; its
documents are sorted a block at a time, so a source with most of the rows is spread over as
many tasks as its blocks. A row whose place is wanted nowhere learns from its own hashes and
its source's row which epochs it is in.

Nulls, ties and the like: a null source is one of its own. A null text has one token, its end.
Rows that repeat are documents of their own, in one block; in the last epoch rows that agree in
id and text are taken or left together. An empty table gives an empty result. ``repeated``
carries all columns of the input, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import flat, nested, running, table
from lattica.llm.packing import tokens
from lattica.plans.cut import cut

#: Share of the greatest entropy, times the most repeated source is seen to the least's, tokens in a block, about, and blocks of a source at least.
TARGET_ENTROPY = 0.97
REPEATS = 2.0
BLOCK_TOKENS = 1 << 18
LEAST_BLOCKS = 64
SEED = 17
BROADCAST_SOURCES = 10_000


def entropy(octaves: list[tuple[float, int]], alpha: float) -> float:
    """Entropy of the weights in nats, from ``(log2 share, sources)``."""
    top = max(x for x, _ in octaves)
    parts = [(2.0 ** (alpha * (x - top)), n) for x, n in octaves]
    total = sum(w * n for w, n in parts)
    return -sum(n * (w / total) * math.log(w / total) for w, n in parts if w > 0)


def exponent(octaves: list[tuple[float, int]], target_entropy: float | None, repeats: float | None) -> float:
    """The largest exponent in [0, 1] whose entropy reaches the target, but at least the one that the limit on repetition asks for."""
    sources = sum(n for _, n in octaves)
    if sources < 2:
        return 1.0

    def bisected(fits) -> float:
        low, high = 0.0, 1.0
        if fits(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    alpha = 1.0 if target_entropy is None else bisected(lambda a: entropy(octaves, a) >= target_entropy * math.log(sources) - 1e-12)
    if repeats is not None:
        spread = max(x for x, _ in octaves) - min(x for x, _ in octaves)
        # A source is seen weight / share = share^(alpha - 1) times as often as others.
        alpha = max(alpha, bisected(lambda a: (1 - a) * spread >= math.log2(repeats)))
    return alpha


def plan(sized: DataFrame, target_entropy: float | None = TARGET_ENTROPY, repeats: float | None = REPEATS, budget: int | None = None) -> tuple[DataFrame, int]:
    """``(_source, _rows, _size, _weight, _quota)`` a row for each source, and the number of rows."""
    sums = cut(sized.groupBy("_source").agg(F.count("*").alias("_rows"), F.sum("_tokens").alias("_size")))
    whole = sums.agg(F.sum("_size").alias("t"), F.sum("_rows").alias("n"), F.count("*").alias("k")).first()
    total = float(whole["t"] or 1)
    octave = F.round(F.log2(F.col("_size") / total) * 1024) / 1024
    found = sums.groupBy(octave.alias("x")).agg(F.count("*").alias("n")).collect()
    alpha = exponent(sorted((r["x"], r["n"]) for r in found), target_entropy, repeats) if found else 1.0
    raised = sums.withColumn("_raised", F.pow(F.col("_size") / total, F.lit(alpha)))
    norm = raised.agg(F.sum("_raised").alias("z"), F.max(F.col("_size") / F.col("_raised")).alias("most")).first()
    z = norm["z"] or 1.0
    budget = budget or (norm["most"] or 0.0) * z
    quota = F.ceil(F.col("_raised") / z * budget - 1e-6).cast("long")
    return raised.select("_source", "_rows", "_size", (F.col("_raised") / z).alias("_weight"), quota.alias("_quota")), int(whole["k"])


def _hash(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    """The keyed hash that orders an epoch's blocks, for each source anew."""
    return F.xxhash64(source, block, epoch.cast("long"), F.lit(seed).cast("long"))


def _block() -> Column:
    """A document's block: the top ``_bits`` of its hash."""
    flipped = F.col("_order").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.col("_bits") > 0, F.call_function("shiftrightunsigned", flipped, (64 - F.col("_bits")).cast("int"))).otherwise(F.lit(0).cast("long"))


def scheduled(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Texts' sizes and hashes, the sources' table and the number of sources.

    A source has ``_full`` epochs and ``_bits`` of blocks. Of its last epoch, blocks with hashes
    below ``_reach`` are in, and of the block with that hash documents with hashes below ``_until``.
    """
    light = cut(docs.select(F.col(source_col).alias("_source"), tokens(text_col).alias("_tokens"), F.xxhash64(id_col, text_col).alias("_order"), F.col(id_col).cast("long").alias("_id")))
    sources, n = plan(light, target_entropy, repeats, budget)
    bits = F.ceil(F.log2(F.greatest(F.col("_size") / BLOCK_TOKENS, F.lit(float(LEAST_BLOCKS))))).cast("int")
    sources = cut(sources.withColumns({"_full": F.floor(F.col("_quota") / F.col("_size")).cast("long"), "_part": F.col("_quota") % F.col("_size"), "_bits": bits}))
    last = with_sources(light, sources, n).where(F.col("_part") > 0).withColumn("_block", _block())
    sums = cut(last.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_tokens"), F.max("_part").alias("_part"), F.max("_full").alias("_full")).withColumn("_hash", _hash(F.col("_source"), F.col("_block"), F.col("_full"), seed)))
    laid = running(sums, ["_source"], "_hash", ["_block"], {"_before": F.col("_tokens")}, sums.count())
    # The block in which the part ends, and in it the first document that begins where it is used up.
    edge = laid.where((F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_tokens") >= F.col("_part")))
    edge = cut(edge.select("_source", F.col("_block").alias("_edge"), F.col("_hash").alias("_reach"), (F.col("_part") - F.col("_before")).alias("_rest")))
    inside = with_sources(last.select("_source", "_block", "_order", "_tokens"), edge, n).where(F.col("_block") == F.col("_edge"))
    upto = Window.partitionBy("_source").orderBy("_order").rangeBetween(Window.unboundedPreceding, -1)
    until = inside.withColumn("_before", F.coalesce(F.sum("_tokens").over(upto), F.lit(0))).where(F.col("_before") >= F.col("_rest")).groupBy("_source").agg(F.min("_order").alias("_until"))
    ends = edge.alias("e").join(until.alias("u"), F.col("e._source").eqNullSafe(F.col("u._source")), "left").select("e._source", "_reach", "_until")
    known = sources.alias("s").join(ends.alias("b"), F.col("s._source").eqNullSafe(F.col("b._source")), "left").select("s.*", "_reach", "_until")
    return light, cut(known), n


def with_sources(df: DataFrame, sources: DataFrame, n: int, source: Column | None = None) -> DataFrame:
    known = sources.withColumnRenamed("_source", "_s")
    source = F.col("_source") if source is None else source
    return df.join(F.broadcast(known) if n <= BROADCAST_SOURCES else known, source.eqNullSafe(F.col("_s"))).drop("_s")


def _epochs(seed: int, source: str = "_source") -> Column:
    """The epochs that a document of ``_block`` is seen in."""
    hashed = _hash(F.col(source), F.col("_block"), F.col("_full"), seed)
    late = (hashed < F.col("_reach")) | ((hashed == F.col("_reach")) & (F.col("_until").isNull() | (F.col("_order") < F.col("_until"))))
    copies = F.col("_full") + F.when((F.col("_part") > 0) & late, 1).otherwise(0)
    return F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))


def mix(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, n_tokens, epoch, block, ahead, position, weight)``, a row for each time a document is seen.

    ``ahead`` counts the tokens of its source before it in the epoch, and ``position`` is the
    share of the source's part of the budget before it: rows in order of ``position`` are the
    mix, at its weights from beginning to end.
    """
    light, sources, n = scheduled(docs, target_entropy, repeats, budget, seed, source_col, id_col, text_col)
    each = with_sources(light, sources, n).withColumn("_block", _block()).withColumn("_epoch", F.explode(_epochs(seed)))
    place = ["_source", "_epoch", "_block"]
    sums = cut(each.groupBy(*place).agg(F.sum("_tokens").alias("_tokens")).withColumn("_hash", _hash(F.col("_source"), F.col("_block"), F.col("_epoch"), seed)))
    laid = running(sums, ["_source", "_epoch"], "_hash", ["_block"], {"_before": F.col("_tokens")}, sums.count())
    laid = laid.select(*(F.col(c).alias(f"{c}_") for c in place), "_before")
    own = Window.partitionBy(*place).orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = each.withColumn("_within", F.sum("_tokens").over(own) - F.col("_tokens"))
    same = [inside[c].eqNullSafe(laid[f"{c}_"]) for c in place]
    ahead = F.col("_before") + F.col("_within")
    position = (F.col("_epoch") * F.col("_size") + ahead) / F.col("_quota")
    return inside.join(laid, same).select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), ahead.cast("long").alias("ahead"), F.round(position, 9).alias("position"), F.round("_weight", 9).alias("weight"))


def repeated(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix sees them, with its own columns; texts meet no shuffle."""
    _, sources, n = scheduled(docs, target_entropy, repeats, budget, seed)
    told = with_sources(nested(docs), sources, n, F.col("_doc.source")).withColumn("_order", F.xxhash64("_doc.doc_id", "_doc.text"))
    return flat(told.withColumn("_block", _block()).withColumn("_epoch", F.explode(_epochs(seed, "_doc.source"))), docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at the default target."""
    return mix(table(spark, sf_dir, "documents"))

"""Sharding by fixed virtual slots.

A record is hashed, by its id and text, into one of ``SLOTS`` virtual slots, and stays there for
good. Bytes are added up for each slot, and a map says which shard holds which slots. The map is
made by dealing slots, the heaviest first, to the shard that holds least; it is stored under a
version, and a rebalancing edits it into the next version: slots leave shards that hold more than
their share, or that are no more, for those that hold least, and all others stay. Records meet
the map by a broadcast of ``SLOTS`` rows, so that texts are never shuffled.

The law is ``bytes``: shards' sizes are as near to each other as slots allow. A record that is
repeated so often that its copies outweigh ``HEAVY`` slots is dealt over as many slots as it
outweighs; copies can't be told from each other, so none of them has a place to keep. Only ids,
hashes and sizes are shuffled, and records that agree are added up before. The map's rows, at
most ``SLOTS``, are the only ones that come together.

Nulls, ties and the like: a null text is empty and weighs 8 bytes; a null id is an id. A very long
text is one record: its shard is as heavy as it is, and gets less else. Rows that repeat get a row
each. ``slot`` counts the rows of a shard from 0, in order of virtual slot, text's hash and id; rows
that repeat follow each other. An empty table makes an empty result and a map of empty slots. All
columns of the input stay in ``assigned``, which puts ``shard`` (in place of one of that name) beside them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import nested, table, text_of
from lattica.plans.cut import cut, shared_dir

#: Virtual slots, shards, bytes that a record costs beside its text, and the slots' worth of bytes from which copies are dealt out.
SLOTS = 8192
SHARDS = 24
RECORD_BYTES = 8
HEAVY = 8

MAP = ["version", "virtual_slot", "bytes", "rows", "shard"]


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, size, text_crc32, n)``: distinct records, and how often each is there."""
    raw = F.encode(text_of(text_col), "UTF-8")
    size = (F.octet_length(text_of(text_col)) + RECORD_BYTES).cast("long")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"), size.alias("size"), F.crc32(raw).alias("text_crc32"))
    return light.groupBy(*light.columns).agg(F.count("*").alias("n"))


def total_bytes(found: DataFrame) -> int:
    return int(found.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0)


def _pieces(total: int, slots: int) -> Column:
    """Slots that a record's copies are dealt over."""
    weight = F.col("size").cast("double") * F.col("n") * slots / max(1, total)
    return F.when(weight > HEAVY, F.least(F.col("n"), F.ceil(weight).cast("long"))).otherwise(F.lit(1).cast("long"))


def _virtual(piece: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("h"), piece.cast("long")), F.lit(slots)).cast("int")


def slotted(found: DataFrame, total: int, slots: int = SLOTS) -> DataFrame:
    """``records`` with their ``virtual_slot``; a heavy one in pieces, each with its part of ``n``."""
    pieces = found.withColumn("_pieces", _pieces(total, slots)).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    part = F.floor(F.col("n") / F.col("_pieces")).cast("long") + (F.col("_piece") < F.col("n") % F.col("_pieces")).cast("long")
    return pieces.withColumns({"virtual_slot": _virtual(F.col("_piece"), slots), "n": part}).drop("_pieces", "_piece")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(virtual_slot, bytes, rows)`` for every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _dealt(free: DataFrame, loads: DataFrame) -> DataFrame:
    """``free (virtual_slot, bytes, rows)`` with ``shard``: the heaviest first, each to the shard of ``loads (shard, load)`` that holds least.

    The shards are an array in order of their load, so the first is the one to give to.
    """
    both = free.select("virtual_slot", "bytes", "rows", F.lit(None).cast("long").alias("load"), F.lit(None).cast("int").alias("shard"))
    both = both.unionByName(loads.select(F.col("load").cast("long").alias("load"), F.col("shard").cast("int").alias("shard")), allowMissingColumns=True)
    slot = F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "bytes", "rows")
    held = F.struct("load", "shard")
    one = both.agg(F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), held))).alias("queue"), F.array_sort(F.collect_list(F.when(F.col("shard").isNull(), slot))).alias("line"))

    def give(state: Column, slot: Column) -> Column:
        least = F.element_at(state["queue"], 1)
        fuller = F.struct((least["load"] + slot["bytes"]).alias("load"), least["shard"].alias("shard"))
        rest = F.slice(state["queue"], F.lit(2), F.size(state["queue"]))
        return F.struct(F.array_sort(F.concat(rest, F.array(fuller))).alias("queue"), F.concat(state["picks"], F.array(least["shard"])).alias("picks"))

    start = F.struct(F.col("queue"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate("line", start, give, lambda state: state["picks"])
    return one.select(F.explode(F.arrays_zip("line", picks.alias("shard"))).alias("x")).select("x.line.virtual_slot", "x.line.bytes", "x.line.rows", "x.shard")


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0 of the map: ``(version, virtual_slot, bytes, rows, shard)``. Slots without bytes are dealt in turn."""
    loads = sizes.sparkSession.range(shards).select(F.col("id").alias("shard"), F.lit(0).alias("load"))
    bare = sizes.where("bytes = 0").withColumn("shard", F.pmod("virtual_slot", F.lit(shards)))
    return _dealt(sizes.where("bytes > 0"), loads).unionByName(bare).withColumn("version", F.lit(0)).select(*MAP)


def rebalanced(before: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
    """The next version of ``before`` for ``sizes`` as they are now and ``shards`` as there shall be.

    A shard that is no more gives all its slots. One that holds more than its share by
    ``tolerance`` gives slots, in a fixed order, as long as it keeps its share. Those are dealt
    like new ones; every other slot stays where it is.
    """
    now = before.select("version", "virtual_slot", "shard").join(sizes, "virtual_slot")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    share = now.withColumn("share", F.lit(total / shards))
    own = Window.partitionBy("shard")
    given = F.sum("bytes").over(own.orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = share.withColumns({"load": F.sum("bytes").over(own), "given": given})
    over = (F.col("load") > F.col("share") * (1 + tolerance)) & (F.col("bytes") > 0) & (F.col("given") <= F.col("load") - F.col("share"))
    marked = cut(share.withColumn("free", (F.col("shard") >= shards) | over))
    stay = marked.where("not free")
    kept = stay.groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left").fillna(0, ["load"])
    moved = _dealt(marked.where("free").select("virtual_slot", "bytes", "rows"), loads)
    version = marked.agg(F.max("version")).first()[0] + 1
    return stay.select("virtual_slot", "bytes", "rows", "shard").unionByName(moved).withColumn("version", F.lit(version)).select(*MAP)


def save_map(edited: DataFrame, path: str) -> int:
    """Store a map beside its earlier versions, none of which is ever changed; its version."""
    edited = cut(edited)
    version = edited.first()["version"]
    edited.drop("version").coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, or the last one."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == last).select(*MAP)


def placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``slotted`` rows, each copy one, with ``shard`` and its place ``slot`` in it."""
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    start = known.select("version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("virtual_slot").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rows.withColumn("_before", F.sum("n").over(within) - F.col("n")).join(F.broadcast(start), "virtual_slot")
    copies = each.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return copies.withColumn("slot", F.col("_start") + F.col("_before") + F.col("_copy"))


def assigned(docs: DataFrame, known: DataFrame, total: int, heavy: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with their ``shard``, without a shuffle. ``heavy`` are the ``heavy_records``, fewer than ``SLOTS / HEAVY``."""
    mine = nested(docs).withColumns({"doc_id": F.col(f"_doc.{id_col}").cast("long"), "h": F.xxhash64(F.coalesce(F.col(f"_doc.{text_col}"), F.lit("")))})
    mine = mine.withColumn("_piece", F.lit(0).cast("long"))
    if heavy is not None:
        told = heavy.select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), _pieces(total, slots).alias("_pieces"))
        mine = mine.join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left")
        mine = mine.withColumn("_piece", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_pieces")), F.lit(0)))
    mine = mine.withColumn("virtual_slot", _virtual(F.col("_piece"), slots))
    with_map = mine.join(F.broadcast(known.select("virtual_slot", "shard")), "virtual_slot")
    return with_map.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns if c != "shard"), "shard")


def heavy_records(found: DataFrame, total: int, slots: int = SLOTS) -> DataFrame:
    """The records whose copies are dealt over several slots."""
    return found.where(_pieces(total, slots) > 1)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, by a stored map of virtual slots."""
    found = cut(records(table(spark, sf_dir, "documents")))
    rows = slotted(found, total_bytes(found))
    home = f"{shared_dir(spark)}/lattica-slot-map-{uuid.uuid4().hex}"
    known = load_map(spark, home, save_map(first_map(slot_bytes(rows)), home))
    return placed(rows, known).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lattica.llm import sharding as S


def deal(sizes, shards):
    """Brute force: the heaviest slot first, to the shard that holds least."""
    loads, of = [0] * shards, {}
    for s, b in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda i: (loads[i], i))
        of[s], loads[k] = k, loads[k] + b
    return of, loads


def test_query(spark, sf, rows, empty):
    got = S.op11_sharding(spark, sf).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, sizes = defaultdict(list), Counter()
    for r in got:
        places[r["shard"]].append(r["slot"])
        sizes[r["virtual_slot"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(24))
    of, loads = deal(sizes, 24)
    assert all(of[r["virtual_slot"]] == r["shard"] for r in got)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    again = Counter((r["doc_id"], r["shard"], r["slot"], r["virtual_slot"]) for r in S.op11_sharding(spark, sf).collect())
    assert again == Counter((r["doc_id"], r["shard"], r["slot"], r["virtual_slot"]) for r in got)
    assert S.op11_sharding(spark, empty).count() == 0


def test_copies_are_spread(spark):
    """A third of all rows is one record."""
    docs = spark.range(2000).select("id", F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text")).unionByName(spark.range(1000).select(F.lit(7).cast("long").alias("id"), F.lit("a copied text").alias("text")))
    found = S.records(docs.withColumnRenamed("id", "doc_id")).cache()
    total = S.total_bytes(found)
    rows = S.slotted(found, total)
    assert rows.agg(F.sum("n")).first()[0] == 3000
    sizes = S.slot_bytes(rows)
    assert sizes.count() == S.SLOTS
    known = S.first_map(sizes, 24).cache()
    loads = [r[1] for r in known.groupBy("shard").agg(F.sum("bytes")).collect()]
    assert len(loads) == 24 and max(loads) - min(loads) <= known.agg(F.max("bytes")).first()[0]
    heavy = S.heavy_records(found, total)
    assert [r["doc_id"] for r in heavy.collect()] == [7]
    each = S.assigned(docs.withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("clash")), known, total, heavy)
    assert each.columns == ["doc_id", "text", "shard"] and each.count() == 3000
    spread = [r[1] for r in each.groupBy("shard").agg(F.sum(F.octet_length("text") + 8)).collect()]
    assert max(spread) < 1.2 * total / 24


def test_map_is_edited(spark, tmp_path):
    rows = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(S.SLOTS)).cast("int").alias("virtual_slot"), (10 + F.col("id") % 90).alias("size"), F.lit(1).cast("long").alias("n"))
    sizes = S.slot_bytes(rows).cache()
    path = str(tmp_path / "map")
    assert S.save_map(S.first_map(sizes, 10), path) == 0
    assert S.save_map(S.rebalanced(S.load_map(spark, path), sizes, 11), path) == 1
    old = {r["virtual_slot"]: r["shard"] for r in S.load_map(spark, path, 0).collect()}
    new = {r["virtual_slot"]: r["shard"] for r in S.load_map(spark, path).collect()}
    size = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    share = sum(size.values()) / 11
    moved = [s for s in old if old[s] != new[s]]
    assert set(old) == set(new) and {new[s] for s in moved} == {10}
    load = Counter()
    for s, k in new.items():
        load[k] += size[s]
    assert max(load.values()) <= 1.02 * share and sum(size[s] for s in moved) <= share
    # Two shards fewer: theirs alone move, but for what evens out the rest.
    assert S.save_map(S.rebalanced(S.load_map(spark, path), sizes, 9), path) == 2
    last = {r["virtual_slot"]: r["shard"] for r in S.load_map(spark, path).collect()}
    assert all(last[s] == new[s] for s in new if new[s] < 9) and set(last.values()) == set(range(9))
    # What has grown gives, and nobody else.
    grown = S.slot_bytes(rows.withColumn("n", F.when(F.col("virtual_slot").isin([s for s in last if last[s] == 4]), 3).otherwise(1).cast("long")))
    fresh = {r["virtual_slot"]: r["shard"] for r in S.rebalanced(S.load_map(spark, path), grown, 9).collect()}
    assert {last[s] for s in last if last[s] != fresh[s]} == {4}

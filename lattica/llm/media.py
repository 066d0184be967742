"""Media columns as deduplicated, content-defined chunks.

A text's bytes, padded to a multiple of 64, are the samples of an 8-bit grey image, 64 wide.
Its samples are cut into chunks where a rolling gear hash (of the last 32 bytes) has its top
bits clear, so that a cut depends on the content near it alone. A chunk is known by its
SHA-256.

A task packs the texts that it scans into blocks of bounded size, in a table bucketed by block,
so that later steps read payloads where they are and only digests are shuffled. Each block
lists its distinct digests; for each digest the least block that holds it owns the chunk. A
block is then written anew, with its documents' ordered lists of digests and, in one compressed
pack, the chunks that it owns. So each chunk is stored once. Read back, a block's own chunks are
at hand; the digests that it lacks are joined with the blocks that own them, which give each
wanted chunk once. Every chunk must have the digest it is known by, and every medium that is
put together from its list the digest it was stored under; a block measures a medium once,
however many of its documents share it.

Nulls, ties and the like: a null text is empty, and an empty one is 64 zero bytes. Equal texts
have equal chunks and values. Rows that repeat get a row each, and null ids are kept. A text
longer than a block is a block of its own. An empty table makes empty tables. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.plans.cut import cut, discard, shared_dir

WIDTH = 64
#: Bytes in a chunk: the least, and the bits of the hash that must be clear for a cut (so
#: that cuts are 2^bits apart on average), and the most.
LEAST, CUT_BITS, MOST = 256, 10, 8 << 10
#: Bytes of text in a block, about, the zstd level of its pack, and the most files that blocks are dealt to.
BLOCK_BYTES, LEVEL, MOST_FILES = 8 << 20, 9, 50_000
STAGED = "block long, doc_ids array<long>, n_bytes array<long>, pack binary"
STORED = "block long, doc_ids array<long>, n_bytes array<long>, keys array<binary>, lists array<array<binary>>, digests array<binary>, sizes array<long>, pack binary"
FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gear() -> np.ndarray:
    """A random 32-bit number for each byte, by splitmix64."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = gear()


def rolling(samples: np.ndarray) -> np.ndarray:
    """``h[i] = 2 h[i-1] + gear[s[i]]`` modulo 2^32, for every place.

    A byte's part is shifted out after 32 steps, so the sum of the last 32 is the hash; it
    is doubled up from sums of 1, 2, 4, 8 and 16.
    """
    h = _GEAR[samples]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def chunks(payload: bytes, least: int = LEAST, bits: int = CUT_BITS, most: int = MOST) -> list[bytes]:
    """``payload`` in content-defined pieces."""
    size = len(payload)
    if size <= least:
        return [payload]
    marks = np.flatnonzero(rolling(np.frombuffer(payload, np.uint8)) >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    while at < size:
        k = np.searchsorted(marks, at + least)
        end = min(int(marks[k]) if k < len(marks) else size, at + most, size)
        out.append(payload[at:end])
        at = end
    return out


def payload_of(text: bytes) -> bytes:
    """The bytes of a text, padded with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def header(size: int) -> bytes:
    """The head of a binary grey map of ``size`` samples."""
    return b"P5\n%d %d\n255\n" % (WIDTH, size // WIDTH)


def measured(payload: bytes) -> tuple:
    """Size, digests and features of a medium, from its stored bytes."""
    head = header(len(payload))
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    mean = float(counts @ np.arange(256)) / len(samples)
    spread = float(np.sqrt(max(0.0, counts @ (np.arange(256) - mean) ** 2 / len(samples))))
    share = counts[counts > 0] / len(samples)
    entropy = abs(float(-(share * np.log2(share)).sum()))
    edge = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-WIDTH:]),
        len(head) + len(payload),
        hashlib.sha256(head + payload).hexdigest(),
        f"mean={mean:.6f};std={spread:.6f};entropy={entropy:.6f};edge={edge:.6f}",
    )


def _pack(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def _unpack(pack: bytes, sizes: list[int]) -> list[bytes]:
    whole = memoryview(zstandard.ZstdDecompressor().decompress(pack))
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [bytes(whole[end - n : end]) for n, end in zip(sizes, ends, strict=True)]


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _save(df: DataFrame, files: int, path: str, part: str) -> DataFrame:
    """``df`` as a table in files by block; read by name, it needs no shuffle to meet others by block."""
    name = f"{path.rsplit('/', 1)[1]}_{part}".replace("-", "_")
    df.write.mode("overwrite").bucketBy(files, "block").option("path", f"{path}/{part}").option("compression", "none").saveAsTable(name)
    return df.sparkSession.table(name)


def _opened(spark: SparkSession, path: str, part: str) -> DataFrame:
    name = f"{path.rsplit('/', 1)[1]}_{part}".replace("-", "_")
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{path}/{part}")


def _dropped(spark: SparkSession, path: str, part: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}_{part}".replace("-", "_"))
    discard(spark, f"{path}/{part}")


def staged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Texts in blocks, as they are scanned, and the number of files for them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0

    def block(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([_pack(texts)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "n_bytes", "pack"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if texts and held + len(text) > BLOCK_BYTES:
                    yield block(number, ids, texts)
                    number, held, ids, texts = number + 1, 0, [], []
                ids.append(i)
                texts.append(text)
                held += len(text)
        if texts:
            yield block(number, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("text"))
    return rows.mapInArrow(dealt, STAGED), min(MOST_FILES, max(1, -(-size // BLOCK_BYTES)))


def _cut_up(pack: bytes, n_bytes: list[int]) -> tuple[list[bytes], list[list[bytes]], dict[bytes, bytes]]:
    """Of a block's payloads: their digests, their lists of digests, and its distinct chunks in order."""
    keys, lists, held = [], [], {}
    for text in _unpack(pack, n_bytes):
        payload = payload_of(text)
        parts = [(_digest(c), c) for c in chunks(payload)]
        keys.append(_digest(payload))
        lists.append([d for d, _ in parts])
        held.update(parts)
    return keys, lists, held


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the table ``path``/chunks: a row a block, with its documents' lists and the chunks that it owns."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, pack in zip(*(batch.column(c).to_pylist() for c in ("block", "n_bytes", "pack")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([list(_cut_up(pack, sizes)[2])], pa.list_(pa.binary()))], names=["block", "digests"])

    def filled(part: pa.Table, owned: pa.Table) -> pa.Table:
        number, ids, sizes, pack = (part.column(c)[0].as_py() for c in ("block", "doc_ids", "n_bytes", "pack"))
        keys, lists, held = _cut_up(pack, sizes)
        own = list(held.items())
        own = [own[p] for p in sorted(owned.column("places")[0].as_py())] if owned.num_rows else []
        made = (number, ids, sizes, keys, lists, [d for d, _ in own], [len(c) for _, c in own], _pack([c for _, c in own]))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.binary())), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
        names = [x.split()[0] for x in STORED.split(", ")]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, made, kinds, strict=True)})

    rows, files = staged(docs, id_col, text_col)
    blocks = _save(rows, files, path, "staged")
    each = blocks.select("block", "n_bytes", "pack").mapInArrow(listed, "block long, digests array<binary>").select("block", F.posexplode("digests").alias("place", "digest"))
    owners = each.groupBy("digest").agg(F.min(F.struct("block", "place")).alias("o"))
    owned = owners.groupBy(F.col("o.block").alias("block")).agg(F.collect_list("o.place").alias("places"))
    _save(blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(filled, STORED), files, path, "chunks")
    _dropped(docs.sparkSession, path, "staged")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """What is measured on the stored bytes, a row for each document."""
    found = _opened(spark, path, "chunks")

    def checked(digest: bytes, chunk: bytes) -> bytes:
        if _digest(chunk) != digest:
            raise ValueError(f"stored chunk {digest.hex()} is damaged")
        return chunk

    def own(part: pa.Table) -> dict[bytes, bytes]:
        digests, sizes, pack = (part.column(c)[0].as_py() for c in ("digests", "sizes", "pack"))
        return {d: checked(d, c) for d, c in zip(digests, _unpack(pack, sizes), strict=True)}

    def given(part: pa.Table, wanted: pa.Table) -> pa.Table:
        held = own(part) if wanted.num_rows else {}
        digests = wanted.column("digests")[0].as_py() if wanted.num_rows else []
        return pa.table({"digest": pa.array(digests, pa.binary()), "chunk": pa.array([zstandard.compress(held[d]) for d in digests], pa.binary())})

    def measure(part: pa.Table, lent: pa.Table) -> pa.Table:
        held, known, out = own(part), {}, []
        for d, c in zip(lent.column("digest").to_pylist(), lent.column("chunk").to_pylist(), strict=True):
            held[d] = checked(d, zstandard.decompress(c))
        for i, n, key, digests in zip(*(part.column(c)[0].as_py() for c in ("doc_ids", "n_bytes", "keys", "lists")), strict=True):
            if key not in known:
                payload = b"".join(held[d] for d in digests)
                if _digest(payload) != key:
                    raise ValueError(f"medium {key.hex()} can't be put together")
                known[key] = measured(payload)
            out.append((i, n, *known[key]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in FACTS.split(", ")]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, lists, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = {d for x in lists for d in x}.difference(digests)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(wanted), pa.int64()), pa.array(sorted(wanted), pa.binary())], names=["block", "digest"])

    lacks = cut(found.select("block", "lists", "digests").mapInArrow(lacking, "block long, digest binary"))
    owners = found.select(F.col("block").alias("owner"), F.explode("digests").alias("digest"))
    wanted = owners.join(lacks.select("digest").distinct(), "digest").groupBy(F.col("owner").alias("block")).agg(F.collect_list("digest").alias("digests"))
    supply = found.select("block", "digests", "sizes", "pack").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(given, "digest binary, chunk binary")
    lent = lacks.join(supply, "digest").select("block", "digest", "chunk")
    return found.groupBy("block").cogroup(lent.groupBy("block")).applyInArrow(measure, FACTS)


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored medium, measured on what is read back."""
    path = f"{shared_dir(spark)}/lattica_media_{uuid.uuid4().hex}"
    store(table(spark, sf_dir, "documents"), path)
    known = cut(facts(spark, path))
    _dropped(spark, path, "chunks")
    discard(spark, path)
    return known

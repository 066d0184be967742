"""Token ids in ORC files, in ascending order of documents.

Texts are dealt into ranges of ids (the range bounds come from the ids alone, so that nothing
is encoded twice), sorted in their range and encoded as they are written. The integers go
through ORC's run-length encoding, each stripe has row indexes, and ids have Bloom filters;
so stripes are read in parallel and a lookup by id skips the stripes that can't hold it. Each
row has its range and the number of ids before it in its range. When the files are read back,
the ranges' sums, a row each, are added up to place every document in the whole sequence.

A text is cut into the pieces that the tokenizer's own pattern makes, which it encodes one by
one, so each piece is encoded once and then looked up; the lookup is emptied at a set size. A
text with characters that pattern libraries may class differently, or with the string of a
special token, is given to the tokenizer as a whole. As the library does by default, such a
string becomes the special token's id.

Nulls, ties and the like: a null text is empty and has the end id alone. Null ids come first.
Rows with the same id are ordered by a hash of their text, and equal rows follow each other. An
empty table makes a file without rows. Other columns of the input are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.plans.cut import shared_dir

END = 2
SCHEMA = "doc_id long, part int, ahead long, n_tokens long, ids array<int>"
#: Run-length encoding leaves little for a general codec to gain (a seventh), at a tenth of the time.
OPTIONS = {
    "compression": "none",
    "orc.stripe.size": str(64 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Pieces that a worker remembers at most, the length of those that stay when there are more,
#: words that are encoded in a row, and ids in a written batch, about.
REMEMBERED, SHORT = 1_000_000, 8
IN_A_ROW = 2000
BATCH_IDS = 1 << 20
#: The tokenizer's pattern for texts of ASCII and Latin letters, whose classes are written out
#: (which is faster) and whose commonest piece comes first, and what marks other texts.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PIECES = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+").findall
ODD = re.compile("[^\\n\\t\\r\\x20-\\x7e\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]").search
#: Ranges whose sums are broadcast at most; more are joined by shuffle.
BROADCAST_RANGES = 10_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        #: Bytes of each id: in a byte-level vocabulary a character stands for a byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces. Words after a space are set in a row, which the pattern parts again."""
        rows = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        rest = [p for p in pieces if not (p[0] == " " and p[1:].isalpha())]
        parts = [rows[i : i + IN_A_ROW] for i in range(0, len(rows), IN_A_ROW)]
        for part, made in zip(parts, self.library.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in part), np.int64, len(part)))
            at = 4 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1)
            raw, before = ids.tobytes(), 0
            for piece, end in zip(part, at.tolist(), strict=True):
                self.known[piece] = raw[before:end]
                before = end
        for piece, made in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(made.ids, "<u4").tobytes()

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if ODD(text) or any(s in text for s in self.special):
                yield self.whole(text)
                continue
            pieces = PIECES(text)
            if new := list(set(pieces).difference(self.known)):
                if len(self.known) + len(new) > REMEMBERED:
                    # Short pieces are the more frequent ones.
                    self.known = {k: v for k, v in self.known.items() if len(k) <= SHORT}
                    if len(self.known) + len(new) > REMEMBERED:
                        self.known.clear()
                    new = list(set(pieces).difference(self.known))
                self.learn(new)
            yield b"".join(map(self.known.__getitem__, pieces))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as they are written, in ranges of ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    last = np.array([end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ahead = encoder(tokenizer), TaskContext.get().partitionId(), 0

        def flush(ids: list, made: list[bytes]) -> pa.RecordBatch:
            nonlocal ahead
            sizes = np.array([len(x) // 4 for x in made], np.int64)
            ends = np.cumsum(sizes)
            values = np.frombuffer(b"".join(made), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(ahead + ends - sizes), pa.array(sizes), lists], names=["doc_id", "part", "ahead", "n_tokens", "ids"])
            ahead += int(ends[-1])
            return out

        for batch in batches:
            ids, made, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                made.append(text + last)
                size += len(text)
                if size >= 4 * BATCH_IDS:
                    yield flush(ids, made)
                    ids, made, size = [], [], 0
            if ids:
                yield flush(ids, made)

    return placed.mapInArrow(work, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as ORC token files under ``path``."""
    encoded(docs, tokenizer or default_tokenizer(), end, id_col, text_col).write.mode("overwrite").options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of token files with ``start``, the number of ids before them in the whole sequence.

    ``doc_ids`` is pushed down to the stripes' statistics and Bloom filters.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = F.broadcast(starts) if sums.count() <= BROADCAST_RANGES else starts
    found = rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))
    return found.join(starts, "part").select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by the CRC-32 of their little-endian unsigned 32-bit form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    path = f"{shared_dir(spark)}/lattica-tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return checksums(read(spark, path))

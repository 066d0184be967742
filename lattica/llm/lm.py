"""Language-model scores by a weighted backoff automaton.

The model is a trigram model, each order smoothed with the one below as a Dirichlet prior:
``p(w | uv) = (c(uvw) + k p(w | v)) / (c(uv) + k)``, ``p(w | v) = (c(vw) + k p(w)) / (c(v) + k)``
and ``p(w) = (c(w) + 1) / (N + V + 1)``. As an automaton: the root, each word (and the start of
a text) and each pair of words seen in training are states. A seen n-gram is an arc from the
state of its context, which carries its probability and leads to the state of its last two
words; a state has a failure arc to the state of the shorter context, which carries
``k / (c(context) + k)``. The root has an arc for each word, and one for all unseen words that
leads back to it. A text is read from left to right, from the start's state: where a state has
no arc for a token its failure arcs are followed until one has. Each state's arcs and failures
share out a probability of 1.

The model grows with the corpus, so no task and not the driver holds it. A task packs the
texts that it scans into blocks of bounded size, which are written once, as a table bucketed
by block, so that later rounds read them where they are. A block sends the 64-bit hash of each
distinct word and pair that it holds, with its count in training texts; the hashes of all
blocks meet in buckets (ranges of the hash, so they are even), counts are added up, and each
block gets the sums for its own keys back, in its own order. A pair that one block alone holds
is told so: what it is part of can't be anywhere else, and is counted already. So the next
round sends only the triples both of whose pairs are shared. Then each block has the counts of
all its n-grams in the corpus, builds the part of the automaton that its texts can reach, and
scores them. Counts are added up in a block before anything is sent, so a frequent word is one
entry a block. Two n-grams share a hash by chance with a probability of about n^2 / 2^64.

Nulls, ties and the like: a null text is empty and has the end token alone. A null id trains
(its checksum counts as that of an empty string). Rows that repeat get a row each and train
each time. A text longer than a block is a block of its own. Without training texts N and V
are zero and every token has probability 1 in the base score. An empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, table
from lattica.plans.cut import cut, discard, shared_dir

#: Weights of the priors of pairs and of triples, in tokens.
PRIORS = (200.0, 200.0)
#: Bytes of text in a block and to a bucket, about, and the most files that blocks are dealt to.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
MOST_FILES = 50_000
START, END = 0, 1
MESSAGE = "block long, bucket long, keys binary, counts binary"
TOTALS = "block long, bucket long, totals binary, tokens long, types long"
BLOCKS = "block long, doc_ids array<long>, trains array<boolean>, lengths binary, tokens binary, words binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, then zstd."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _follow(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    """A hash of two hashes in their order, with the lowest bit clear."""
    return _mix(_mix(a * np.uint64(factor)) + b) & ~np.uint64(1)


def numbered(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, tokens and hashes of the words. Words are numbered by first place; 0 is the start, 1 the end."""
    numbers: dict[bytes, int] = {}
    rows, lengths = [], []
    for text in texts:
        words = (text or b"").translate(LOWER).split()
        rows.append(np.fromiter((numbers.setdefault(w, len(numbers) + 2) for w in words), np.int64, len(words)))
        rows.append(np.array([END]))
        lengths.append(len(words) + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in numbers), np.uint64, len(numbers))
    return np.array(lengths, np.int64), np.concatenate(rows), hashes


class Block:
    """The n-grams of some texts, each known by its number in the block."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, trains: np.ndarray):
        self.lengths, self.tokens, self.trains = lengths, tokens, trains
        self.starts = np.cumsum(lengths) - lengths
        self.size = len(hashes) + 2
        self.words = np.concatenate([_mix(np.array([11, 12], np.uint64)), hashes])
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = START
        pairs, first, self.pair = np.unique(before * self.size + tokens, return_index=True, return_inverse=True)
        self.left, self.right = before[first], tokens[first]
        self.seen = np.repeat(trains, lengths)
        self.word_counts = np.bincount(tokens[self.seen], minlength=self.size)
        self.word_counts[START] = int(trains.sum())
        self.pair_counts = np.bincount(self.pair[self.seen], minlength=len(pairs))
        # The lowest bit tells words, which are counted, from all else.
        alone = _mix(self.words) | np.uint64(1)
        alone[START] ^= np.uint64(1)
        self.pair_keys = _follow(self.words[self.left], self.words[self.right], 0x9FB21C651E98DF25)
        self.keys = np.concatenate([alone, self.pair_keys])

    def triples(self) -> None:
        """Number the triples: their first pair, last word and last pair, counts and keys."""
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        _, first, which = np.unique(self.pair[at - 1] * self.size + self.tokens[at], return_index=True, return_inverse=True)
        self.context, self.word, self.onto = self.pair[at[first] - 1], self.tokens[at[first]], self.pair[at[first]]
        self.triple_counts = np.bincount(which[self.seen[at]], minlength=len(first))
        self.triple_keys = _follow(self.pair_keys[self.context], self.words[self.word], 0xD6E8FEB86659FD93)


class Automaton:
    """States and arcs that a block's texts can reach. State 0 is the root, 1 + w that of word
    ``w`` and 1 + size + p that of pair ``p``; a state that training hasn't seen is never reached."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, priors: tuple[float, float]):
        size = block.size
        self.size = size
        root = (words + 1) / (n + v + 1)
        after_word = (pairs + priors[0] * root[block.right]) / (words[block.left] + priors[0])
        after_pair = (triples + priors[1] * after_word[block.onto]) / (pairs[block.context] + priors[1])
        state_of_pair = 1 + size + np.arange(len(pairs))
        # The end has no state: nothing follows it.
        self.root_weight = np.log10(root)
        self.root_onto = np.where(words > 0, 1 + np.arange(size), 0)
        self.fail = np.concatenate([[0], np.zeros(size, np.int64), 1 + block.right])
        self.fail_weight = np.concatenate([[0.0], np.log10(priors[0] / (words + priors[0])), np.log10(priors[1] / (pairs + priors[1]))])
        p, t = pairs > 0, triples > 0
        arcs = np.concatenate([(1 + block.left[p]) * size + block.right[p], state_of_pair[block.context[t]] * size + block.word[t]])
        weight = np.log10(np.concatenate([after_word[p], after_pair[t]]))
        onto = np.concatenate([state_of_pair[p], state_of_pair[block.onto[t]]])
        order = np.argsort(arcs)
        # One arc more than any state has, so that a search never runs off the end.
        self.arcs = np.append(arcs[order], np.iinfo(np.int64).max)
        self.weight, self.onto = np.append(weight[order], 0.0), np.append(onto[order], 0)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes with its token, and what that weighs, failures included."""
        state, onto, weight = state.copy(), np.empty_like(state), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            at_root = state[todo] == 0
            done = todo[at_root]
            onto[done] = self.root_onto[token[done]]
            weight[done] += self.root_weight[token[done]]
            todo = todo[~at_root]
            key = state[todo] * self.size + token[todo]
            at = np.searchsorted(self.arcs, key)
            hit = self.arcs[at] == key
            onto[todo[hit]] = self.onto[at[hit]]
            weight[todo[hit]] += self.weight[at[hit]]
            todo = todo[~hit]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return onto, weight

    def read(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The weight of each text, all texts a token at a time."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.full(len(order), 1 + START), np.zeros(len(order))
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for at, k in enumerate(active.tolist()):
            state[:k], weight = self.step(state[:k], tokens[starts[:k] + at])
            total[:k] += weight
        out = np.empty_like(total)
        out[order] = total
        return out


def write_blocks(docs: DataFrame, name: str, path: str, id_col: str, text_col: str) -> int:
    """Texts as blocks in the table ``name``; the number of hash buckets that suits their bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("text"), (crc % 7 != 2).alias("trains"))

    def block(number: int, ids: list, texts: list[bytes], trains: list[bool]) -> pa.RecordBatch:
        lengths, tokens, words = numbered(texts)
        columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([trains], pa.list_(pa.bool_())), *(pa.array([pack(x)], pa.binary()) for x in (lengths, tokens, words))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "trains", "lengths", "tokens", "words"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, texts, trains = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            for i, text, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if texts and held + len(text) > BLOCK_BYTES:
                    yield block(number, ids, texts, trains)
                    number, held, ids, texts, trains = number + 1, 0, [], [], []
                ids.append(i)
                texts.append(text)
                trains.append(train)
                held += len(text)
        if texts:
            yield block(number, ids, texts, trains)

    files = min(MOST_FILES, max(1, -(-size // BLOCK_BYTES)))
    rows.mapInArrow(dealt, BLOCKS).write.bucketBy(files, "block").option("path", path).option("compression", "none").saveAsTable(name)
    return max(1, -(-size // BUCKET_BYTES))


def _read(part: pa.RecordBatch | pa.Table, row: int = 0) -> Block:
    lengths, tokens, words = (unpack(part.column(c)[row].as_py()) for c in ("lengths", "tokens", "words"))
    return Block(lengths.astype(np.int64), tokens.astype(np.int64), words, np.array(part.column("trains")[row].as_py(), bool))


def _messages(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    """Keys and counts in order of keys, a row for each bucket that has some."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    marks = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    at = [0, *np.searchsorted(keys, marks).tolist(), len(keys)]
    out = [(b, pack(np.diff(keys[i:j], prepend=np.uint64(0))), pack(counts[i:j])) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
    return {"block": pa.array([block] * len(out), pa.int64()), "bucket": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())}


def summed(asked: DataFrame, buckets: int) -> DataFrame:
    """``(block, bucket, totals, tokens, types)``: for each message the corpus counts of its keys,
    twice the count and one more where no other block holds the key; ``tokens`` and ``types`` of
    all training words of the bucket, in one of its rows."""

    def answer(part: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in part.column("keys").to_pylist()]
        counts = [unpack(x).astype(np.int64) for x in part.column("counts").to_pylist()]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)
        coded = 2 * totals + (np.bincount(where, minlength=len(every)) == 1)
        words = totals[every & np.uint64(1) == 1]
        ends = np.cumsum([len(k) for k in keys])
        out = [pack(coded[where[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
        once = lambda n: pa.array([int(n)] + [0] * (len(out) - 1), pa.int64())
        return pa.table({"block": part.column("block"), "bucket": part.column("bucket"), "totals": pa.array(out, pa.binary()), "tokens": once(words.sum()), "types": once((words > 0).sum())})

    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, TOTALS)


def _totals(keys: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts, and whether the block alone holds the key, in the order of ``keys``."""
    coded = np.empty(len(keys), np.int64)
    if len(keys):
        coded[np.argsort(keys, kind="stable")] = np.concatenate([unpack(x) for x in told.sort_by("bucket").column("totals").to_pylist()])
    return coded >> 1, (coded & 1).astype(bool)


def _shared(block: Block, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of words and pairs, and which triples can be in other blocks too."""
    totals, alone = _totals(block.keys, told)
    block.triples()
    lone = alone[block.size :]
    return totals[: block.size], totals[block.size :], ~(lone[block.context] | lone[block.onto])


def score(docs: DataFrame, priors: tuple[float, float] = PRIORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base score and model score, a row for each row of ``docs``."""
    spark = docs.sparkSession
    name = f"lattica_lm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = write_blocks(docs, name, path, id_col, text_col)
    blocks = spark.table(name)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _read(batch, row)
                counts = np.concatenate([block.word_counts, block.pair_counts])
                yield pa.RecordBatch.from_pydict(_messages(batch.column("block")[row].as_py(), block.keys, counts, buckets))

    def ask_triples(part: pa.Table, told: pa.Table) -> pa.Table:
        block = _read(part)
        _, _, shared = _shared(block, told)
        return pa.table(_messages(part.column("block")[0].as_py(), block.triple_keys[shared], block.triple_counts[shared], buckets))

    first = cut(summed(blocks.mapInArrow(ask, MESSAGE), buckets))
    whole = first.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    told = first.select("block", "bucket", "totals", F.lit(1).alias("round"))
    second = cut(summed(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask_triples, MESSAGE), buckets))

    def traverse(part: pa.Table, told: pa.Table) -> pa.Table:
        block = _read(part)
        rounds = np.array(told.column("round").to_pylist())
        words, pairs, shared = _shared(block, told.filter(pa.array(rounds == 1)))
        triples = block.triple_counts.astype(np.int64)
        triples[shared] = _totals(block.triple_keys[shared], told.filter(pa.array(rounds == 2)))[0]
        automaton = Automaton(block, words, pairs, triples, n, v, priors)
        add = lambda x: np.add.reduceat(x, block.starts)
        return pa.table({
            "doc_id": part.column("doc_ids")[0].values,
            "held_out": pa.array(~block.trains),
            "n_tokens": pa.array(block.lengths),
            "n_known": pa.array(add((words > 0)[block.tokens].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(block.starts), n, np.int64)),
            "base_score": pa.array(add(automaton.root_weight[block.tokens])),
            "score": pa.array(automaton.read(block.tokens, block.starts, block.lengths)),
        })

    both = told.unionByName(second.select("block", "bucket", "totals", F.lit(2).alias("round")))
    scored = cut(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(traverse, SCORES))
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    return scored


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probabilities of every document."""
    return score(table(spark, sf_dir, "documents"))

"""Spelling variants by an index of variable-length grams.

Words, with a mark at either end, are decomposed into grams of 2 to 4 characters, one from each
place. The dictionary of grams is pruned by frequency: a gram that is found at no more than
``RARE`` places is not extended, a more frequent one is. Whether a gram is extended depends on its
own characters alone, so one edit affects just the grams that hold its place, and the most that
any place is in is the word's bound on affected grams. A gram that outlives an edit to its right
keeps all that stands before it, too, and one that outlives an edit to its left all that follows.
So each gram is listed twice: by the beginning of the word up to the gram's end, and by the rest
of the word from its start. With g grams and a bound of b, one edit leaves all but g + b of these
2 g entries in both words; so of the g + b + 1 longest, which make the shortest lists, one is
common to both, and only these are indexed. Lists are merged: the words in a list that differ by
one character, on the side of the entry that the edit must be on, are paired, each pair in the
list of the longest entry that both have. A list of more than ``LIST`` words isn't held by a task:
its words meet by a shuffle, where they agree but for one character. Words of more than ``LONG``
characters are listed by their halves, one of which an edit leaves as it is.

Words are counted a document at a time, and counts added up before and after they are shuffled;
what follows grows with the distinct words. Frequent grams of 2 and 3 characters are told to all
tasks: there are at most ``92^2`` and ``92^3`` of them, whatever the data. Forms lead to words at
least twice as frequent, so that a root is found in a few rounds of looking two steps ahead.

Nulls, ties and the like: a null text has no words; a null id counts as an empty one. Very long
texts and words are read whole. Rows that repeat count each. Of near words with equal counts the
least in code-point order is the form. An empty table makes an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, table
from lattica.plans.cut import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of so many runs one loses a character; a word's least length and count.
DAMAGE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Places up to which a gram is rare, words in a list that a task holds, characters from which words are listed by halves, counts that a task holds.
RARE = 32
LIST = 50_000
LONG = 64
HELD = 200_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """``(word, n)``: runs of letters in lower case, of ``LEAST_LENGTH`` or more characters; with ``damage`` one of so many is misspelt."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for run, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
                    if len(run) < LEAST_LENGTH:
                        continue
                    if damage and (h := zlib.crc32(run.encode(), seed)) % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    total[run] += n
                if len(total) > HELD:
                    yield told()
        yield told()

    counts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_grams(words: DataFrame) -> frozenset[str]:
    """The grams of 2 and 3 characters that are found at more than ``RARE`` places: those that are extended."""
    letters = words.select(F.regexp_extract_all(F.concat(F.lit("^"), "word", F.lit("$")), F.lit("(?s)."), F.lit(0)).alias("c"))
    both = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.array(F.concat(F.get("c", i), F.get("c", i + 1)), F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2))))
    each = letters.select(F.explode(F.flatten(both)).alias("gram")).where("gram is not null")
    return frozenset(r["gram"] for r in each.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("gram").collect())


def gram_ends(marked: str, frequent: frozenset[str]) -> list[int]:
    """Where the gram from each place of a word ends: behind the first 2 to 4 characters that aren't frequent."""
    out = []
    for at in range(len(marked) - 1):
        end = at + 2
        while end < min(at + 4, len(marked)) and marked[at:end] in frequent:
            end += 1
        out.append(end)
    return out


def bound(ends: list[int]) -> int:
    """The most grams that one edit can affect: that hold one place."""
    return max(sum(ends[k] > at for k in range(max(0, at - 3), min(at + 1, len(ends)))) for at in range(len(ends) + 1))


def entries(word: str, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """``(side, length)`` of the entries that a word is indexed by: so much of its beginning (side 0) or end (1), marks included."""
    marked = f"^{word}$"
    ends = gram_ends(marked, frequent)
    every = [(-end, 0) for end in ends] + [(at - len(marked), 1) for at in range(len(ends))]
    longest = sorted(every)[: len(ends) + bound(ends) + 1]
    return [(side, -n) for n, side in sorted(set(longest)) if -n < len(marked)]


def index(words: DataFrame) -> DataFrame:
    """``(key, side, length, word, longer)``: an entry's hash, and the next longer entry of the word on that side."""
    frequent = frequent_grams(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column(0).to_pylist():
                marked, longer = f"^{word}$", [0, 0]
                for side, n in entries(word, frequent):
                    part = marked[-n:] if side else marked[:n]
                    rows.append((xxhash.xxh64_intdigest(part.encode(), side) - (1 << 63), side, n, word, longer[side]))
                    longer[side] = n
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 20_000], strict=True), INDEX.types, strict=True)], schema=INDEX)

    INDEX = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("length", pa.int32()), ("word", pa.string()), ("longer", pa.int32())])
    return words.select("word").mapInArrow(work, "key long, side int, length int, word string, longer int")


def paired(side: int, length: int, words: dict[str, int]) -> set[tuple[str, str]]:
    """The pairs in a list of ``words``, by their next longer entries, that one edit outside the entry makes equal, but for those that meet in a longer entry's list."""
    out: set[tuple[str, str]] = set()
    rest: dict[tuple[int, str], list[str]] = {}
    for w, longer in words.items():
        n = len(w)
        for i in range(length - 1, n) if not side else range(n - length + 1):
            less = w[:i] + w[i + 1 :]
            agree = (n - i - 1 if side else i) + 1  # of the entry's characters, with its mark
            if less in words and not (longer == words[less] and 0 < longer <= agree):
                out.add((less, w) if less < w else (w, less))
            same = rest.setdefault((i, less), [])
            for x in same:
                if not (longer == words[x] and 0 < longer <= agree):
                    out.add((x, w) if x < w else (w, x))
            same.append(w)
    return out


def merged_lists(entries_of: DataFrame) -> DataFrame:
    """``(a, b, key)``: the pairs of each list; or, of a list of more than ``LIST``, each word as ``a`` without ``b``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, held, many = None, {}, False

        def close() -> None:
            if now is not None and len(held) > 1:
                made.extend((a, b, None) for a, b in paired(*now[1:], held))

        def told() -> pa.RecordBatch:
            a, b, k = zip(*made, strict=True) if made else ((), (), ())
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(k, pa.int64())], names=["a", "b", "key"])

        for batch in batches:
            for key, side, length, word, longer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now != (key, side, length):
                    if not many:
                        close()
                    now, held, many = (key, side, length), {}, False
                if many:
                    made.append((word, None, key))
                else:
                    held[word] = longer
                    if len(held) > LIST:
                        made.extend((w, None, key) for w in held)
                        held, many = {}, True
                if len(made) >= 20_000:
                    yield told()
        if not many:
            close()
        yield told()

    order = ["key", "side", "length"]
    return entries_of.repartition(*order).sortWithinPartitions(*order).mapInArrow(work, "a string, b string, key long")


def halves() -> Column:
    """The first and the last half of a word, and of one that is a character shorter."""
    n = F.length("word")
    ends = lambda m: [F.struct(m.alias("m"), F.lit(0).alias("side"), F.xxhash64(F.substring("word", F.lit(1), F.floor(m / 2).cast("int"))).alias("h")), F.struct(m.alias("m"), F.lit(1).alias("side"), F.xxhash64(F.substring("word", n - F.floor(m / 2).cast("int") + 1, n)).alias("h"))]
    return F.array(*ends(n - 1), *ends(n))


def met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(a, b)``, a < b: the words of ``rows`` that agree in ``keys`` and are one edit apart."""
    a, b = rows.select(*keys, F.col("word").alias("a")), rows.select(*keys, F.col("word").alias("b"))
    one = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, keys).where("a < b").where(one).select("a", "b")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of ``words (word)``: words that one inserted, deleted or replaced character makes equal."""
    found = cut(merged_lists(index(words.where(F.length("word") <= LONG + 1))))
    n = F.length("word")
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n)))
    many = found.where("b is null").select("key", F.col("a").alias("word")).distinct()
    parted = many.withColumn("variant", F.explode(F.array_distinct(F.concat(F.array("word"), less))))
    long = words.where(F.length("word") > LONG).select("word", F.explode(halves()).alias("k")).select("word", "k.*")
    pairs = found.where("b is not null").select("a", "b").unionByName(met(parted, ["key", "variant"])).unionByName(met(long, ["m", "side", "h"]))
    return pairs.distinct()


def variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``words (word, n)``."""
    words = cut(words)
    pairs = cut(near_pairs(words.select("word")))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    sized = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    near = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    twice = -F.col("best.m") >= 2 * F.col("n")
    formed = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(twice, F.col("best.other")).alias("form"), F.when(twice, -F.col("best.m")).alias("form_n")))
    ahead = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(ahead.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return formed.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents and the forms they are variants of."""
    return variants(count_words(table(spark, sf_dir, "documents")))


#: The unsigned crc32 of a list of bytes ``{b}``, by the table ``crc (t)``.
CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_concat([4294967295], {b}), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295)"


def oracle() -> str:
    """DuckDB SQL for ``op13_spelling``, by deletions in place of grams: of the same character in words of one length, or of one in the longer word."""
    points = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195, ord(ch)::BIGINT - 64] END))"
    return f"""WITH RECURSIVE {CRC_TABLE}, r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY 1, 2),
h AS (SELECT run, c, {CRC.format(b=points)} AS h FROM r, crc), d AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
v AS (SELECT word, word AS v, -1 AS i FROM w UNION ALL SELECT word, left(word, i::INT) || substr(word, i::INT + 2), i FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS MATERIALIZED (SELECT DISTINCT x.word AS a, y.word AS b FROM v x JOIN v y ON x.v = y.v AND x.word <> y.word AND (x.i = y.i OR x.i < 0 OR y.i < 0)),
s AS (SELECT a AS word, count(*) AS n_near, max(n) AS m FROM p JOIN w ON w.word = b GROUP BY 1), b AS (SELECT s.word, n_near, m, min(b) AS other FROM s JOIN p ON p.a = s.word JOIN w ON w.word = p.b AND w.n = m GROUP BY 1, 2, 3),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL), e AS (SELECT word, arg_max(root, k) AS root FROM c GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN e USING (word)"""

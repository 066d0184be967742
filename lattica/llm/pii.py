"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers in every whole
text. They are the seeds. What stands beside an instance are its patterns: the word and the two
words before it, and those after it, in small letters. A pattern's confidence in a kind is the
share of its places in the whole corpus that have an instance of the kind beside them, weighted
by the instances' own confidence, so that common words, which stand anywhere, get next to none;
it needs several instances. Candidates are loose forms of each kind that no
base rule took (addresses written with "at" and "dot", numbers of four parts, runs of 13 to 19
digits, numbers that look dialled) and, for every kind, any other word that holds a digit or an
``@``. A value's confidence is that at least one of the different patterns beside it speaks
truly; how often it stands beside one of them doesn't matter. Patterns and instances are scored
in turn, seeds staying at 1. Values that reach a threshold are instances from then on and
induce patterns of their own; the rounds end when no value is added. Confidences only grow, so
they do end. Values found become spans; base spans always stay.

Positions come from the texts' own pieces: what stands between matches and the matches
themselves, whose lengths add up. Only rows with a digit, an ``@`` or a word for them are looked
into, and only contexts and counts are shuffled, never texts. Places are counted for words that
can be patterns alone, before anything is shuffled where those are few.

Nulls, ties and the like: a null text is empty and has no spans. Rows that repeat get a row
each and the same spans. A null id keeps its row. Matches of different kinds may overlap; of
one kind they can't, except that spans the method adds are those that don't overlap a base
span of any kind; a word that could be of several kinds is of the likeliest, and then of the
first. An empty table gives an empty result. ``redact`` carries all other columns, whatever
their names, and masks every character of a span once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import apart, ascii_lower, flat, nested, table
from lattica.plans.cut import cut

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns. Groups are possessive, so that no input runs Java's matcher out of
#: stack, and a match begins at the head of its run of characters or where the last one ended,
#: so that a long run is read once; both find the same matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose forms, which count only with patterns of high confidence.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,64}+(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,64}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+\.[0-9]{1,4}+\.[0-9]{1,4}+\.[0-9]{1,4}+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])[(]?[0-9](?:[\x20().-]?[0-9]){7,14}+(?![0-9A-Za-z])",
}
#: What else can be personal data of any kind: a word that holds a digit or an ``@``.
WORDLIKE = r"(?<![^\x20\x09-\x0D\"'(\[<,;:])[^\x20\x09-\x0D\"'()\[\]<>,;:@0-9]*+[@0-9][^\x20\x09-\x0D\"'()\[\]<>,;:]*(?<![.!?])"
ANY = len(KINDS)
#: A pattern counts from so many instances, and a candidate is one from this confidence.
LEAST_SEEDS = 5
CONFIDENT = 0.8
#: Characters of a context that are looked at first.
NEAR = 160
#: So many rows of added spans, or of patterns, are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 20_000
_SPAN = "array<struct<kind:int,start:long,end:long,value:string,left:array<string>,right:array<string>>>"


def _add(a: Column, b: Column) -> Column:
    return a + b


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(lengths: Column) -> Column:
    """For each place of an array of longs the sum of what stands before it.

    Blocks of 64 are added up first, so that the work grows as n^1.5 at n below 4096 and as
    n^2 / 64 beyond, on an array that holds a row's matches alone.
    """
    zero, block = F.lit(0).cast("long"), lambda i: F.floor(i / 64).cast("int")
    heads = F.transform(F.sequence(F.lit(0), block(F.size(lengths))), lambda b: F.aggregate(F.slice(lengths, b * 64 + 1, F.lit(64)), zero, _add))
    ahead = _once(heads, lambda h: F.transform(h, lambda _, b: F.aggregate(F.slice(h, F.lit(1), b), zero, _add)))
    within = lambda i: F.aggregate(F.slice(lengths, block(i) * 64 + 1, i % 64), zero, _add)
    return _once(ahead, lambda a: F.transform(lengths, lambda _, i: F.get(a, block(i)) + within(i)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth), F.lit(0), _add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """What a base match must hold besides its pattern."""
    n = F.length(_digits(value))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _beside(piece: Column, last: bool) -> Column:
    """Patterns of a context: the word next to an instance and the next two, in small letters.

    The end of a long context will do where it has two whole words.
    """
    near = F.right(piece, F.lit(NEAR)) if last else F.left(piece, F.lit(NEAR))
    two = r"\s\S++\s++\S++\s*+$" if last else r"^\s*+\S++\s++\S++\s"
    some = F.when(F.length(piece) <= NEAR, piece).when(near.rlike(two), near).otherwise(piece)
    words = F.array_remove(F.split(ascii_lower(some), "[\\x20\\x09-\\x0D]+"), "")
    side, order = ("l", (-2, -1)) if last else ("r", (1, 2))
    next_one = lambda w: F.concat(F.lit(side), F.element_at(w, order[1] if last else order[0]))
    next_two = lambda w: F.concat(F.lit(side), F.element_at(w, order[0]), F.lit(" "), F.element_at(w, order[1]))
    return _once(words, lambda w: F.when(F.size(w) > 1, F.array(next_one(w), next_two(w))).when(F.size(w) > 0, F.array(next_one(w))).otherwise(F.array().cast("array<string>")))


def _with_kind(df: DataFrame, text: str, k: int, pattern: str, base: bool) -> DataFrame:
    """``df`` with the spans of one kind in ``_s{k}``."""
    df = df.withColumns({"_p": F.when(F.col(text).isNotNull(), F.split(text, pattern, -1)), "_v": F.when(F.col(text).isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))})
    df = df.withColumn("_n", F.transform("_v", lambda v, i: (F.length(F.get("_p", i)) + F.length(v)).cast("long")))
    df = df.withColumn("_b", F.when(F.size("_n") > 0, _sums(F.col("_n"))))

    def span(v: Column, i: Column) -> Column:
        start = F.get("_b", i) + F.length(F.get("_p", i))
        sides = [_beside(F.get("_p", i), True).alias("left"), _beside(F.get("_p", i + 1), False).alias("right")]
        return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), *sides)

    spans = F.transform("_v", span)
    if base:
        spans = F.filter(spans, lambda s: _valid(KINDS[k], s["value"]))
    return df.withColumn(f"_s{k}", F.coalesce(F.when(F.size("_v") > 0, spans), F.array().cast(_SPAN))).drop("_p", "_v", "_n", "_b")


def _with_spans(df: DataFrame, text: str, patterns: list[str], out: str, base: bool, first: int = 0) -> DataFrame:
    """``df`` with an array of spans of all kinds from ``first`` on, in order of kind and start."""
    for k, pattern in enumerate(patterns, first):
        df = _with_kind(df, text, k, pattern, base)
    made = [f"_s{k}" for k in range(first, first + len(patterns))]
    return df.withColumn(out, F.concat(*made)).drop(*made)


def _free(spans: str, taken: str) -> Column:
    """Those of ``spans`` that overlap none of ``taken``."""
    return F.filter(spans, lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def with_base(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``df`` with ``_base`` (spans), ``_loose`` (candidates) and ``_key`` (of rows that have any)."""
    some = df.withColumn("_text", F.when(text.rlike("[0-9@]"), text))
    some = _with_spans(some, "_text", [BASE[k] for k in KINDS], "_base", True)
    some = _with_spans(some, "_text", [WORDLIKE], "_words", False, ANY)
    some = some.withColumn("_text", F.when(text.rlike(r"[0-9]|[\x20\[({](?:at|dot)[\x20\])}]"), text))
    some = _with_spans(some, "_text", [LOOSE[k] for k in KINDS], "_loose", False)
    some = some.withColumn("_loose", _free("_loose", "_base"))
    some = some.withColumn("_taken", F.concat("_base", "_loose")).withColumn("_words", F.filter("_words", lambda w: F.length(w["value"]) > 3))
    some = some.withColumn("_loose", F.concat("_loose", _free("_words", "_taken")))
    any_of = (F.size("_base") > 0) | (F.size("_loose") > 0)
    key = F.md5(F.concat_ws("\x01", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return some.withColumn("_key", F.when(any_of, key)).drop("_text", "_words", "_taken")


def contexts(base: DataFrame) -> DataFrame:
    """``(key, kind, start, end, value, seed, pattern)``, a row for each pattern beside an instance.

    A word that can be of any kind has rows for each.
    """
    marked = lambda column, seed: F.transform(column, lambda s: F.struct(s.alias("s"), F.lit(seed).alias("seed")))
    each = base.where("_key is not null").select(F.col("_key").alias("key"), F.explode(F.concat(marked("_base", True), marked("_loose", False))).alias("x"))
    kinds = F.when(F.col("x.s.kind") == ANY, F.sequence(F.lit(0), F.lit(ANY - 1))).otherwise(F.array("x.s.kind"))
    flat = each.select("key", F.explode(kinds).alias("kind"), "x.s.start", "x.s.end", F.sha2(F.col("x.s.value"), 256).alias("value"), "x.seed", F.concat("x.s.left", "x.s.right").alias("patterns"))
    return flat.select("key", "kind", "start", "end", "value", "seed", F.explode("patterns").alias("pattern")).distinct()


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def places(docs: DataFrame, wanted: DataFrame, rows: int, text_col: str = "text") -> DataFrame:
    """``(words, places)``: how often each of ``wanted (words)`` stands in all texts; a word, or two with a space."""
    split = F.array_remove(F.split(ascii_lower(F.col(text_col)), "[\\x20\\x09-\\x0D]+"), "")
    worded = docs.select(split.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.xxhash64(F.concat_ws(" ", x, F.get("w", i + 1))))
    hashes = worded.select(F.explode(F.concat(F.transform("w", lambda x: F.xxhash64(x)), pairs)).alias("h"))
    known = wanted.select("words", F.xxhash64("words").alias("h"))
    counted = hashes.join(_few(known.select("h").distinct(), rows), "h", "left_semi").groupBy("h").agg(F.count("*").alias("places"))
    return known.join(counted, "h").select("words", "places")


def discover(docs: DataFrame, base: DataFrame, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT, text_col: str = "text") -> DataFrame:
    """``(key, extra)``: the spans that the patterns add, by the key of a row's id and text."""
    graph = cut(contexts(base))
    name = ["kind", "pattern"]
    links = graph.groupBy(*name, "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    # A pattern can come to count if it stands beside enough instances, and matters if one is a candidate.
    able = cut(links.groupBy(*name).agg(F.sum("n").alias("n"), F.min("seed").alias("settled")).where((F.col("n") >= least_seeds) & ~F.col("settled")).select(*name))
    n_able = able.count()
    if not n_able:
        return graph.where(F.lit(False)).select("key", F.array().cast(_SPAN).alias("extra"))
    words = able.select(F.substring("pattern", F.lit(2), F.length("pattern")).alias("words")).distinct()
    known = able.withColumn("words", F.substring("pattern", F.lit(2), F.length("pattern"))).join(places(docs, words, n_able, text_col), "words")
    links = cut(links.join(_few(known.select(*name, "places"), n_able), name).withColumn("conf", F.col("seed").cast("double")))
    before = -1
    while (now := links.where((F.col("conf") > 0) & ~F.col("seed")).select("kind", "value").distinct().count()) > before:
        before = now
        support = F.sum(F.col("conf") * F.col("n"))
        told = links.groupBy(*name).agg(support.alias("support"), (support / F.greatest(F.max("places"), F.sum("n"))).alias("trust")).where(F.col("support") >= least_seeds)
        heard = links.join(_few(told, n_able), name).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-12)))))).alias("by"))
        links = cut(links.join(heard, ["kind", "value"], "left").select(*name, "value", "n", "seed", "places", F.when(F.col("seed"), 1.0).when(F.col("by") >= confident, F.col("by")).otherwise(0.0).alias("conf")))
    sure = links.where((F.col("conf") > 0) & ~F.col("seed")).groupBy("kind", "value").agg(F.max("conf").alias("conf"))
    found = graph.where(~F.col("seed")).select("key", "kind", "start", "end", "value").distinct().join(sure, ["kind", "value"])
    best = found.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"))
    none = F.array().cast("array<string>")
    spans = best.select("key", F.struct("kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("").alias("value"), none.alias("left"), none.alias("right")).alias("s"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list("s")).cast(_SPAN).alias("extra"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), k + 1)
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("k"), s["start"].alias("s"), s["end"].alias("e"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")


def attach(base: DataFrame, extra: DataFrame) -> DataFrame:
    """``base`` with all spans of a row in ``_all``. Rows without a key meet no shuffle."""
    extra = cut(extra.withColumnRenamed("key", "_key"))
    none, n = F.array().cast(_SPAN), extra.count()
    if not n:
        return base.withColumn("_all", F.col("_base"))
    if n <= BROADCAST_ROWS:
        told = base.join(F.broadcast(extra), "_key", "left")
    else:
        told = apart(base, F.col("_key").isNotNull()).join(extra, "_key", "left").unionByName(apart(base, F.col("_key").isNull()).withColumn("extra", none))
    return told.withColumn("_all", F.concat("_base", F.coalesce("extra", none)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = cut(with_base(docs, F.col("doc_id"), F.col("text")).drop("text"))
    whole = attach(base, discover(docs, base))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return whole.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with ``<KIND>`` in place of what spans cover; spans that overlap are one, of the first one's kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), (-s["end"]).alias("e"), s["kind"].alias("k"))))
    reach = lambda o, i: F.coalesce(-F.array_min(F.transform(F.slice(o, F.lit(1), i), lambda y: y["e"])), F.lit(0).cast("long"))
    # A span that begins before the end of those before it goes into their mask.
    cut_up = _once(order, lambda o: F.transform(o, lambda x, i: F.struct(reach(o, i).alias("from"), x["s"].alias("s"), x["k"].alias("k"))))
    heads = F.filter(cut_up, lambda x: x["s"] >= x["from"])
    name = lambda k: F.element_at(F.array(*(F.lit(f"<{x.upper()}>") for x in KINDS)), k + 1)
    pieces = F.transform(heads, lambda x: F.concat(F.substring(text, (x["from"] + 1).cast("int"), (x["s"] - x["from"]).cast("int")), name(x["k"])))
    tail = F.substring(text, (F.array_max(F.transform(order, lambda x: -x["e"])) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` masked; other columns as they are, ``n_chars`` made anew."""
    based = with_base(nested(docs), F.col("_doc.doc_id"), F.col("_doc.text"))
    told = attach(based, discover(docs.select("text"), cut(based.select("_key", "_base", "_loose"))))
    masked = told.withColumn("_new", _masked(F.col("_doc.text"), F.col("_all")))
    return flat(masked, docs.columns, text=F.col("_new"), n_chars=F.length("_new").cast("long"))

"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Each text gets counts (words, symbols, repeated lines, repeated word windows). A fixed base
rule rejects short and repetitive texts. The rest is held against others of its language and
source: the counts become a vector of variance-stabilised shares, its centre and scatter are
estimated by the minimum covariance determinant (MCD), and vectors too far out by Mahalanobis
distance are rejected.

MCD by concentration steps: every step measures all rows, keeps the nearest ``SUPPORT`` of a
group and estimates anew from those. Distances are put into narrow bins, and a step adds up
moments for each (group, start, bin) before anything is shuffled; the nearest bins make the next
estimate, the last of them in the part that fills the support. So a step is one pass, rows are
never sorted, no task gets a group's rows, and the result doesn't depend on how rows are dealt.
Steps lead to the next low determinant alone, so they begin at four starts and the least
determinant that any ends at is the estimate: medians and quartile ranges (by bins as well),
mean and covariance, and medians with the correlations of hyperbolic tangents and of spatial
signs. The scatter has a least width for each coordinate added (a regularised MCD), since most
shares are zero in most texts.

Nulls, ties and the like: a null text has no words and fails; a null language or source
counts as an empty one. Groups with fewer than ``LEAST_GROUP`` texts that passed the base
rule use the estimate of the language, and languages with fewer that of all texts; these rest
on all texts of the language, or of the table, that passed, not on the small groups' alone. Rows that
repeat or tie get the same verdict. An empty table gives an empty result. ``keep_good`` carries
all columns of the input through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import apart, flat, nested, table
from lattica.plans.cut import cut, written

SPACE = "[\\x20\\x09-\\x0D]+"
#: Share of a group that an estimate rests on.
SUPPORT = 0.75
LEAST_GROUP = 50
STEPS = 20
#: Least width of each coordinate, on its transformed scale.
WIDTHS = (0.03, 0.08, 0.2, 0.2)
#: Probability that a text of a Gaussian group is rejected.
TAIL = 1e-6
#: An estimate table of at most so many groups is broadcast; a larger one is joined by shuffle.
BROADCAST_GROUPS = 20_000
DIM = len(WIDTHS)
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_tail(x: float, dim: int) -> float:
    """P(chi-squared > x) for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dim // 2))


def chi2_cut(tail: float, dim: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dim) > tail else (low, mid)
    return high


#: The scatter of the nearest SUPPORT of a Gaussian is too small by this factor.
CONSISTENCY = SUPPORT / (1 - chi2_tail(chi2_cut(1 - SUPPORT, DIM), DIM + 2))


def with_stats(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """``docs`` with the five counts of each whole text and ``base_failed``, all prefixed by ``_``."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    worded = docs.withColumns({"_words": F.array_remove(F.split(text, SPACE), ""), "_lines": lines})
    n = F.size("_words")
    # A window's hash stands for it; two windows of one text share a 64-bit hash by chance
    # about once in 10^8 texts of a million words.
    windows = F.when(n >= 3, F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    hashed = worded.withColumn("_windows", windows)
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = hashed.withColumn("_ordered", F.when(some, ordered))
    alike = F.filter("_ordered", lambda x, i: (x["h"] == F.get("_ordered", i - 1)["h"]) | (x["h"] == F.get("_ordered", i + 1)["h"]))
    starts = placed.withColumn("_at", F.array_sort(F.transform(alike, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    counted = starts.withColumns({
        "_n_words": n.cast("long"),
        "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "_n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    })
    kept = counted.drop("_words", "_lines", "_windows", "_ordered", "_at")
    return kept.withColumn("_base_failed", (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words")))


def _vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)))
    length = F.log(F.greatest(F.col("_word_chars"), F.lit(1)).cast("double") / F.greatest(F.col("_n_words"), F.lit(1)))
    return [share("_n_symbols", "_word_chars"), length, share("_n_dup_lines", "_n_lines"), share("_n_repeat_words", "_n_words")]


def with_vector(stats: DataFrame, lang: Column | None = None, source: Column | None = None) -> DataFrame:
    lang, source = (F.coalesce(F.col(n) if c is None else c, F.lit("")) for n, c in (("lang", lang), ("source", source)))
    return stats.withColumns({f"_x{i}": v for i, v in enumerate(_vector())} | {"_lang": lang, "_source": source})


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def with_distance(df: DataFrame) -> DataFrame:
    """``df`` with the squared Mahalanobis distance, by forward substitution through the Cholesky factor."""
    for i in range(DIM):
        rest = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        df = df.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
    far = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, DIM)), F.col("_y0") * F.col("_y0"))
    return df.withColumn("_distance", far)


_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _scatter(n: Column) -> dict[str, Column]:
    """Means and scatter from sums ``_s`` and products ``_q`` of ``n`` rows."""
    mean = {i: F.col(f"_s{i}") / n for i in range(DIM)}
    spread = {(i, j): F.col(f"_q{i}{j}") / n - mean[i] * mean[j] for i, j in _PAIRS}
    return {f"_m{i}": m for i, m in mean.items()} | {f"_v{i}{j}": F.greatest(v, F.lit(0.0)) if i == j else v for (i, j), v in spread.items()}


def _factored(df: DataFrame) -> DataFrame:
    """``df`` with the Cholesky factor of the scatter ``_v``, least widths added, and half its log determinant."""
    for i, j in _PAIRS:
        rest = F.col(f"_v{i}{j}") + F.lit(WIDTHS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        df = df.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"_l{j}{j}"))
    size = sum((F.log(F.col(f"_l{i}{i}")) for i in range(1, DIM)), F.log("_l00"))
    return df.select("_key", "_start", *(f"_m{i}" for i in range(DIM)), *(f"_l{i}{j}" for i, j in _PAIRS), size.alias("_size"))


def keys_of(stats: DataFrame) -> DataFrame:
    """``(_lang, _source, _key)``: which estimate the texts of a language and source use."""
    sizes = stats.where(~F.col("_base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    whole = sizes.withColumn("_in_lang", F.sum("_n").over(Window.partitionBy("_lang")))
    own = F.concat(F.lit("s:"), "_lang", F.lit("\x01"), "_source")
    key = F.when(F.col("_n") >= LEAST_GROUP, own).when(F.col("_in_lang") >= LEAST_GROUP, F.concat(F.lit("l:"), "_lang")).otherwise("*")
    return whole.select("_lang", "_source", key.alias("_key"))


def feeds_of(keys: DataFrame) -> DataFrame:
    """``(_lang, _source, _keys)``: the estimates that the texts of a language and source go into.

    Those are their own and, where some group uses it, the language's and that of all texts.
    """
    of_lang, whole = F.concat(F.lit("l:"), "_lang"), not keys.where("_key = '*'").isEmpty()
    used = F.max((F.col("_key") == of_lang).cast("int")).over(Window.partitionBy("_lang")) == 1
    into = [F.when(F.col("_key").startswith("s:"), F.col("_key")), F.when(used, of_lang), F.when(F.lit(whole), F.lit("*"))]
    return keys.select("_lang", "_source", F.array_compact(F.array(*into)).alias("_keys"))


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Keys, estimates (a row for each key) and the number of keys' rows.

    ``stats`` is read once a step: pass a table that is already computed.
    """
    keys = cut(keys_of(stats))
    n_keys = keys.count()
    passed = stats.where(~F.col("_base_failed")).select("_lang", "_source", *(f"_x{i}" for i in range(DIM)))
    rows = cut(passed.join(_small(feeds_of(keys), n_keys), ["_lang", "_source"]).select(F.explode("_keys").alias("_key"), *(f"_x{i}" for i in range(DIM))))
    params, before = cut(_factored(starts(rows, n_keys))), None
    for _ in range(STEPS):
        far = with_distance(rows.join(_small(params, 4 * n_keys), "_key")).withColumn("_bin", F.floor(32 * F.log1p("_distance")))
        parts = far.groupBy("_key", "_start", "_bin").agg(F.count("*").cast("double").alias("_c"), *_moments({i: F.col(f"_x{i}") for i in range(DIM)}))
        own = Window.partitionBy("_key", "_start")
        room = parts.withColumns({"_ahead": F.sum("_c").over(own.orderBy("_bin")) - F.col("_c"), "_all": F.sum("_c").over(own)})
        part = F.least(F.lit(1.0), (SUPPORT * F.col("_all") - F.col("_ahead")) / F.col("_c"))
        near = room.where(F.col("_ahead") < SUPPORT * F.col("_all")).groupBy("_key", "_start").agg(*(F.sum(F.col(c) * part).alias(c) for c in ["_c", *_NAMES]))
        found = near.withColumns(_scatter(F.col("_c"))).withColumns({f"_v{i}{j}": CONSISTENCY * F.col(f"_v{i}{j}") for i, j in _PAIRS})
        params = cut(_factored(found))
        now = params.agg(F.sum("_size").alias("d")).first()["d"]
        if now is None or before is not None and abs(now - before) <= 1e-9 * max(1.0, abs(now)):
            break
        before = now
    least = params.groupBy("_key").agg(F.min_by(F.struct(*params.columns[1:]), F.struct(F.round("_size", 9), "_start")).alias("p"))
    return keys, cut(least.select("_key", "p.*")), n_keys


_NAMES = [*(f"_s{i}" for i in range(DIM)), *(f"_q{i}{j}" for i, j in _PAIRS)]


def _moments(x: dict[int, Column], head: str = "_") -> list[Column]:
    return [*(F.sum(x[i]).alias(f"{head}s{i}") for i in range(DIM)), *(F.sum(x[i] * x[j]).alias(f"{head}q{i}{j}") for i, j in _PAIRS)]


def starts(rows: DataFrame, n_keys: int) -> DataFrame:
    """``(_key, _start, _m.., _v..)``: four first estimates for each key."""
    fine = 256
    long = rows.select("_key", F.posexplode(F.array(*(F.col(f"_x{i}") for i in range(DIM)))).alias("_axis", "_x"))
    bins = long.groupBy("_key", "_axis", F.floor(F.col("_x") * fine).alias("_bin")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_key", "_axis")
    ranked = bins.withColumns({"_upto": F.sum("_n").over(by.orderBy("_bin")), "_all": F.sum("_n").over(by)})
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_bin") + F.lit(0.5))) / fine
    marks = ranked.groupBy("_key", "_axis").agg(at(0.25).alias("_a"), at(0.5).alias("_m"), at(0.75).alias("_b"))
    pick = lambda i, c: F.max(F.when(F.col("_axis") == i, c))
    wide = lambda i: F.sqrt(F.pow(pick(i, F.col("_b") - F.col("_a")) / 1.349, F.lit(2)) + WIDTHS[i] ** 2)
    centre = cut(marks.groupBy("_key").agg(*(pick(i, F.col("_m")).alias(f"_m{i}") for i in range(DIM)), *(wide(i).alias(f"_d{i}") for i in range(DIM))))
    x = {i: F.col(f"_x{i}") for i in range(DIM)}
    z = {i: (F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_d{i}") for i in range(DIM)}
    norm = F.greatest(F.sqrt(sum((z[i] * z[i] for i in range(1, DIM)), z[0] * z[0])), F.lit(1e-9))
    placed = rows.join(_small(centre, n_keys), "_key").withColumns({f"_z{i}": z[i] for i in range(DIM)} | {"_r": norm})
    tanh, sign = {i: F.tanh(f"_z{i}") for i in range(DIM)}, {i: F.col(f"_z{i}") / F.col("_r") for i in range(DIM)}
    sums = placed.groupBy("_key").agg(F.count("*").cast("double").alias("_c"), *_moments(x), *_moments(tanh, "_t"), *_moments(sign, "_g"))
    whole = cut(sums.join(_small(centre, n_keys), "_key"))
    middle = [F.col(f"_m{i}") for i in range(DIM)]

    def start(number: int, means: list[Column], scatter) -> DataFrame:
        return whole.select("_key", F.lit(number).alias("_start"), *(m.alias(f"_m{i}") for i, m in enumerate(means)), *(scatter(i, j).alias(f"_v{i}{j}") for i, j in _PAIRS))

    def related(head: str):
        """Correlations of transformed coordinates, at the quartile widths."""
        power = lambda i: F.greatest(F.col(f"{head}q{i}{i}"), F.lit(1e-12))
        return lambda i, j: F.col(f"_d{i}") * F.col(f"_d{j}") * (F.lit(1.0) if i == j else F.col(f"{head}q{i}{j}") / F.sqrt(power(i) * power(j)))

    usual = _scatter(F.col("_c"))
    made = [
        start(0, middle, lambda i, j: F.pow(F.col(f"_d{i}"), F.lit(2)) if i == j else F.lit(0.0)),
        start(1, [usual[f"_m{i}"] for i in range(DIM)], lambda i, j: usual[f"_v{i}{j}"]),
        start(2, middle, related("_t")),
        start(3, middle, related("_g")),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def judge(stats: DataFrame, fitted: tuple[DataFrame, DataFrame, int], tail: float = TAIL) -> DataFrame:
    """``stats`` with ``_distance`` (squared) and ``_kept``."""
    keys, params, n_keys = fitted
    known = keys.join(_small(params.drop("_start", "_size"), n_keys), "_key").drop("_key")
    far = with_distance(stats.join(_small(known, n_keys), ["_lang", "_source"], "left"))
    return far.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_distance") <= chi2_cut(tail, DIM), F.lit(True)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rule and the robust verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = cut(with_vector(with_stats(docs)).drop("text"))
    judged = judge(stats, fit(stats))
    return judged.select("doc_id", *(F.col(f"_{c}").alias(c) for c in _STATS), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.round("_distance", 6).alias("distance"))


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns.

    Rows and their counts are written once; the estimates read the counts alone, and texts are
    never shuffled.
    """
    measured = with_stats(nested(docs), F.col("_doc.text"))
    stats = written(with_vector(measured, F.col("_doc.lang"), F.col("_doc.source")))
    return flat(apart(judge(stats, fit(stats.drop("_doc")), tail), F.col("_kept")), docs.columns)

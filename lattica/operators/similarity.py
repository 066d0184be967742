"""Link prediction and structural similarity over pairs of nodes."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators.kernels import Net, run
from lattica.plans import wedges
from lattica.plans.cut import cut

PAIRS = "pair_pos long, u long, v long"
#: Nodes up to which a dense matrix in one task is quicker than rounds over pairs.
MOST_DENSE = 5000


def pairs_frame(g: Graph, pairs: Iterable[tuple[int, int]] | DataFrame) -> DataFrame:
    """``(pair_pos, u, v)``."""
    if isinstance(pairs, DataFrame):
        return pairs.select("pair_pos", "u", "v")
    return g.spark.createDataFrame([(i, int(u), int(v)) for i, (u, v) in enumerate(pairs)], PAIRS)


def _met(g: Graph, p: DataFrame, *columns: str) -> DataFrame:
    """``(pair_pos, ..., dst)``: common neighbours, of which the ends are none, in lists; ``columns`` of pairs with any."""
    near = g.arcs.groupBy("src").agg(F.collect_list("dst").alias("ys"))
    both = p.join(near.select(F.col("src").alias("u"), F.col("ys").alias("yu")), "u").join(near.select(F.col("src").alias("v"), F.col("ys").alias("yv")), "v")
    return both.select("pair_pos", *columns, "yu", "yv", F.array_except(F.array_intersect("yu", "yv"), F.array("u", "v")).alias("met"))


def _shared(g: Graph, p: DataFrame) -> DataFrame:
    """``(pair_pos, dst)``: common neighbours."""
    return _met(g, p).select("pair_pos", F.explode("met").alias("dst"))


def _scored(p: DataFrame, sums: DataFrame, score: Column) -> DataFrame:
    return p.join(sums, "pair_pos", "left").select("pair_pos", "u", "v", F.coalesce(score, F.lit(0.0)).alias("score"))


def common_neighbors_scores(g: Graph, pairs) -> DataFrame:
    p = pairs_frame(g, pairs)
    return _scored(p, _shared(g, p).groupBy("pair_pos").agg(F.count("*").cast("double").alias("c")), F.col("c"))


def jaccard_scores(g: Graph, pairs) -> DataFrame:
    p = pairs_frame(g, pairs)
    # A pair of which an end has no arcs has no common neighbours: it scores zero.
    common = F.size("met")
    ends = lambda ys: F.size(ys) - sum(F.array_contains(ys, F.col(x)).cast("int") for x in ("u", "v")) + (F.col("u") == F.col("v")).cast("int") * F.array_contains(ys, F.col("u")).cast("int")
    union = ends("yu") + ends("yv") - common
    sums = _met(g, p, "u", "v").select("pair_pos", F.when(union > 0, common.cast("double") / union).alias("c"))
    return _scored(p, sums, F.col("c"))


def _weighted(g: Graph, pairs, value: Column, least: int) -> DataFrame:
    p = pairs_frame(g, pairs)
    deg = g.degrees().where(F.col("degree") > least).select(F.col("id").alias("dst"), value.alias("x"))
    return _scored(p, _shared(g, p).join(deg, "dst").groupBy("pair_pos").agg(F.sum("x").alias("c")), F.col("c"))


def adamic_adar_scores(g: Graph, pairs) -> DataFrame:
    return _weighted(g, pairs, 1.0 / F.ln("degree"), 1)


def resource_allocation_scores(g: Graph, pairs) -> DataFrame:
    return _weighted(g, pairs, 1.0 / F.col("degree"), 0)


def _with_degrees(g: Graph, p: DataFrame) -> DataFrame:
    deg = g.degrees()
    return p.join(deg.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u", "left").join(deg.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v", "left")


def preferential_attachment_scores(g: Graph, pairs) -> DataFrame:
    d = _with_degrees(g, pairs_frame(g, pairs))
    return d.select("pair_pos", "u", "v", F.coalesce((F.col("du") * F.col("dv")).cast("double"), F.lit(0.0)).alias("score"))


def hub_promoted_index_scores(g: Graph, pairs) -> DataFrame:
    p = pairs_frame(g, pairs)
    d = _with_degrees(g, p).join(_shared(g, p).groupBy("pair_pos").agg(F.count("*").alias("c")), "pair_pos", "left")
    low = F.least("du", "dv")
    return d.select("pair_pos", "u", "v", F.when(low > 0, F.coalesce("c", F.lit(0)).cast("double") / low).otherwise(0.0).alias("score"))


def _single(batch):
    def one(g: Graph, u: int, v: int) -> float:
        return batch(g, [(u, v)]).first()["score"]

    return one


common_neighbors, jaccard, adamic_adar = map(_single, (common_neighbors_scores, jaccard_scores, adamic_adar_scores))
resource_allocation, preferential_attachment, hub_promoted_index = map(_single, (resource_allocation_scores, preferential_attachment_scores, hub_promoted_index_scores))


def _beta(beta: float) -> None:
    if isinstance(beta, bool) or not 0 < beta < 1:
        raise ValueError("beta must be between 0 and 1")


def katz_index_scores(g: Graph, pairs, beta: float = 0.05) -> DataFrame:
    """``((I - beta A)^-1 - I)[u, v]`` over the symmetric 0/1 adjacency, for each distinct ``u``.

    A small graph's columns are solved for; a larger one's walks are summed length by length,
    which settles where ``beta`` is below the inverse of the greatest eigenvalue and is an error
    elsewhere.
    """
    _beta(beta)
    p = pairs_frame(g, pairs)
    if g.nodes.count() > MOST_DENSE:
        return katz_walks(g, p, beta)
    wanted = [(r["pair_pos"], r["u"], r["v"]) for r in p.collect()]

    def kernel(net: Net):
        a = np.zeros((net.n, net.n))
        for u, row in enumerate(net.adj):
            for v, _ in row:
                a[u, v] = a[v, u] = 1.0
        known = sorted({net.index[u] for _, u, _ in wanted if u in net.index})
        try:
            x = np.linalg.solve(np.eye(net.n) - beta * a, np.eye(net.n)[:, known]) if known else None
        except np.linalg.LinAlgError as e:
            raise ValueError("the system is singular") from e
        at = {u: k for k, u in enumerate(known)}
        for k, u, v in wanted:
            if u in net.index and v in net.index:
                i, j = net.index[u], net.index[v]
                yield k, u, v, float(x[j, at[i]] - (i == j))
            else:
                yield k, u, v, 0.0

    return g.spark.createDataFrame(run(g, kernel, "x long") if wanted else [], PAIRS + ", score double")


def katz_walks(g: Graph, p: DataFrame, beta: float, tol: float = 1e-12, max_rounds: int = 500) -> DataFrame:
    """Katz scores of pairs by weighted walks from each ``u``, one step a round."""
    p = cut(p)
    ways = g.arcs.select("src", "dst").unionByName(g.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = cut(ways.distinct())
    front = cut(p.select("u").distinct().join(g.nodes.select(F.col("id").alias("u")), "u").select("u", F.col("u").alias("v"), F.lit(1.0).alias("x")))
    sums = cut(p.select("pair_pos", F.lit(0.0).alias("score")))
    for _ in range(max_rounds):
        step = front.join(ways.withColumnRenamed("src", "v"), "v").groupBy("u", F.col("dst").alias("v"))
        front = cut(step.agg((beta * F.sum("x")).alias("x")))
        met = p.join(front, ["u", "v"]).select("pair_pos", F.col("x").alias("score"))
        sums = cut(sums.unionByName(met).groupBy("pair_pos").agg(F.sum("score").alias("score")))
        most = front.agg(F.max("x")).first()[0] or 0.0
        if most <= tol:
            return p.join(sums, "pair_pos").select("pair_pos", "u", "v", "score")
        if most > 1e12:
            break
    raise ValueError("the walks don't settle: beta is too great for the graph")


def katz_index(g: Graph, u: int, v: int, beta: float = 0.05) -> float:
    if not (g.has_node(u) and g.has_node(v)):
        return 0.0
    return katz_index_scores(g, [(u, v)], beta).first()["score"]


def non_edges(g: Graph) -> DataFrame:
    """``(u, v)`` with u < v that no edge joins: every pair, so for graphs of few nodes."""
    ids = g.nodes.select("id")
    every = ids.select(F.col("id").alias("u")).join(ids.select(F.col("id").alias("v")), F.col("u") < F.col("v"))
    joined = g.arcs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return every.join(joined, ["u", "v"], "left_anti")


def open_wedges(g: Graph) -> DataFrame:
    """``(u, v)`` two steps apart that no edge joins: all pairs whose common neighbours aren't none."""
    arcs = g.arcs.select("src", "dst")
    two = arcs.select(F.col("src").alias("m"), F.col("dst").alias("u")).join(arcs.select(F.col("src").alias("m"), F.col("dst").alias("v")), "m").where("u < v").select("u", "v").distinct()
    joined = g.arcs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return two.join(joined, ["u", "v"], "left_anti")


def by_degree(g: Graph, k: int) -> DataFrame:
    """``(u, v)``, u < v: pairs that no edge joins, with each node's ``k`` partners of greatest degree among them.

    Of as many nodes of greatest degree as a node has arcs either way, and ``k + 1``, at least
    ``k`` aren't the node or its neighbours; so rows are in proportion to arcs and nodes.
    """
    from pyspark.sql import Window

    ends = g.arcs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    degrees = cut(g.degrees().join(ends, "id", "left").select("id", "degree", F.coalesce("n", F.lit(0)).alias("n")))
    most = (degrees.agg(F.max("n")).first()[0] or 0) + k + 1
    top = degrees.orderBy(F.desc("degree"), "id").limit(most).select(F.col("id").alias("v"), F.row_number().over(Window.orderBy(F.desc("degree"), "id")).alias("rank"))
    tries = degrees.select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), (F.col("n") + k + 1).cast("int"))).alias("rank"))
    pairs = tries.join(top, "rank").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    joined = g.arcs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return pairs.join(joined, ["u", "v"], "left_anti")


def first_pairs(g: Graph, k: int) -> DataFrame:
    """The first ``k`` pairs ``(u, v)``, u < v, that no edge joins, in order of ids."""
    found: list[tuple[int, int]] = []
    for row in g.nodes.select("id").orderBy("id").toLocalIterator():
        u = row["id"]
        near = g.arcs.where((F.col("src") == u) | (F.col("dst") == u)).select(F.when(F.col("src") == u, F.col("dst")).otherwise(F.col("src")).alias("id"))
        rest = g.nodes.where(F.col("id") > u).select("id").join(near, "id", "left_anti").orderBy("id").limit(k - len(found))
        found += [(u, r["id"]) for r in rest.collect()]
        if len(found) >= k:
            break
    return g.spark.createDataFrame(found, "u long, v long")


def predicted_links(g: Graph, metric=adamic_adar_scores, k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of ``candidates``, ties by the smaller ids.

    Without candidates all pairs that no edge joins count. For most metrics they aren't all
    made: those with common neighbours are, those of greatest degree for a product of degrees,
    and the first ones where there are fewer than ``k``, since all others score zero. Katz
    scores any pair, and makes them all. Sums over common neighbours in an undirected graph are
    made in blocks, of which only the best pairs leave (``plans/wedges.py``).
    """
    c = candidates
    degree = F.col("degree")
    worth = {common_neighbors_scores: F.lit(1.0), adamic_adar_scores: F.when(degree > 1, 1.0 / F.ln(degree)), resource_allocation_scores: 1.0 / degree}.get(metric)
    if c is None and worth is not None and not g.directed:
        values = g.degrees().where(degree > 0).select("id", worth.alias("x"))
        top = cut(wedges.best(g.simple(), values, k, g.stored))
        if top.count() < k:
            top = top.unionByName(first_pairs(g, k).join(top, ["u", "v"], "left_anti").withColumn("score", F.lit(0.0)))
        return top.orderBy(F.desc("score"), "u", "v").limit(k).select("u", "v", "score")
    if c is None:
        c = cut({preferential_attachment_scores: lambda: by_degree(g, k), katz_index_scores: lambda: non_edges(g)}.get(metric, lambda: open_wedges(g))())
        if c.count() < k:
            c = c.unionByName(first_pairs(g, k)).distinct()
    c = cut(c.withColumn("pair_pos", F.monotonically_increasing_id()))
    return metric(g, c).orderBy(F.desc("score"), "u", "v").limit(k).select("u", "v", "score")


def auc(scores: DataFrame) -> float:
    """Area under the ROC curve of ``(score, label)``, by sums of mean ranks."""
    from pyspark.sql import Window

    n = scores.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n"))
    r = n.withColumn("rank", F.sum("n").over(Window.orderBy("score")) - (F.col("n") - 1) / 2)
    x = r.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q")).first()
    if not x["p"] or not x["q"]:
        return math.nan
    return (x["s"] - x["p"] * (x["p"] + 1) / 2) / (x["p"] * x["q"])


def simrank_matrix(g: Graph, decay: float = 0.8, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """``(u, v, score)`` for all ordered pairs: similar are those whose in-neighbours are.

    A small graph's matrix is dense. Of a larger graph only pairs that don't score zero are kept,
    a round of two joins a step.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must be between 0 and 1")
    if isinstance(max_iter, bool) or not isinstance(max_iter, int) or max_iter < 1:
        raise ValueError("max_iter must be an integer of 1 or more")

    if g.nodes.count() > MOST_DENSE:
        return simrank_pairs(g, decay, max_iter, tol)

    def kernel(net: Net):
        w = np.zeros((net.n, net.n))
        for u, row in enumerate(net.adj):
            for v, _ in row:
                w[u, v] = 1.0
        size = w.sum(axis=0)
        w /= np.where(size > 0, size, 1.0)
        s = np.eye(net.n)
        for _ in range(max_iter):
            new = decay * (w.T @ s @ w)
            np.fill_diagonal(new, 1.0)
            moved = float(np.abs(new - s).max()) if net.n else 0.0
            s = new
            if moved < tol:
                break
        s = (s + s.T) / 2
        for i in range(net.n):
            for j in range(net.n):
                yield net.ids[i], net.ids[j], float(s[i, j])

    from lattica.operators.kernels import on_executor

    return on_executor(g, kernel, "u long, v long, score double")


def simrank_pairs(g: Graph, decay: float, max_iter: int, tol: float) -> DataFrame:
    """SimRank over the pairs that don't score zero."""
    size = g.arcs.groupBy("dst").agg(F.count("*").alias("n"))
    into = cut(g.arcs.join(size, "dst").select("src", "dst", (1.0 / F.col("n")).alias("w")))
    same = cut(g.nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("score")))
    now = same
    for _ in range(max_iter):
        half = now.join(into.withColumnRenamed("src", "u"), "u").groupBy(F.col("dst").alias("a"), "v").agg(F.sum(F.col("score") * F.col("w")).alias("s"))
        both = half.join(into.withColumnRenamed("src", "v"), "v").where("a <> dst").groupBy(F.col("a").alias("u"), F.col("dst").alias("v")).agg((decay * F.sum(F.col("s") * F.col("w"))).alias("score"))
        new = cut(both.unionByName(same))
        gap = new.join(now.withColumnRenamed("score", "old"), ["u", "v"], "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).first()["d"]
        now = new
        if gap is None or gap < tol:
            break
    return now


def simrank_similarity(g: Graph, source: int | None = None, target: int | None = None, decay: float = 0.8, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    if source is None and target is not None:
        raise ValueError("a target needs a source")
    g.require(*(x for x in (source, target) if x is not None))
    s = simrank_matrix(g, decay, max_iter, tol)
    s = s if source is None else s.where(F.col("u") == source)
    return s if target is None else s.where(F.col("v") == target)


def simrank_scores(g: Graph, pairs, decay: float = 0.8, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    p = pairs_frame(g, pairs)
    return p.join(simrank_matrix(g, decay, max_iter, tol), ["u", "v"], "left").select("pair_pos", "u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))


def most_similar(g: Graph, node: int, k: int = 5, decay: float = 0.8, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """The ``k`` nodes most like ``node``, ties by id."""
    return simrank_similarity(g, node, None, decay, max_iter, tol).where(F.col("v") != node).orderBy(F.desc("score"), "v").limit(k).select(F.col("v").alias("id"), "score")

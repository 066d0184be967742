"""Centrality and link analysis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import vectors
from lattica.operators.kernels import Net, frame
from lattica.plans.cores import core_numbers
from lattica.plans.cut import cut
from lattica.plans.frontiers import batches, dependencies, levels
from lattica.plans.leaves import core_of, leaves
from lattica.plans.messages import Blocks, sums


class ConvergenceError(ArithmeticError):
    """An iteration that ended before its tolerance was met."""


def _rounds(max_iter: int) -> None:
    if isinstance(max_iter, bool) or not isinstance(max_iter, int) or max_iter < 1:
        raise ValueError("max_iter must be an integer of 1 or more")


def degree_centrality(g: Graph) -> DataFrame:
    """``(id, score)``: the degree itself."""
    return g.degrees().select("id", F.col("degree").alias("score"))


def degree_centrality_array(g: Graph) -> DataFrame:
    """Degrees as doubles, in node order."""
    return g.degrees().join(g.nodes, "id").orderBy("pos").select("id", F.col("degree").cast("double").alias("score"))


def _distances(g: Graph, value: Column) -> DataFrame:
    """``(id, score)`` from ``s``, the sum of distances to the ``k`` other nodes that are reached, and ``x``, that of their inverses.

    Sources are searched from in batches of bounded rows, all of a batch at once; the graph stays a table.
    """
    d = F.col("d")
    sums = g.distance_counts().groupBy("id").agg(F.sum(d * F.col("n")).alias("s"), F.sum(F.when(d > 0, F.col("n")).otherwise(0)).alias("k"), F.coalesce(F.sum(F.when(d > 0, F.col("n") / d)), F.lit(0.0)).alias("x"))
    return cut(sums.select("id", value.alias("score")))


def closeness_centrality(g: Graph) -> DataFrame:
    """``(n - 1) / sum of distances`` over what is reached; 0 if nothing is."""
    n = g.number_of_nodes()
    return _distances(g, F.when(F.col("k") > 0, F.lit(float(n - 1)) / F.col("s")).otherwise(0.0))


def harmonic_centrality(g: Graph) -> DataFrame:
    """Sum of 1 / distance."""
    return _distances(g, F.col("x"))


def betweenness_centrality(g: Graph, normalized: bool = True) -> DataFrame:
    """Shortest paths (in hops) through each node.

    Sources are searched from in batches of bounded rows, with the number of paths to each node;
    levels are then gone back over, each handing on what hangs on it. In an undirected graph
    leaves aren't searched: their neighbour stands for them, and is on all shortest paths from
    and to them.
    """
    n = g.number_of_nodes()
    scale = 0.0 if n < 3 else 1 / ((n - 1) * (n - 2)) if normalized else 1.0 if g.directed else 0.5
    near = g.arcs.where("src <> dst").select("src", "dst", "weight")
    if g.directed:
        nodes, arcs, mass = g.nodes, cut(near.select("src", "dst")), None
        sums = nodes.select("id", F.lit(0.0).alias("part"))
    else:
        off = leaves(near)
        nodes, arcs = core_of(g.nodes, near, off)
        arcs, mass = arcs.select("src", "dst"), cut(off.groupBy(F.col("core").alias("id")).agg((F.count("*") + 1).alias("mass")))
        sums = g.nodes.select("id", F.lit(0.0).alias("part"))
    for sources in batches(nodes):
        found = levels(sources, arcs)
        for part in dependencies(found, arcs, mass):
            sums = sums.unionByName(part)
        if mass is not None:
            met = None
            for level in found:
                one = level.select("source", "id").join(mass, "id", "left").groupBy("source").agg(F.sum(F.coalesce("mass", F.lit(1))).alias("size"))
                met = one if met is None else met.unionByName(one)
            size, hung = F.col("size"), F.col("mass") - 1
            whole = met.groupBy(F.col("source").alias("id")).agg(F.sum("size").alias("size")).join(mass, "id")
            sums = sums.unionByName(whole.select("id", (2 * hung * (size - 2) - hung * (hung - 1)).cast("double").alias("part")))
        sums = cut(sums.groupBy("id").agg(F.sum("part").alias("part")))
    return sums.select("id", (F.col("part") * scale).alias("score"))


def _iterate(g: Graph, start: DataFrame, step, max_iter: int, tol: float | None) -> tuple[DataFrame, bool]:
    """``start (id, score, ...)`` moved by ``step`` until the summed change is below ``tol``.

    Without ``tol`` all rounds are made. ``step`` returns the same columns and ``_delta``.
    """
    now = cut(start)
    for _ in range(max_iter):
        new = cut(step(now))
        now, delta = new.drop("_delta"), new.agg(F.sum("_delta")).first()[0]
        if tol is not None and (delta or 0.0) < tol:
            return now, True
    return now, False


def _fits(g: Graph) -> bool:
    """Whether the graph is for one task; the superstep plans hold for any size."""
    return g.arcs.count() <= vectors.MOST_ARCS


def personalized_pagerank(g: Graph, personalization: dict[int, float] | None = None, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """PageRank whose jumps, and whose nodes without arcs out, follow the given weights."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    _rounds(max_iter)
    g = g.cut()
    n = g.number_of_nodes()
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    nodes = g.nodes.select("id")
    if personalization:
        if any(w < 0 for w in personalization.values()):
            raise ValueError("weights must not be negative")
        given = g.spark.createDataFrame([(int(k), float(w)) for k, w in personalization.items()], "id long, w double")
        given = nodes.join(given, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("w"))
        total = given.agg(F.sum("w")).first()[0]
        if not total:
            raise ValueError("weights must have a positive sum")
        jump = given.select("id", (F.col("w") / total).alias("jump"))
    else:
        jump = nodes.select("id", F.lit(1.0 / n).alias("jump"))
    if _fits(g):
        known = {int(k): float(w) for k, w in personalization.items()} if personalization else None
        return vectors.on_arrays(g, vectors.pagerank(known, alpha, max_iter, tol), "score double")
    out = g.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    base = cut(jump.join(out, "id", "left"))
    arcs = Blocks(g.arcs)

    def step(now: DataFrame) -> DataFrame:
        lost = now.where("deg is null").agg(F.sum("score")).first()[0] or 0.0
        got = sums(arcs, now.where("deg is not null").select("id", (F.col("score") / F.col("deg")).alias("x")))
        new = alpha * (F.coalesce("x", F.lit(0.0)) + lost * F.col("jump")) + (1 - alpha) * F.col("jump")
        return now.join(got, "id", "left").select("id", new.alias("score"), "jump", "deg", F.abs(new - F.col("score")).alias("_delta"))

    now, _ = _iterate(g, base.select("id", F.col("jump").alias("score"), "jump", "deg"), step, max_iter, tol)
    whole = now.agg(F.sum("score")).first()[0]
    return now.select("id", (F.col("score") / whole).alias("score"))


def pagerank(g: Graph, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """Unweighted PageRank from a uniform start."""
    return personalized_pagerank(g, None, alpha, max_iter, tol)


def _norm(df: DataFrame, name: str) -> float:
    return math.sqrt(df.agg(F.sum(F.col(name) * F.col(name))).first()[0] or 0.0)


def eigenvector_centrality(g: Graph, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """Leading eigenvector of the weighted in-adjacency, shifted by the identity; unit length."""
    _rounds(max_iter)
    n = g.number_of_nodes()
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    g = Graph(cut(g.nodes), cut(g.arcs), g.directed)
    if _fits(g):
        return vectors.on_arrays(g, vectors.eigenvector(max_iter, tol), "score double")
    arcs = g.arcs.select("src", "dst", "weight")

    def step(now: DataFrame) -> DataFrame:
        got = arcs.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("score")).alias("x"))
        raw = cut(now.join(got, "id", "left").select("id", "score", (F.col("score") + F.coalesce("x", F.lit(0.0))).alias("y")))
        size = _norm(raw, "y") or 1.0
        return raw.select("id", (F.col("y") / size).alias("score"), F.abs(F.col("y") / size - F.col("score")).alias("_delta"))

    return _iterate(g, g.nodes.select("id", F.lit(1 / math.sqrt(n)).alias("score")), step, max_iter, None if tol is None else n * tol)[0]


def katz_centrality(g: Graph, alpha: float = 0.1, beta: float = 1.0, max_iter: int = 100, tol: float | None = 1e-6, normalized: bool = True) -> DataFrame:
    """``x = alpha A' x + beta``, weighted; raises if it doesn't converge. Without ``tol`` all rounds are made, from x = 0."""
    for name, x in (("alpha", alpha), ("beta", beta), *([("tol", tol)] if tol is not None else ())):
        if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
            raise ValueError(f"{name} must be a finite number")
    if alpha <= 0 or tol is not None and tol <= 0:
        raise ValueError("alpha and tol must be positive")
    _rounds(max_iter)
    g = Graph(cut(g.nodes), cut(g.arcs), g.directed)
    if _fits(g):
        found = cut(vectors.on_arrays(g, vectors.katz(alpha, beta, max_iter, tol, normalized), "score double, converged boolean"))
        if not found.where(~F.col("converged")).isEmpty():
            raise ConvergenceError(f"no convergence in {max_iter} rounds")
        return found.select("id", "score")
    arcs = g.arcs.select("src", "dst", "weight")

    def step(now: DataFrame) -> DataFrame:
        got = arcs.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("score")).alias("x"))
        new = alpha * F.coalesce("x", F.lit(0.0)) + beta
        return now.join(got, "id", "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("_delta"))

    now, done = _iterate(g, g.nodes.select("id", F.lit(0.0).alias("score")), step, max_iter, tol)
    total = now.agg(F.sum("score")).first()[0]
    if not (done or tol is None) or total is not None and not math.isfinite(total):
        raise ConvergenceError(f"no convergence in {max_iter} rounds")
    size = (_norm(now, "score") or 1.0) if normalized else 1.0
    return now.select("id", (F.col("score") / size).alias("score"))


def hits(g: Graph, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """``(id, hub, authority)``, each of unit length; uniform where a norm is zero."""
    _rounds(max_iter)
    n = g.number_of_nodes()
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    g = Graph(cut(g.nodes), cut(g.arcs), g.directed)
    if _fits(g):
        return vectors.on_arrays(g, vectors.hits(max_iter, tol), "hub double, authority double")
    arcs, flat = g.arcs.select("src", "dst", "weight"), 1 / math.sqrt(n)

    def moved(values: DataFrame, name: str, a: str, b: str) -> DataFrame:
        return arcs.join(values.select(F.col("id").alias(a), name), a).groupBy(F.col(b).alias("id")).agg(F.sum(F.col("weight") * F.col(name)).alias("x"))

    def unit(c: str, size: float) -> Column:
        return F.col(c) / size if size else F.lit(flat)

    def step(now: DataFrame) -> DataFrame:
        a = now.join(moved(now, "hub", "src", "dst"), "id", "left").withColumn("a", F.coalesce("x", F.lit(0.0))).drop("x")
        a = cut(a)
        h = cut(a.join(moved(a, "a", "dst", "src"), "id", "left").withColumn("h", F.coalesce("x", F.lit(0.0))).drop("x"))
        na, nh = _norm(h, "a"), _norm(h, "h")
        delta = F.abs(unit("a", na) - F.col("authority")) + F.abs(unit("h", nh) - F.col("hub"))
        return h.select("id", unit("h", nh).alias("hub"), unit("a", na).alias("authority"), delta.alias("_delta"))

    start = g.nodes.select("id", F.lit(flat).alias("hub"), F.lit(flat).alias("authority"))
    return _iterate(g, start, step, max_iter, tol)[0]


def core_number(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, core)`` of the undirected simple view.

    Every node's estimate falls to the h-index of its neighbours' until none moves; started
    from the degrees this ends at the core numbers. Blocks of nodes settle by themselves before
    they tell each other (``plans/cores.py``).
    """
    now = core_numbers(g.both(), max_rounds)
    return g.nodes.join(now, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def voterank(g: Graph, number_of_nodes: int | None = None) -> DataFrame:
    """``(rank, id)``: spreaders elected one by one; a winner loses its votes and weakens its neighbours."""

    def kernel(net: Net):
        back = net.back()
        ability = [1.0] * net.n
        arcs = sum(len(r) for r in net.adj)
        mean = arcs / net.n if net.n else 0.0
        chosen: set[int] = set()
        limit = net.n if number_of_nodes is None else min(number_of_nodes, net.n)
        while len(chosen) < limit and mean > 0:
            best, top = None, 0.0
            for v in range(net.n):
                if v not in chosen:
                    score = sum(ability[u] for u, _ in back[v] if u != v)
                    if score > top + 1e-12:
                        best, top = v, score
            if best is None:
                return
            yield len(chosen), net.ids[best]
            chosen.add(best)
            ability[best] = 0.0
            for u in {x for x, _ in net.adj[best]} | {x for x, _ in back[best]}:
                ability[u] = max(0.0, ability[u] - 1 / mean)

    return frame(g, lambda net: list(kernel(net)), "rank long, id long")

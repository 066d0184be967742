"""Directed acyclic graphs."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators.kernels import Net, frame, run
from lattica.operators.paths import multi_source_bfs
from lattica.plans.cut import cut
from lattica.plans.sweep import along, heaviest, sweep


class CycleError(ValueError):
    """A cycle where there must be none, as a list of its nodes."""

    def __init__(self, cycle: list[int]):
        super().__init__(f"cycle {cycle}")
        self.cycle = cycle

    def __reduce__(self):
        return CycleError, (self.cycle,)


def _need(g: Graph) -> None:
    if not g.directed:
        raise ValueError("a directed graph is needed")


def _cycle(net: Net) -> list[int] | None:
    state = [0] * net.n
    for s in range(net.n):
        if state[s]:
            continue
        path, stack = [s], [iter(net.adj[s])]
        state[s] = 1
        while stack:
            v = next((v for v, _ in stack[-1] if state[v] < 2), None)
            if v is None:
                state[path.pop()] = 2
                stack.pop()
            elif state[v] == 1:
                return [net.ids[x] for x in path[path.index(v) :]]
            else:
                state[v] = 1
                path.append(v)
                stack.append(iter(net.adj[v]))
    return None


def find_cycle(g: Graph) -> list[int] | None:
    """The nodes of some directed cycle in order, or None."""
    _need(g)
    rows = run(g, lambda net: [(x,) for x in _cycle(net) or []], "id long")
    return [r[0] for r in rows] or None


def is_dag(g: Graph) -> bool:
    return g.directed and _layers(g)[1]


def _layers(g: Graph) -> tuple[DataFrame, bool]:
    """``(id, generation)`` by peeling nodes without arcs in, and whether all went."""
    rows, whole = heaviest(cut(g.nodes.select("id", "pos")).withColumn("start", F.lit(0.0)), cut(g.arcs.select("src", "dst", F.lit(1.0).alias("weight"))))
    return rows.select("id", "generation"), whole


def _whole(g: Graph, swept: tuple[DataFrame, bool]) -> DataFrame:
    """What was swept, or the cycle that stands against it."""
    rows, whole = swept
    if not whole:
        raise CycleError(find_cycle(g))
    return rows


def _checked(g: Graph) -> DataFrame:
    _need(g)
    return _whole(g, _layers(g))


def topological_generations(g: Graph) -> DataFrame:
    """``(id, generation)``, in node order within a generation."""
    return _checked(g).join(g.nodes, "id").orderBy("generation", "pos").select("id", "generation")


def topological_sort(g: Graph) -> DataFrame:
    """``(step, id)``: the order that is least by place of insertion."""
    _need(g)

    def kernel(net: Net):
        need = [0] * net.n
        for row in net.adj:
            for v, _ in row:
                need[v] += 1
        heap, out = [v for v in range(net.n) if not need[v]], []
        while heap:
            u = heapq.heappop(heap)
            out.append(u)
            for v, _ in net.adj[u]:
                need[v] -= 1
                if not need[v]:
                    heapq.heappush(heap, v)
        if len(out) < net.n:
            raise CycleError(_cycle(net))
        return [(k, net.ids[v]) for k, v in enumerate(out)]

    return frame(g, kernel, "step long, id long")


def descendants(g: Graph, source: int) -> DataFrame:
    """What ``source`` reaches, itself left out."""
    _need(g)
    g.require(source)
    return g.bfs_distances(source).where(F.col("id") != source).select("id")


def ancestors(g: Graph, target: int) -> DataFrame:
    _need(g)
    g.require(target)
    return descendants(g.reversed(), target)


def longest_paths(g: Graph, weighted: bool = True) -> DataFrame:
    """``(id, pos, length, previous, generation)``: the heaviest path that ends in each node, and the node before it.

    A path begins where nothing before it adds to its weight; of equal predecessors the one of the
    earliest generation counts, and of these the first in node order.
    """
    _need(g)
    arcs = cut(g.arcs.select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight")))
    return _whole(g, heaviest(cut(g.nodes.select("id", "pos")).withColumn("start", F.lit(0.0)), arcs))


def dag_longest_path(g: Graph, weighted: bool = True) -> tuple[float, list[int]]:
    """Length and nodes of the heaviest path; of equal ends the first in node order counts. The path alone comes to the driver."""
    rows = cut(longest_paths(g, weighted))
    end = rows.orderBy(F.desc("length"), "pos").first()
    if end is None:
        return 0.0, []
    path = rows.join(along(end["id"], rows.select("id", F.col("previous").alias("next"))), "id").orderBy("generation")
    return end["length"], [r["id"] for r in path.select("id").collect()]


#: Bits of a prime that paths are counted by.
_BITS = 30


def _primes(n: int) -> list[int]:
    """The greatest ``n`` primes below ``2^_BITS``."""
    out, k = [], (1 << _BITS) - 1
    while len(out) < n:
        if all(k % d for d in range(3, math.isqrt(k) + 1, 2)):
            out.append(k)
        k -= 2
    return out


def count_paths(g: Graph, source: int, target: int) -> int:
    """The exact number of paths, of any size.

    It is counted by its remainders of as many primes as its size may ask for, which the arcs
    that come together in each generation bound, and put together from them.
    """
    _need(g)
    g.require(source, target)
    known = _checked(g)
    arcs = cut(g.arcs.select("src", "dst"))
    ahead = cut(multi_source_bfs(Graph(g.nodes, arcs.withColumns({"weight": F.lit(1.0), "pos": F.lit(0)}), True), g.spark.createDataFrame([(source,)], "source long")).select(F.col("dst").alias("id")))
    arcs = cut(arcs.join(ahead.withColumnRenamed("id", "src"), "src"))
    met = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k")).join(known, "id").groupBy("generation").agg(F.max("k").alias("k"))
    bits = met.agg(F.sum(F.log2("k"))).first()[0] or 0.0
    primes = _primes(int(bits) // (_BITS - 1) + 1)
    nodes = ahead.select("id", *(F.when(F.col("id") == source, 1).otherwise(0).cast("long").alias(f"n{k}") for k in range(len(primes))))
    push = [F.sum(f"n{k}").alias(f"_n{k}") for k in range(len(primes))]
    rows = _whole(g, sweep(nodes, arcs, push, lambda: {f"n{k}": (F.col(f"n{k}") + F.coalesce(f"_n{k}", F.lit(0))) % p for k, p in enumerate(primes)}))
    row = rows.where(F.col("id") == target).first()
    total, product = 0, 1
    for k, p in enumerate(primes if row else []):
        total += product * ((row[f"n{k}"] - total) * pow(product, -1, p) % p)
        product *= p
    return total


def path_counts(g: Graph) -> DataFrame:
    """``(src, dst, paths)`` for all pairs with a path, as a DataFrame of decimals.

    By length of path; an overflow of 38 digits raises under ANSI.
    """
    _checked(g)
    arcs = cut(g.arcs.select("src", "dst"))
    front = arcs.select("src", "dst", F.lit(1).cast("decimal(38,0)").alias("paths"))
    out = front
    while not front.isEmpty():
        front = cut(front.join(arcs.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").groupBy("src", F.col("to").alias("dst")).agg(F.sum("paths").cast("decimal(38,0)").alias("paths")))
        out = cut(out.unionByName(front))
    return out.groupBy("src", "dst").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))


def transitive_closure(g: Graph) -> DataFrame:
    """``(src, dst)``: every pair with a path, by joining what is new with the arcs."""
    _checked(g)
    arcs = cut(g.arcs.select("src", "dst"))
    seen = front = arcs
    while not front.isEmpty():
        step = front.join(arcs.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct()
        front = cut(step.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def transitive_reduction(g: Graph) -> DataFrame:
    """``(src, dst, weight)``: arcs that no longer path replaces."""
    closure = cut(transitive_closure(g))
    over = g.arcs.select("src", F.col("dst").alias("mid")).join(closure.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return g.arcs.join(over, ["src", "dst"], "left_anti").select("src", "dst", "weight")


def critical_path(g: Graph, durations: dict[int, float] | DataFrame) -> tuple[DataFrame, float, list[int]]:
    """``(id, es, ef, ls, lf, slack, critical)``, the whole duration and a critical path.

    ``durations`` are a mapping or ``(id, duration)``. Forward the nodes take the latest finish before
    them, backward the earliest start after them. The path begins in the first critical node
    that nothing is before, and goes on to the first that it holds up.
    """
    _need(g)
    if not isinstance(durations, DataFrame):
        durations = g.spark.createDataFrame([(int(k), float(v)) for k, v in durations.items()], "id long, duration double")
    given = cut(g.nodes.join(durations.select("id", F.col("duration").cast("double").alias("d")), "id", "left"))
    if not given.where("d < 0").isEmpty():
        raise ValueError("durations must not be negative")
    if (bare := given.where("d is null").first()) is not None:
        raise KeyError(f"no duration for node {bare['id']}")
    arcs = cut(g.arcs.select("src", "dst", F.col("pos").alias("place")))
    took = given.select(F.col("id").alias("src"), F.col("d").alias("weight"))
    forward = cut(_whole(g, heaviest(given.select("id", "pos", F.lit(0.0).alias("start")), arcs.join(took, "src"))).select("id", F.col("length").alias("es"), "generation").join(given.select("id", "pos", "d"), "id"))
    whole = forward.agg(F.max(F.col("es") + F.col("d"))).first()[0] or 0.0
    turned = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src")).join(took, "src")
    backward = _whole(g, heaviest(given.select("id", "pos", F.lit(-whole).alias("start")), turned)).select("id", (F.lit(0.0) - F.col("length")).alias("lf"))
    both = forward.join(backward, "id")
    slack, tol = F.col("lf") - F.col("d") - F.col("es"), 1e-9 * max(1.0, whole)
    rows = cut(both.select("id", "pos", "d", "generation", "es", "lf", F.when(F.abs(slack) <= tol, 0.0).otherwise(slack).alias("slack"), (F.abs(slack) <= tol).alias("critical")))
    hot = rows.where("critical")
    start = hot.where("generation = 0").orderBy("pos").first()
    path: list[int] = []
    if start is not None:
        ends = arcs.join(hot.select(F.col("id").alias("src"), (F.col("es") + F.col("d")).alias("ef")), "src").join(hot.select(F.col("id").alias("dst"), F.col("es").alias("next_es")), "dst")
        steps = ends.where(F.abs(F.col("next_es") - F.col("ef")) <= tol).groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct("place", "dst")).alias("next"))
        path = [r["id"] for r in rows.join(along(start["id"], steps), "id").orderBy("generation").select("id").collect()]
    out = rows.select("id", "es", (F.col("es") + F.col("d")).alias("ef"), (F.col("lf") - F.col("d")).alias("ls"), "lf", "slack", "critical")
    return out, whole, path

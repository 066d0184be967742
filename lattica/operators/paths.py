"""Traversal, shortest paths, distances and spanning trees."""

from __future__ import annotations

import heapq
import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators.kernels import Net, frame, per_source, run
from lattica.plans.components import components
from lattica.plans.cut import cut, round_cut
from lattica.plans.leaves import core_of, leaves


class NegativeCycleError(ValueError):
    """A cycle of negative weight, as a closed list of nodes."""

    def __init__(self, cycle: list[int]):
        super().__init__(f"negative cycle {cycle}")
        self.cycle = cycle

    def __reduce__(self):
        return NegativeCycleError, (self.cycle,)


def multi_source_bfs(g: Graph, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(source, dst, distance)`` in hops from every source, by frontiers.

    A round joins the frontier with the arcs, which stay in their buckets, and keeps what no earlier round has reached:
    where undirected no round but the last two can have.
    """
    from lattica.plans.buckets import bucketed

    sources = sources.select("source").distinct()
    with bucketed(g) as arcs:
        if g.pairs is not None:  # every node is an end of a pair
            here = arcs.select(F.col("src").alias("source")).join(sources, "source").distinct()
        else:
            here = sources.join(g.nodes.select(F.col("id").alias("source")), "source", "left_semi")
        seen = front = last = cut(here.select("source", F.col("source").alias("dst"), F.lit(0).cast("long").alias("distance")))
        few, depth = front.count() == 1, 0
        while (max_depth is None or depth < max_depth) and not front.isEmpty():
            depth += 1
            at = front.select("source", F.col("dst").alias("src"))
            step = arcs.join(at.hint("shuffle_hash") if few else at, "src").select("source", "dst").distinct()
            before = seen if g.directed else last.unionByName(front)
            last, front = front, cut(step.join(before, ["source", "dst"], "left_anti").withColumn("distance", F.lit(depth).cast("long")))
            seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)
    return seen


def hops(adj: list[list[tuple[int, float]]], s: int) -> dict[int, int]:
    """Distances in hops from ``s``."""
    dist, queue = {s: 0}, deque([s])
    while queue:
        u = queue.popleft()
        for v, _ in adj[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    return dist


def relaxed(adj: list[list[tuple[int, float]]], s: int, target: int | None = None) -> tuple[dict[int, float], dict[int, int]]:
    """Least weights from ``s`` and predecessors; with ``target``, what was met until it was settled."""
    dist, before, done, heap = {s: 0.0}, {}, set(), [(0.0, 0, s)]
    tick = 0
    while heap:
        d, _, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == target:
            break
        for v, w in adj[u]:
            if w < 0:
                raise ValueError("edges must not be negative")
            if v not in done and d + w < dist.get(v, math.inf):
                dist[v], before[v] = d + w, u
                tick += 1
                heapq.heappush(heap, (d + w, tick, v))
    return dist, before


def dijkstra_shortest_path(g: Graph, source: int, target: int | None = None, width: float | None = None) -> DataFrame:
    """``(id, distance, previous)`` for what is reached from ``source``; with ``target``, for what is settled once it is.

    Nodes are settled a bucket of distances of ``width`` (the mean weight) at a time: arcs of at
    most that weight are followed in rounds until the bucket stands still, the others once after.
    Wider buckets need fewer rounds and follow more arcs in vain. A node's predecessor
    changes with a shorter distance only, so that arcs of weight 0 close no circle. An arc that can
    be reached and has a negative weight is an error.
    """
    g.require(source)
    arcs = cut(g.arcs.select("src", "dst", "weight"))
    known = arcs.agg(F.avg("weight").alias("mean"), F.min("weight").alias("least")).first()
    start = g.spark.createDataFrame([(source, 0.0, None, True)], "id long, distance double, previous long, fresh boolean")
    if (known["least"] or 0) < 0:
        met = multi_source_bfs(g, start.select(F.col("id").alias("source"))).select(F.col("dst").alias("src"))
        if not arcs.where("weight < 0").join(met, "src", "left_semi").isEmpty():
            raise ValueError("edges must not be negative")
    width = width or max(known["mean"] or 0.0, 0.0) or 1.0
    bucket = F.floor(F.col("distance") / width)

    def followed(state: DataFrame, front, heavy: bool) -> DataFrame:
        """``state`` after the arcs of one kind from its rows where ``front`` holds."""
        kind = F.col("weight") > width if heavy else F.col("weight") <= width
        step = state.where(front).select(F.col("id").alias("src"), "distance").join(arcs.where(kind), "src")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("d"), "src")).alias("new"))
        shorter = F.coalesce(F.col("new.d") < F.col("distance"), F.col("new").isNotNull())
        waits = F.coalesce(F.col("fresh"), F.lit(False)) if heavy else F.coalesce(F.col("fresh") & ~front, F.lit(False))
        return round_cut(state.join(step, "id", "full").select("id", F.when(shorter, F.col("new.d")).otherwise(F.col("distance")).alias("distance"), F.when(shorter, F.col("new.src")).otherwise(F.col("previous")).alias("previous"), (shorter | waits).alias("fresh")))

    state, goal = round_cut(start), F.min(F.when(F.col("id") == F.lit(target), bucket))
    at = None
    while True:
        now = state.agg(F.min(F.when(F.col("fresh"), bucket)).alias("next"), goal.alias("goal")).first()
        if at is not None and now["next"] != at:
            state = followed(state, bucket == at, True)
            now = state.agg(F.min(F.when(F.col("fresh"), bucket)).alias("next"), goal.alias("goal")).first()
        if now["next"] is None or (now["goal"] is not None and now["next"] > now["goal"]):
            break
        at = now["next"]
        state = followed(state, F.col("fresh") & (bucket == at), False)
    if now["goal"] is not None:
        state = state.where(bucket <= now["goal"])
    return state.select("id", "distance", "previous")


def sssp(g: Graph, sources: DataFrame, weighted: bool = True) -> DataFrame:
    """``(source, dst, distance)`` by rounds of relaxation, for any number of nodes; weights not negative."""
    arcs = cut(g.arcs.select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight")))
    if not arcs.where("weight < 0").isEmpty():
        raise ValueError("edges must not be negative")
    best = cut(sources.select("source", F.col("source").alias("dst"), F.lit(0.0).alias("distance")))
    front = best
    while not front.isEmpty():
        step = front.select("source", F.col("dst").alias("src"), "distance").join(arcs, "src").groupBy("source", "dst").agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        merged = cut(best.join(step, ["source", "dst"], "full").select("source", "dst", F.least("distance", "new").alias("distance"), (F.col("new") < F.coalesce("distance", F.lit(math.inf))).alias("moved")))
        best, front = merged.drop("moved"), merged.where("moved").drop("moved")
    return best


def reconstruct_path(previous: DataFrame, source: int, target: int) -> list[int]:
    """The path in ``(id, previous)`` rows from ``source`` to ``target``."""
    before = {r["id"]: r["previous"] for r in previous.select("id", "previous").collect()}
    path = [target]
    if target not in before:
        raise KeyError(f"{target} isn't reached")
    while path[-1] != source:
        step = before.get(path[-1])
        if step is None:
            raise KeyError(f"{target} isn't reached from {source}")
        path.append(step)
    return path[::-1]


def _bellman(net: Net, s: int, weighted: bool) -> tuple[dict[int, float], dict[int, int]]:
    arcs = [(u, v, w if weighted else 1.0) for u, row in enumerate(net.adj) for v, w in row]
    dist, before, last = {s: 0.0}, {}, None
    for _ in range(net.n):
        last = None
        for u, v, w in arcs:
            if u in dist and dist[u] + w < dist.get(v, math.inf) - 1e-12:
                dist[v], before[v], last = dist[u] + w, u, v
        if last is None:
            return dist, before
    for _ in range(net.n):
        last = before[last]
    cycle = [last]
    while (up := before[cycle[-1]]) != last:
        cycle.append(up)
    raise NegativeCycleError([net.ids[x] for x in [last, *cycle[::-1]]])


def bellman_ford(g: Graph, source: int, weighted: bool = True) -> DataFrame:
    """``(id, distance, previous)``; weights may be negative, a negative cycle raises."""
    g.require(source)

    def kernel(net: Net):
        dist, before = _bellman(net, net.index[source], weighted)
        return [(net.ids[v], d, net.ids[before[v]] if v in before else None) for v, d in dist.items()]

    return frame(g, kernel, "id long, distance double, previous long")


def floyd_warshall(g: Graph, weighted: bool = False) -> DataFrame:
    """``(src, dst, distance, next)`` for all pairs that are connected, and a node with itself.

    Sources are spread over tasks; each is solved from its own side, with a step back through
    the predecessors for the first node on the way. Loops are left out unless negative. Where most
    nodes are leaves of an undirected graph only the others are solved, and the leaves' pairs are
    joined from those of their neighbours.
    """
    if not g.directed and g.arcs.where("src = dst or weight < 0").isEmpty():
        off = leaves(g.arcs)
        if 2 * off.count() > g.nodes.count():
            nodes, arcs = core_of(g.nodes, g.arcs, off)
            return _with_leaves(nodes, off if weighted else off.withColumn("weight", F.lit(1.0)), _solved(Graph(nodes, arcs.select(*g.arcs.columns)), weighted))
    return _solved(g, weighted)


#: Parts that the pairs with leaves of one node are dealt into.
DEALT = 64


def _with_leaves(nodes: DataFrame, off: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` of ``nodes`` and of the leaves ``off`` as well."""
    ends = round_cut(nodes.select("id", F.col("id").alias("core"), F.lit(0.0).alias("weight")).unionByName(off))
    a = ends.select(F.col("id").alias("u"), F.col("core").alias("src"), F.col("weight").alias("wu"))
    b = ends.select(F.col("id").alias("v"), F.col("core").alias("dst"), F.col("weight").alias("wv"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    whole = round_cut(pairs).join(a, "src").withColumn("part", F.pmod(F.xxhash64("u"), F.lit(DEALT)).cast("int")).join(b, ["dst", "part"])
    same, u, v = F.col("u") == F.col("v"), F.col("u"), F.col("v")
    step = F.when(same, F.lit(None)).when(u != F.col("src"), F.col("src")).when(F.col("src") == F.col("dst"), v).otherwise(F.col("next"))
    return whole.select(u.alias("src"), v.alias("dst"), F.when(same, 0.0).otherwise(F.col("wu") + F.col("distance") + F.col("wv")).alias("distance"), step.alias("next"))


def _solved(g: Graph, weighted: bool) -> DataFrame:
    """``floyd_warshall`` from each source of the graph."""

    def kernel(net: Net, sources: list[int]):
        bad = any(w < 0 for row in net.adj for _, w in row)
        for s in sources:
            if weighted and bad:
                dist, before = _bellman(net, s, True)
            elif weighted:
                dist, before = relaxed(net.adj, s)
            else:
                dist, before = hops(net.adj, s), {}
                for u in dist:
                    for v, _ in net.adj[u]:
                        if v != s and v not in before and dist[v] == dist[u] + 1:
                            before[v] = u
            first: dict[int, int] = {}
            for v in dist:
                trail = []
                while v != s and v not in first:
                    trail.append(v)
                    if before[v] == s:
                        first[v] = v
                        break
                    v = before[v]
                for x in trail:
                    first[x] = first[v]
            for v, d in dist.items():
                yield net.ids[s], net.ids[v], float(d), net.ids[first[v]] if v != s else None

    return per_source(g, kernel, "src long, dst long, distance double, next long")


def floyd_warshall_path(pairs: DataFrame, source: int, target: int) -> list[int]:
    """The path along ``next`` from ``source`` to ``target``."""
    step = {r["src"]: r["next"] for r in pairs.where(F.col("dst") == target).collect()}
    if source not in step:
        raise KeyError(f"no path from {source} to {target}")
    path = [source]
    while path[-1] != target:
        path.append(step[path[-1]])
    return path


def _each(g: Graph, weighted: bool) -> DataFrame:
    """``(id, met, e, s, x)``: how many nodes each one reaches, itself among them, the greatest distance, the sum of distances and that of the inverses of those above 0. No pairs are kept."""
    d = F.col("distance" if weighted else "d").cast("double")
    n = F.lit(1) if weighted else F.col("n")
    rows = floyd_warshall(g, True).withColumnRenamed("src", "id") if weighted else g.distance_counts()
    return rows.groupBy("id").agg(F.sum(n).alias("met"), F.max(d).alias("e"), F.sum(d * n).alias("s"), F.coalesce(F.sum(F.when((d > 0) & ((F.col("id") != F.col("dst")) if weighted else F.lit(True)), n / d)), F.lit(0.0)).alias("x"))


def _connected(g: Graph, weighted: bool) -> DataFrame:
    """``_each``, where every node reaches every other."""
    n = g.number_of_nodes()
    if n == 0:
        raise ValueError("the graph is empty")
    each = cut(_each(g, weighted))
    if not each.where(F.col("met") != n).isEmpty():
        raise ValueError("the graph isn't (strongly) connected")
    return each


def eccentricity(g: Graph, weighted: bool = False) -> DataFrame:
    """``(id, eccentricity)``; raises unless every node reaches every other."""
    return _connected(g, weighted).select("id", F.col("e").alias("eccentricity"))


def diameter(g: Graph, weighted: bool = False) -> float:
    return eccentricity(g, weighted).agg(F.max("eccentricity")).first()[0]


def radius(g: Graph, weighted: bool = False) -> float:
    return eccentricity(g, weighted).agg(F.min("eccentricity")).first()[0]


def _at(g: Graph, weighted: bool, which) -> DataFrame:
    e = cut(eccentricity(g, weighted))
    mark = e.agg(which("eccentricity")).first()[0]
    return e.where(F.abs(F.col("eccentricity") - mark) <= 1e-12).join(g.nodes, "id").orderBy("pos").select("id")


def center(g: Graph, weighted: bool = False) -> DataFrame:
    return _at(g, weighted, F.min)


def periphery(g: Graph, weighted: bool = False) -> DataFrame:
    return _at(g, weighted, F.max)


def average_shortest_path_length(g: Graph, weighted: bool = False) -> float:
    n = g.number_of_nodes()
    return 0.0 if n < 2 else _connected(g, weighted).agg(F.sum("s")).first()[0] / (n * (n - 1))


def wiener_index(g: Graph, weighted: bool = False) -> float:
    total = _connected(g, weighted).agg(F.sum("s")).first()[0]
    return total if g.directed else total / 2


def global_efficiency(g: Graph, weighted: bool = False) -> float:
    """Mean of 1/d over ordered pairs; pairs apart, or at distance zero, count as 0."""
    n = g.number_of_nodes()
    if n < 2:
        return 0.0
    return (_each(g, weighted).agg(F.sum("x")).first()[0] or 0.0) / (n * (n - 1))


def local_efficiency(g: Graph, weighted: bool = False) -> DataFrame:
    """``(id, efficiency)``: global efficiency of the graph that a node's neighbours induce."""

    def kernel(net: Net, sources: list[int]):
        for s in sources:
            near = {v for v, _ in net.adj[s] if v != s}
            k, total = len(near), 0.0
            if k < 2:
                yield net.ids[s], 0.0
                continue
            inner = {u: [(v, w) for v, w in net.adj[u] if v in near] for u in near}
            for u in near:
                dist = relaxed(inner, u)[0] if weighted else hops(inner, u)
                total += sum(1 / d for v, d in dist.items() if v != u and d > 0)
            yield net.ids[s], total / (k * (k - 1))

    return per_source(g, kernel, "id long, efficiency double")


def average_local_efficiency(g: Graph, weighted: bool = False) -> float:
    return local_efficiency(g, weighted).agg(F.avg("efficiency")).first()[0] or 0.0


def _figures(g: Graph, each: DataFrame) -> dict:
    n = g.number_of_nodes()
    r = each.agg(F.min("e").alias("low"), F.max("e").alias("high"), F.sum("s").alias("s"), F.sum("x").alias("x")).first()
    pairs = n * (n - 1)
    return {
        "radius": r["low"], "diameter": r["high"], "average_shortest_path_length": r["s"] / pairs if pairs else 0.0,
        "wiener_index": r["s"] / (1 if g.directed else 2), "global_efficiency": r["x"] / pairs if pairs else 0.0,
    }


def distance_figures(g: Graph, weighted: bool = False) -> dict:
    """Radius, diameter, average path, Wiener index and global efficiency, from one computation; only sums come to the driver."""
    return _figures(g, _connected(g, weighted))


def distance_summary(g: Graph, weighted: bool = False) -> dict:
    """Everything about distances, from one computation; with a value for each node, as the result is one."""
    n, each = g.number_of_nodes(), _connected(g, weighted)
    figures = _figures(g, each)
    ecc = {r["id"]: r["e"] for r in each.join(g.nodes, "id").orderBy("pos").collect()}
    low, high = figures["radius"], figures["diameter"]
    local = {x["id"]: x["efficiency"] for x in local_efficiency(g, weighted).collect()}
    return figures | {
        "eccentricity": ecc, "center": [k for k, e in ecc.items() if abs(e - low) <= 1e-12], "periphery": [k for k, e in ecc.items() if abs(e - high) <= 1e-12],
        "local_efficiency": local, "average_local_efficiency": sum(local.values()) / n, "weighted": weighted,
    }


def dfs_traversal(g: Graph, start: int, target: int | None = None, max_depth: int | None = None) -> DataFrame:
    """``(step, id, depth)`` in preorder by order of neighbours; ends at ``target``."""
    g.require(start)

    def kernel(net: Net):
        seen, step = {net.index[start]}, 0
        stack = [(net.index[start], 0, iter(net.adj[net.index[start]]))]
        yield 0, start, 0
        while stack and start != target:
            u, depth, rest = stack[-1]
            v = next((v for v, _ in rest if v not in seen), None) if max_depth is None or depth < max_depth else None
            if v is None:
                stack.pop()
                continue
            seen.add(v)
            step += 1
            yield step, net.ids[v], depth + 1
            if net.ids[v] == target:
                return
            stack.append((v, depth + 1, iter(net.adj[v])))

    return frame(g, lambda net: list(kernel(net)), "step long, id long, depth long")


def dfs_path(g: Graph, start: int, target: int, max_depth: int | None = None) -> list[int] | None:
    """A path of depth-first search, of at most ``max_depth`` edges, or None."""
    g.require(start)

    def kernel(net: Net):
        s = net.index[start]
        stack, path, on = [(s, iter(net.adj[s]))], [s], {s}
        while stack:
            if net.ids[path[-1]] == target:
                return [(net.ids[x],) for x in path]
            v = None
            if max_depth is None or len(path) <= max_depth:
                v = next((v for v, _ in stack[-1][1] if v not in on), None)
            if v is None:
                stack.pop()
                # With a bound on depth a node may be tried again on another way to it.
                gone = path.pop()
                if max_depth is not None:
                    on.discard(gone)
            else:
                on.add(v)
                path.append(v)
                stack.append((v, iter(net.adj[v])))
        return []

    rows = run(g, kernel, "id long")
    return [r[0] for r in rows] or None


def kruskal_mst(g: Graph) -> DataFrame:
    """``(src, dst, weight)``: the minimum spanning forest, ties by order of edges.

    Borůvka's rounds: each part takes its least edge in the total order (weight, place), which
    makes the same forest as one sorted pass would.
    """
    e = cut(g.edges().where("src <> dst").join(g.nodes.select(F.col("id").alias("src"), F.col("pos").alias("ps")), "src").select("src", "dst", "weight", F.struct("weight", "ps", "pos", "src", "dst").alias("rank")))
    label = cut(g.nodes.select("id", F.col("id").alias("root")))
    chosen = e.where(F.lit(False))
    while True:
        ends = e.join(label.select(F.col("id").alias("src"), F.col("root").alias("ra")), "src").join(label.select(F.col("id").alias("dst"), F.col("root").alias("rb")), "dst").where("ra <> rb")
        out = ends.select("src", "dst", "weight", "rank", F.explode(F.array("ra", "rb")).alias("part"))
        least = out.groupBy("part").agg(F.min_by(F.struct("src", "dst", "weight", "rank"), "rank").alias("e")).select("e.*").distinct()
        least = cut(least)
        if least.isEmpty():
            break
        chosen = cut(chosen.unionByName(least.select(*chosen.columns)))
        roots = components(chosen.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        label = cut(g.nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    return chosen.orderBy("rank").select("src", "dst", "weight")


def mst_weight(g: Graph) -> float:
    return kruskal_mst(g).agg(F.sum("weight")).first()[0] or 0.0

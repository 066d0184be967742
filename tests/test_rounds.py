"""Distributed forms against sequential ones written out here."""

import random
from collections import deque

import pytest

from lattica.graph import Graph
from lattica.operators import centrality as C
from lattica.operators import dag as D
from lattica.operators import structure as T
from lattica.plans import frontiers


def low_links(edges):
    """Bridges, cut nodes and blocks by a depth-first search."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    when, low, bridges, points, blocks = {}, {}, set(), set(), []
    for root in near:
        if root in when:
            continue
        when[root] = low[root] = len(when)
        walk, trail, kids = [(root, None, iter(sorted(near[root])))], [], 0
        while walk:
            u, up, rest = walk[-1]
            v = next(rest, None)
            if v is None:
                walk.pop()
                if up is None:
                    continue
                low[up] = min(low[up], low[u])
                if low[u] > when[up]:
                    bridges.add((min(u, up), max(u, up)))
                if low[u] >= when[up]:
                    kids += up == root
                    if up != root:
                        points.add(up)
                    block = set()
                    while True:
                        e = trail.pop()
                        block |= set(e)
                        if e == (up, u):
                            break
                    blocks.append(tuple(sorted(block)))
            elif v not in when:
                when[v] = low[v] = len(when)
                trail.append((u, v))
                walk.append((v, u, iter(sorted(near[v]))))
            elif v != up and when[v] < when[u]:
                trail.append((u, v))
                low[u] = min(low[u], when[v])
        if kids > 1:
            points.add(root)
    return bridges, points, sorted(blocks)


def test_blocks_of_many_graphs(spark):
    """Forty random graphs, a path and a ring of 1,500 nodes each, and a star, side by side in one."""
    rng, edges = random.Random(4), set()
    for k in range(40):
        n = rng.randint(2, 14)
        for _ in range(rng.randint(1, 2 * n)):
            u, v = rng.sample(range(n), 2)
            edges.add((100 * k + min(u, v), 100 * k + max(u, v)))
    edges |= {(10_000 + i, 10_001 + i) for i in range(1500)}
    edges |= {(20_000 + i, 20_000 + (i + 1) % 1500) for i in range(1500)}
    edges |= {(30_000, 30_000 + i) for i in range(1, 200)}
    order = sorted(edges)
    rng.shuffle(order)
    g = Graph.from_frame(spark.createDataFrame(order, "src long, dst long")).cut()
    found = T.blocks(g)
    bridges, points, blocks = low_links(edges)
    assert {tuple(r) for r in T.bridges(g, found).collect()} == bridges
    assert {r["id"] for r in T.articulation_points(g, found).collect()} == points
    assert sorted(tuple(r["members"]) for r in T.biconnected_components(g, found).collect()) == blocks


@pytest.mark.parametrize("directed", [False, True])
def test_centralities_in_batches(spark, monkeypatch, directed):
    rng = random.Random(6)
    edges = list({tuple(rng.sample(range(24), 2)) for _ in range(40)})
    g = Graph.from_edges(spark, edges, directed, [90]).cut()
    near = {n: set() for n in [*range(24), 90]}
    for u, v in edges:
        near[u].add(v)
        if not directed:
            near[v].add(u)
    ids = sorted(r["id"] for r in g.nodes.collect())
    through, close, harmonic = dict.fromkeys(ids, 0.0), {}, {}
    for s in ids:
        dist, count, queue, before = {s: 0}, {s: 1}, deque([s]), {s: []}
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if v not in dist:
                    dist[v], count[v], before[v] = dist[u] + 1, 0, []
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    count[v] += count[u]
                    before[v].append(u)
        rest = dict.fromkeys(dist, 0.0)
        for v in sorted(dist, key=dist.get, reverse=True):
            for u in before[v]:
                rest[u] += count[u] / count[v] * (1 + rest[v])
            if v != s:
                through[v] += rest[v]
        close[s] = (len(ids) - 1) / sum(dist.values()) if len(dist) > 1 else 0.0
        harmonic[s] = sum(1 / d for d in dist.values() if d)
    monkeypatch.setattr(frontiers, "PAIRS", 12 * len(ids))  # three batches
    monkeypatch.setattr(frontiers, "TOGETHER", 2)
    scale = 1 / ((len(ids) - 1) * (len(ids) - 2))
    got = lambda df: {r["id"]: r["score"] for r in df.collect()}
    assert got(C.betweenness_centrality(g)) == pytest.approx({k: x * scale for k, x in through.items()})
    assert got(C.closeness_centrality(g)) == pytest.approx(close)
    if directed:
        assert got(C.harmonic_centrality(g)) == pytest.approx(harmonic)


def test_dag_programmes(spark):
    rng = random.Random(2)
    n = 18
    arcs = [(u, v, float(rng.randint(-2, 6))) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5]
    g = Graph.from_edges(spark, arcs, True, range(n)).cut()
    best, ways = [0.0] * n, [0] * n
    ways[0] = 1
    for u in range(n):
        for a, b, w in arcs:
            if a == u:
                best[b] = max(best[b], best[u] + w)
                ways[b] += ways[u]
    length, path = D.dag_longest_path(g)
    weight = {(u, v): w for u, v, w in arcs}
    assert length == max(best) == sum(weight[e] for e in zip(path, path[1:], strict=False))
    assert D.count_paths(g, 0, n - 1) == ways[n - 1] and D.count_paths(g, n - 1, 0) == 0 and D.count_paths(g, 3, 3) == 1
    took = [float(rng.randint(0, 5)) for _ in range(n)]
    rows, whole, path = D.critical_path(g, dict(enumerate(took)))
    es, lf = [0.0] * n, [0.0] * n
    for u in range(n):
        es[u] = max((es[a] + took[a] for a, b, _ in arcs if b == u), default=0.0)
    end = max(es[u] + took[u] for u in range(n))
    for u in reversed(range(n)):
        lf[u] = min((lf[b] - took[b] for a, b, _ in arcs if a == u), default=end)
    assert whole == end and {r["id"]: (r["es"], r["lf"]) for r in rows.collect()} == {u: (es[u], lf[u]) for u in range(n)}
    assert sum(took[u] for u in path) == end


def test_many_paths(spark):
    """Twenty-six diamonds of 40 ways each, one behind the other: more paths than 64 bits or 38 digits hold."""
    arcs = []
    for k in range(26):
        arcs += [(100 * k, 100 * k + j) for j in range(1, 41)] + [(100 * k + j, 100 * (k + 1)) for j in range(1, 41)]
    g = Graph.from_edges(spark, arcs, True).cut()
    assert D.count_paths(g, 0, 2600) == 40**26


def test_cycles_are_told(spark):
    g = Graph.from_edges(spark, [(0, 1), (1, 2), (2, 1)], True)
    for f in (D.dag_longest_path, D.topological_generations, lambda x: D.count_paths(x, 0, 2), lambda x: D.critical_path(x, {0: 1, 1: 1, 2: 1})):
        with pytest.raises(D.CycleError):
            f(g)

import itertools
import random

from lattica.graph import Graph
from lattica.operators import structure as T
from lattica.plans.layers import layers


def by_force(nodes, edges):
    """Maximal cliques of a small graph, from all its sets of nodes."""
    near = {v: {u for e in edges for u in e if v in e and u != v} for v in nodes}
    whole = [set(c) for k in range(1, len(nodes) + 1) for c in itertools.combinations(nodes, k) if all(v in near[u] for u, v in itertools.combinations(c, 2))]
    return {tuple(sorted(c)) for c in whole if not any(c < d for d in whole)}


def test_cliques(spark):
    """Thirty random graphs in one, some dense, with nodes that no edge meets."""
    rng, edges, nodes, wanted = random.Random(8), [], [], set()
    for k in range(30):
        own = [100 * k + i for i in range(rng.randint(1, 9))]
        some = [e for e in itertools.combinations(own, 2) if rng.random() < rng.choice((0.3, 0.6, 0.95))]
        wanted |= by_force(own, some)
        nodes += own
        edges += [e if rng.random() < 0.5 else e[::-1] for e in some]
    for directed in (False, True):
        g = Graph.from_frame(spark.createDataFrame(edges, "src long, dst long"), directed, spark.createDataFrame([(v,) for v in nodes], "id long"))
        found = [tuple(r["members"]) for r in T.find_cliques(g).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    assert {tuple(r["members"]) for r in T.find_cliques(g, 3).collect()} == {c for c in wanted if len(c) >= 3}


def test_hub_and_nothing(spark):
    """A hub on a circle: a clique for each arc of it; and a graph without edges."""
    n = 60
    edges = [(0, i) for i in range(1, n + 1)] + [(i, i % n + 1) for i in range(1, n + 1)]
    found = T.find_cliques(Graph.from_edges(spark, edges)).collect()
    assert sorted(r["members"] for r in found) == sorted(sorted([0, i, i % n + 1]) for i in range(1, n + 1))
    bare = Graph.from_frame(spark.createDataFrame([], "src long, dst long"), False, spark.createDataFrame([(4,)], "id long"))
    assert [tuple(r) for r in T.find_cliques(bare).collect()] == [(1, [4])]


def test_few_come_later(spark):
    """In a forest of stars no node has more than four neighbours later."""
    edges = [(1000 * s, 1000 * s + i) for s in range(5) for i in range(1, 50)]
    at = {r["id"]: (r["layer"], r["id"]) for r in layers(spark.createDataFrame(edges, "a long, b long")).collect()}
    later = {}
    for a, b in edges:
        later[min(a, b, key=at.get)] = later.get(min(a, b, key=at.get), 0) + 1
    assert len(at) == 250 and max(later.values()) <= 4

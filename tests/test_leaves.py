"""Distances with leaves put back, against searches from every node."""

import random
from collections import deque

import pytest

from lattica.graph import Graph
from lattica.operators import centrality as C
from lattica.operators import kernels
from lattica.operators import paths as P


def searched(edges, ids):
    near = {n: {} for n in ids}
    for u, v, w in edges:
        near[u][v] = near[v][u] = w
    hops, weights = {}, {}
    for s in ids:
        hops[s, s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if (s, v) not in hops:
                    hops[s, v] = hops[s, u] + 1
                    queue.append(v)
        weights[s, s] = 0.0
        for _ in ids:
            for u, v, w in edges + [(v, u, w) for u, v, w in edges]:
                if (s, u) in weights and weights[s, u] + w < weights.get((s, v), 1e9):
                    weights[s, v] = weights[s, u] + w
    return near, hops, weights


def hairy(parts=1):
    """Rings with many leaves each, beside a pair and a star."""
    rng, edges = random.Random(3), []
    for k in range(parts):
        edges += [(100 * k + i, 100 * k + (i + 1) % 7, float(rng.randint(1, 4))) for i in range(7)]
        edges += [(100 * k + rng.randrange(7), 100 * k + j, float(rng.randint(1, 4))) for j in range(20, 45)]
    return edges


@pytest.mark.parametrize("edges", [hairy(), [*hairy(), (900, 901, 2.0), (950, 951, 1.0), (950, 952, 3.0)]])
def test_leaves_are_put_back(spark, edges, monkeypatch):
    monkeypatch.setattr(kernels, "FRAME_ROWS", 5)
    ids = sorted({x for u, v, _ in edges for x in (u, v)})
    near, hops, weights = searched(edges, ids)
    g = Graph.from_edges(spark, edges).cut()
    for weighted, want in ((False, hops), (True, weights)):
        rows = P.floyd_warshall(g, weighted).collect()
        assert {(r["src"], r["dst"]): r["distance"] for r in rows} == want and len(rows) == len(want)
        for r in rows:
            if r["src"] == r["dst"]:
                assert r["next"] is None
            else:
                step = near[r["src"]][r["next"]] if weighted else 1
                assert step + want[r["next"], r["dst"]] == r["distance"]
    n = len(ids)
    through = dict.fromkeys(ids, 0.0)
    count = {(s, s): 1 for s in ids}
    for s in ids:
        for v in sorted((v for v in ids if (s, v) in hops), key=lambda v: hops[s, v]):
            if v != s:
                count[s, v] = sum(count[s, u] for u in near[v] if hops[s, u] == hops[s, v] - 1)
    for s, t in hops:
        for v in ids:
            if s != t and v not in (s, t) and (s, v) in hops and hops[s, v] + hops[v, t] == hops[s, t]:
                through[v] += count[s, v] * count[v, t] / count[s, t]
    got = lambda df: {r[0]: r[1] for r in df.collect()}
    assert got(C.betweenness_centrality(g, False)) == pytest.approx({v: x / 2 if n > 2 else 0.0 for v, x in through.items()})
    assert got(C.harmonic_centrality(g)) == pytest.approx({s: sum(1 / d for (a, _), d in hops.items() if a == s and d) for s in ids})
    assert got(C.closeness_centrality(g)) == pytest.approx({s: (n - 1) / sum(d for (a, _), d in hops.items() if a == s) for s in ids})
    if len(hops) == n * n:
        assert got(P.eccentricity(g)) == {s: max(d for (a, _), d in hops.items() if a == s) for s in ids}
        f = P.distance_figures(g)
        assert f["wiener_index"] == sum(hops.values()) / 2 and f["radius"] == min(got(P.eccentricity(g)).values())
    else:
        with pytest.raises(ValueError, match="connected"):
            P.eccentricity(g)

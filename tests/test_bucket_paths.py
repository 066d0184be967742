import random

import pytest

from lattica.graph import Graph
from lattica.operators import paths as P


def test_buckets_against_a_heap(spark, monkeypatch):
    """A random graph with weights of 0 and ties, for narrow and wide buckets: distances, sound predecessors, fewer rounds in wider ones."""
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)): rng.choice((0.0, 0.5, 1.0, 2.5, 7.0)) for _ in range(110)}
    g = Graph.from_frame(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"), True).cut()
    source = min(a for a, _ in edges)
    adj = [[(b, w) for (a, b), w in edges.items() if a == v] for v in range(40)]
    wanted, _ = P.relaxed(adj, source)
    rounds = []
    real = P.round_cut
    monkeypatch.setattr(P, "round_cut", lambda df: (rounds.append(1), real(df))[1])
    counts = []
    for width in (0.7, None, 100.0):
        rounds.clear()
        rows = {r["id"]: r for r in P.dijkstra_shortest_path(g, source, width=width).collect()}
        counts.append(len(rounds))
        assert {v: r["distance"] for v, r in rows.items()} == wanted
        for v in rows:
            steps, u = 0, v
            while u != source:
                p = rows[u]["previous"]
                assert rows[p]["distance"] + edges[p, u] == rows[u]["distance"]
                u, steps = p, steps + 1
                assert steps < 40
    assert counts[2] < counts[0]


def test_target_and_negative_arcs(spark):
    """With a target nothing beyond its bucket is told; negative arcs matter only where they can be reached."""
    line = [(i, i + 1, 1.0) for i in range(12)]
    g = Graph.from_edges(spark, line, True).cut()
    near = {r["id"]: r["distance"] for r in P.dijkstra_shortest_path(g, 0, 3).collect()}
    assert near[3] == 3.0 and max(near) < 6 and 12 not in near
    far = Graph.from_edges(spark, [*line[:3], (20, 21, -1.0)], True).cut()
    assert P.dijkstra_shortest_path(far, 0).count() == 4
    with pytest.raises(ValueError, match="negative"):
        P.dijkstra_shortest_path(far, 20)

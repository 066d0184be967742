"""Katz centrality by a set number of rounds, where more would never settle."""

import pytest

from lattica.graph import Graph
from lattica.operators import centrality as C
from lattica.operators import vectors


def test_rounds_without_tolerance(spark, monkeypatch):
    g = Graph.from_edges(spark, [(0, i, 4.0) for i in range(1, 30)]).cut()
    with pytest.raises(C.ConvergenceError):
        C.katz_centrality(g, alpha=0.1)
    hub = leaf = 0.0
    for _ in range(6):
        hub, leaf = 0.1 * 29 * 4 * leaf + 1, 0.1 * 4 * hub + 1
    for most in (vectors.MOST_ARCS, 0):
        monkeypatch.setattr(vectors, "MOST_ARCS", most)
        got = {r["id"]: r["score"] for r in C.katz_centrality(g, alpha=0.1, max_iter=6, tol=None, normalized=False).collect()}
        assert got == pytest.approx({0: hub} | dict.fromkeys(range(1, 30), leaf))

"""Heaviest paths from blocks of nodes, against a walk in order."""

import random

import pytest

from lattica.graph import Graph
from lattica.operators import dag as D
from lattica.plans import sweep


def heaviest(n, arcs, place):
    """``{id: (length, previous, generation)}`` of arcs that go up in ``place``."""
    out = {}
    for v in sorted(range(n), key=place.__getitem__):
        before = [(u, w) for u, x, w in arcs if x == v]
        generation = max((out[u][2] + 1 for u, _ in before), default=0)
        best = max(((out[u][0] + w, -out[u][2], -u) for u, w in before), default=(0.0,))
        out[v] = (best[0], -best[2], generation) if best[0] > 0 else (0.0, None, generation)
    return out


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_many_blocks(spark, monkeypatch, order):
    """Ties, negative weights and nodes without arcs, in blocks that come before each other in their order, against it, and both ways."""
    rng, n = random.Random(5), 60
    place = list(range(n)) if order == "up" else list(range(n))[::-1] if order == "down" else rng.sample(range(n), n)
    pairs = {tuple(sorted(rng.sample(range(n), 2), key=place.__getitem__)) for _ in range(240)}
    arcs = [(u, v, float(rng.randint(-2, 3))) for u, v in sorted(pairs)]
    wanted = heaviest(n, arcs, place)
    monkeypatch.setattr(sweep, "BLOCK_ROWS", 60)
    g = Graph.from_frame(spark.createDataFrame(arcs, "src long, dst long, weight double"), True, spark.createDataFrame([(k,) for k in range(n)], "id long"))
    assert {r["id"]: (r["length"], r["previous"], r["generation"]) for r in D.longest_paths(g).collect()} == wanted
    assert {r["id"]: r["generation"] for r in D.topological_generations(g).collect()} == {v: x[2] for v, x in wanted.items()}


def test_a_chain_costs_blocks_not_generations(spark):
    """Jobs of a path of 400 nodes."""
    g = Graph.from_frame(spark.createDataFrame([(k, k + 1) for k in range(400)], "src long, dst long"), True)
    spark.sparkContext.setJobGroup("chain", "")
    assert D.longest_paths(g).where("length = generation").count() == 401
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 60
    spark.sparkContext.setJobGroup("rest", "")


def test_cycle_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sweep, "BLOCK_ROWS", 8)
    g = Graph.from_edges(spark, [(k, k + 1) for k in range(20)] + [(17, 3)], True)
    with pytest.raises(D.CycleError):
        D.longest_paths(g)

import random

import pytest

from lattica.functions import Graph
from lattica.operators import centrality as C
from lattica.plans import cores


def _peeled(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


@pytest.mark.parametrize("size", [40, 10_000])
def test_core_numbers_of_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(cores, "BLOCK_ARCS", size)
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(50), 2))) for _ in range(160)} | {(100 + i, 101 + i) for i in range(30)} | {(0, 200)})
    assert {r["id"]: r["core"] for r in C.core_number(Graph.from_edges(spark, edges, nodes=[999])).collect()} == _peeled(edges) | {999: 0}


def test_blocks_alone_take_no_rounds_between_them(spark, monkeypatch):
    """A long path falls end by end, a round an arc, unless a block settles it by itself."""
    edges = [(i, i + 1) for i in range(400)]
    g = Graph.from_edges(spark, edges + [(400, 401), (401, 402), (400, 402)])
    got = {r["id"]: r["core"] for r in C.core_number(g, 1).collect()}
    assert got == {i: 2 if i >= 400 else 1 for i in range(403)}

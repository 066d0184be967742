import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.functions import Graph
from lattica.operators import similarity as S
from lattica.plans import wedges


def _expected(edges, metric, k):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    value = {S.common_neighbors_scores: lambda d: 1.0, S.adamic_adar_scores: lambda d: 1 / np.log(d), S.resource_allocation_scores: lambda d: 1 / d}[metric]
    rows = [(-round(sum(value(len(near[m])) for m in sorted(near[u] & near[v])), 9), u, v) for u, v in itertools.combinations(sorted(near), 2) if v not in near[u]]
    return [(u, v, -s) for s, u, v in sorted(rows)[:k]]


@pytest.mark.parametrize("metric", [S.common_neighbors_scores, S.adamic_adar_scores, S.resource_allocation_scores])
def test_best_pairs_of_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(wedges, "BLOCK_EDGES", 60)
    monkeypatch.setattr(wedges, "GROUP_ITEMS", 400)
    monkeypatch.setattr(wedges, "HELD", 20)
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(220)})
    got = [(r["u"], r["v"], round(r["score"], 9) + 0.0) for r in S.predicted_links(Graph.from_edges(spark, edges), metric, 12).collect()]
    assert got == _expected(edges, metric, 12)


def test_fewer_pairs_than_asked_for(spark):
    g = Graph.from_edges(spark, [(0, 1), (1, 2), (3, 4)])
    got = [tuple(r) for r in S.predicted_links(g, S.common_neighbors_scores, 4).collect()]
    assert got == [(0, 2, 1.0), (0, 3, 0.0), (0, 4, 0.0), (1, 3, 0.0)]


def test_no_wedge_is_made_into_a_row():
    """A hub's 2,000 leaves make 1,999,000 pairs, of which a block hands on the best alone."""
    leaves = list(range(1, 2001))
    rows = [(0, False, 0, 1.0, leaves)] + [(0, True, v, 1.0, [0]) for v in leaves]
    table = pa.Table.from_pylist([dict(zip(wedges._LISTS.names, r, strict=True)) for r in rows], schema=wedges._LISTS)
    assert wedges._best(table, 3).to_pylist() == [{"u": 1, "v": v, "score": 1.0} for v in (2, 3, 4)]

"""Distances in hops over arcs that stay in their buckets."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import paths as P
from lattica.plans import buckets


def distances(arcs, s):
    dist, queue = {s: 0}, deque([s])
    while queue:
        u = queue.popleft()
        for a, b in arcs:
            if a == u and b not in dist:
                dist[b] = dist[u] + 1
                queue.append(b)
    return dist


@pytest.mark.parametrize("kind", ["pairs", "undirected", "directed"])
def test_many_buckets(spark, monkeypatch, kind):
    """Random edges, a path of 6 beside them, and sources that aren't there, alone and together."""
    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)}) + [(100 + k, 101 + k) for k in range(6)]
    df = spark.createDataFrame(edges, "src long, dst long")
    g = Graph.from_pairs(df) if kind == "pairs" else Graph.from_frame(df, kind == "directed")
    arcs = edges if kind == "directed" else edges + [(b, a) for a, b in edges]
    monkeypatch.setattr(buckets, "BUCKET_ARCS", 9)
    for some in ([100], [edges[0][0], 100, 105, 9999]):
        wanted = {(s, v, k) for s in some if s != 9999 for v, k in distances(arcs, s).items()}
        rows = P.multi_source_bfs(g, spark.createDataFrame([(s,) for s in some], "source long")).collect()
        assert len(rows) == len(wanted) and {tuple(r) for r in rows} == wanted
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lattica_arcs")]


def test_arcs_stay_in_their_buckets(spark, monkeypatch):
    """No join of a round has the arcs below an exchange."""
    plans, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    g = Graph.from_pairs(spark.range(2000).select((F.col("id") % 300).alias("src"), (1000 + F.col("id") % 7 + F.col("id") % 300).alias("dst")).distinct())
    assert g.bfs_distances(1).count() == g.nodes.count()
    rounds = [p for p in plans if "Anti" in p and "Scan parquet" in p]
    assert rounds
    for plan in rounds:
        lines = plan.split("\n")
        scan = next(k for k, line in enumerate(lines) if "Scan parquet" in line)
        join = max(k for k in range(scan) if "Join" in lines[k] and "Anti" not in lines[k])
        assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in lines[join:scan])

"""Pairs of large tables in tasks of bounded size, each kept once, and scores from lists of neighbours."""

import math

from lattica.functions import Graph
from lattica.operators import similarity as S
from lattica.sources import tables

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_LINES", 500)
    lines = tables.read(spark, SF, "lineitem").count()
    for g in (tables.part_graph(spark, SF), tables.part_supplier(spark, SF)):
        assert g.pairs.rdd.getNumPartitions() >= lines / 500


def test_cut_keeps_each_pair_once(spark):
    g = tables.part_graph(spark, SF)
    c = g.cut()
    assert {tuple(r) for r in c.arcs.collect()} == {tuple(r) for r in g.arcs.collect()}
    assert {tuple(r) for r in c.nodes.collect()} == {tuple(r) for r in g.nodes.collect()}
    assert c.pairs is not None and 2 * c.pairs.count() == c.arcs.count() and c.number_of_edges() == c.pairs.count()


def test_scores_from_lists(spark):
    edges = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4), (4, 4), (4, 0), (5, 4)]
    near: dict[int, set[int]] = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    pairs = [(0, 1), (0, 3), (3, 3), (4, 3), (4, 4), (2, 9), (9, 9), (5, 0)]
    g = Graph.from_edges(spark, edges, nodes=[7])

    def scores(f):
        return [r["score"] for r in f(g, pairs).orderBy("pair_pos").collect()]

    both = [(near.get(u, set()) - {u, v}, near.get(v, set()) - {u, v}) for u, v in pairs]
    assert scores(S.common_neighbors_scores) == [len(a & b) for a, b in both]
    assert scores(S.jaccard_scores) == [len(a & b) / len(a | b) if a | b else 0 for a, b in both]
    want = [sum(1 / math.log(len(near[x])) for x in a & b if len(near[x]) > 1) for a, b in both]
    assert all(math.isclose(x, y) for x, y in zip(scores(S.adamic_adar_scores), want, strict=True))
    assert [p.name for p in S._met(g, S.pairs_frame(g, pairs)).schema] == ["pair_pos", "yu", "yv", "met"]

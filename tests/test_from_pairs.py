"""Graphs of distinct pairs are those of any edges, without a search for repeats."""

from lattica.graph import Graph


def test_from_pairs(spark):
    df = spark.createDataFrame([(5, 9, 2.0), (1, 9, 1.5), (-3, 5, 4.0)], "src long, dst long, weight double")
    one, other = Graph.from_pairs(df), Graph.from_frame(df)
    for a, b in ((one.nodes, other.nodes), (one.arcs, other.arcs), (one.edges(), other.edges()), (one.cut().edges(), other.edges()), (one.degrees(), other.degrees())):
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = one.edges()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan

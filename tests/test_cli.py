"""Every command, the report, streams and the driver's contract."""

import pytest

import __spark_entry__
from lattica.cli import COMMANDS, main
from lattica.graph import Graph
from lattica.report import compose_report
from lattica.streaming.degrees import running_degrees, windowed_edges


@pytest.fixture
def edges(tmp_path):
    f = tmp_path / "e.txt"
    f.write_text("0 1 2\n0 2 1\n1 3 1\n2 3 5\n")
    return str(f)


@pytest.mark.parametrize(
    ("args", "code", "text"),
    [
        (["stats"], 0, "n_nodes: 34"),
        (["centrality", "--measure", "pagerank", "--top", "1"], 0, "33"),
        (["clustering"], 0, "average: 0.570638"),
        (["communities", "--method", "label-propagation"], 0, "modularity"),
        (["shortest-path", "--source", "0", "--target", "33"], 0, "distance: 2"),
        (["distances"], 0, "diameter: 5"),
        (["connectivity"], 0, "(0, 11)"),
        (["cliques"], 0, "maximal cliques: 36"),
        (["flow", "--unit"], 0, "value: 10"),
        (["link-prediction", "--u", "0", "--v", "33", "--top-pairs", "2"], 0, "jaccard"),
        (["similar", "--node", "0", "--top", "2"], 0, "score"),
        (["coloring", "--exact"], 0, "chromatic number: 5"),
        (["eulerian"], 1, "odd degree: 12"),
        (["isomorphism", "--limit", "10"], 0, "automorphisms: 10"),
        (["matching"], 0, "size: 13"),
        (["flow", "--sink", "99"], 2, ""),
    ],
)
def test_commands(spark, capsys, args, code, text):
    assert main(args, spark) == code
    assert text in capsys.readouterr().out


def test_commands_on_files(spark, capsys, edges, tmp_path):
    assert main(["dag", "--edges", edges, "--weighted", "--durations", "0=1,1=2,2=3,3=1"], spark) == 0
    assert "duration: 5" in capsys.readouterr().out
    assert main(["dominators", "--edges", edges, "--root", "0", "--post", "3"], spark) == 0
    assert main(["tsp", "--edges", edges, "--weighted"], spark) == 0
    assert "optimal: True" in capsys.readouterr().out
    assert main(["demo", "--output", str(tmp_path / "r" / "x.md")], spark) == 0
    assert (tmp_path / "r" / "x.md").read_text().startswith("# Graph report")
    assert len(COMMANDS) == 19


def test_report(spark):
    assert "## PageRank" in compose_report(Graph.from_edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]).cut())


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 00:20:00"), (1, 2, "2024-01-01 02:00:00")], "src long, dst long, ts string").selectExpr("src", "dst", "cast(ts as timestamp) ts")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = running_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["degree"] for r in spark.table("deg").collect()} == {1: 3, 2: 2, 3: 1}
    assert windowed_edges(e).count() == 3


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 10
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(o) > 70


def test_edge_list_in_splits(spark, tmp_path):
    """Lines of several files, read in many splits, keep their order."""
    from lattica.sources.edge_list import from_edge_list

    edges = [(i * 7919 % 1009, i * 104729 % 997 + 2000) for i in range(900)]
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("# u v\n" + "".join(f"{u} {v}\n" for u, v in edges[300 * k : 300 * (k + 1)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        g = from_edge_list(spark, str(tmp_path))
        nodes = [r["id"] for r in g.node_labels().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert nodes == list(dict.fromkeys(n for e in edges for n in e))

"""A Markdown report of a graph."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import centrality, coloring, community, flow, local, paths, similarity, structure


def _table(df: DataFrame, n: int) -> list[str]:
    rows = df.take(n)
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def compose_report(g: Graph, top: int = 5) -> str:
    """Summary, rankings, communities, structure and predicted links."""
    best = lambda df: df.orderBy(F.desc("score"), "id")
    hits = centrality.hits(g)
    scores = {
        "Degree": centrality.degree_centrality(g), "Closeness": centrality.closeness_centrality(g), "Harmonic": centrality.harmonic_centrality(g),
        "Betweenness": centrality.betweenness_centrality(g), "PageRank": centrality.pagerank(g), "Eigenvector": centrality.eigenvector_centrality(g),
        "Hubs": hits.select("id", F.col("hub").alias("score")), "Authorities": hits.select("id", F.col("authority").alias("score")),
        "Core number": centrality.core_number(g).select("id", F.col("core").alias("score")),
    }
    out = ["# Graph report", ""] + [f"- {k}: {v}" for k, v in g.summary().first().asDict().items()]
    out += [f"- degree assortativity: {local.degree_assortativity(g):.4f}", f"- average clustering: {local.average_clustering(g):.4f}", f"- triangles: {local.total_triangles(g)}", ""]
    for name, df in scores.items():
        out += [f"## {name}", "", *_table(best(df), top)]
    for name, df in {"Louvain": community.communities(g), "Label propagation": community.label_propagation(g)}.items():
        df = df.cache()
        out += [f"## {name} communities", "", f"Modularity {community.modularity(g, df):.4f}", ""]
        out += _table(df.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members")).orderBy("community"), 1000)
    if g.is_connected():
        d = paths.distance_summary(g)
        out += ["## Distances", "", *(f"- {k}: {d[k]}" for k in ("diameter", "radius", "center", "periphery", "average_shortest_path_length", "wiener_index", "global_efficiency")), ""]
    c = structure.cut_structure(g)
    out += ["## Structure", "", f"- bridges: {c['bridges']}", f"- articulation points: {c['articulation_points']}", f"- maximal cliques: {structure.number_of_maximal_cliques(g)}", f"- maximum matching: {flow.maximum_matching(g).count()} edges", ""]
    out += ["## Colours by strategy", "", *_table(coloring.coloring_summary(g), 10), "## Predicted links", "", *_table(similarity.predicted_links(g, k=top), top)]
    return "\n".join(out) + "\n"


def write_report(g: Graph, path: str) -> str:
    """Write the report and return where."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(compose_report(g))
    return path

"""Command line: ``python -m lattica COMMAND``. Exit codes: 0, 1 not found, 2 wrong input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import centrality, coloring, community, dag, flow, isomorphism, local, paths, similarity, structure, tours
from lattica.report import write_report
from lattica.sources.edge_list import from_edge_list

MEASURES = {
    "degree": lambda g, a: centrality.degree_centrality(g),
    "closeness": lambda g, a: centrality.closeness_centrality(g),
    "harmonic": lambda g, a: centrality.harmonic_centrality(g),
    "betweenness": lambda g, a: centrality.betweenness_centrality(g),
    "pagerank": lambda g, a: centrality.pagerank(g),
    "personalized-pagerank": lambda g, a: centrality.personalized_pagerank(g, {g.node_labels().first()["id"]: 1.0}),
    "eigenvector": lambda g, a: centrality.eigenvector_centrality(g),
    "katz": lambda g, a: centrality.katz_centrality(g, alpha=0.1 if a is None else a),
    "hubs": lambda g, a: centrality.hits(g).select("id", F.col("hub").alias("score")),
    "authorities": lambda g, a: centrality.hits(g).select("id", F.col("authority").alias("score")),
    "core": lambda g, a: centrality.core_number(g).select("id", F.col("core").alias("score")),
}
PAIR_METRICS = {
    "adamic-adar": similarity.adamic_adar_scores,
    "jaccard": similarity.jaccard_scores,
    "resource-allocation": similarity.resource_allocation_scores,
    "preferential-attachment": similarity.preferential_attachment_scores,
    "common-neighbors": similarity.common_neighbors_scores,
    "katz-index": similarity.katz_index_scores,
    "hub-promoted": similarity.hub_promoted_index_scores,
}


def _show(df: DataFrame, n: int | None = None) -> None:
    print("\t".join(df.columns))
    for r in df.collect() if n is None else df.take(n):
        print("\t".join(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r))


def _ranked(df: DataFrame, n: int) -> None:
    _show(df.orderBy(F.desc("score"), "id"), n)


def demo(g, a):
    print(write_report(g, a.output))


def stats(g, a):
    for k, v in g.summary().first().asDict().items():
        print(f"{k}: {v}")
    print(f"degree assortativity: {local.degree_assortativity(g):.6g}")


def centralities(g, a):
    _ranked(MEASURES[a.measure](g, a.alpha), a.top)


def clustering(g, a):
    _show(local.local_clustering(g).orderBy("id"))
    print(f"average: {local.average_clustering(g):.6g}")


def communities(g, a):
    sweeps = a.max_iter or 100
    if a.method == "louvain":
        found = community.communities(g, sweeps, a.seed)
    elif a.method == "label-propagation":
        found = community.label_propagation(g, sweeps, a.seed)
    elif a.method == "girvan-newman":
        found = community.girvan_newman(g, a.n_communities)
    else:
        found = community.spectral_clustering(g, a.n_communities or 2, a.seed or 0, not a.unnormalized, sweeps)
    found = found.cache()
    _show(found.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members")).orderBy("community"))
    print(f"modularity: {community.modularity(g, found):.6g}")


def shortest_path(g, a):
    found = paths.dijkstra_shortest_path(g, a.source)
    if a.target is None:
        _show(found.orderBy("distance", "id"), a.top)
        return 0
    row = found.where(F.col("id") == a.target).first()
    if row is None:
        print(f"{a.target} isn't reached from {a.source}")
        return 1
    print(f"distance: {row['distance']:.6g}\npath: {paths.reconstruct_path(found, a.source, a.target)}")


def distances(g, a):
    found = paths.distance_summary(g, a.weighted)
    for k, v in found.items():
        if k not in ("eccentricity", "local_efficiency") or a.eccentricity and k == "eccentricity":
            print(f"{k}: {v}")


def connectivity(g, a):
    for k, v in structure.cut_structure(g).items():
        if a.components or not k.endswith("components") or k.startswith("n_"):
            print(f"{k}: {v}")


def cliques(g, a):
    found = structure.find_cliques(g).cache()
    print(f"maximal cliques: {found.count()}\nclique number: {(found.first() or [0])[0]}\ntriangles: {local.total_triangles(g)}")
    _show(found.where(F.col("size") >= a.min_size), a.top or None)


def flows(g, a):
    r = flow.maximum_flow(g, a.source, a.sink, a.unit)
    print(f"value: {r.value:.6g}\ncut edges: {r.cut_edges}\ncut capacity: {r.cut_capacity:.6g}\nedge connectivity: {flow.edge_connectivity(g, a.source, a.sink)}")


def link_prediction(g, a):
    if a.metric == "simrank":
        print(f"simrank: {similarity.simrank_scores(g, [(a.u, a.v)], a.decay).first()['score']:.6g}")
        metric = lambda h, p: similarity.simrank_scores(h, p, a.decay)
    else:
        names = ("adamic-adar", "jaccard") if a.metric == "both" else (a.metric,)
        for name in names:
            print(f"{name}: {PAIR_METRICS[name](g, [(a.u, a.v)]).first()['score']:.6g}")
        metric = PAIR_METRICS[names[0]]
    if a.top_pairs > 0:
        _show(similarity.predicted_links(g, metric, a.top_pairs, similarity.non_edges(g)))


def similar(g, a):
    _show(similarity.most_similar(g, a.node, a.top, a.decay))


def colors(g, a):
    _show(coloring.coloring_summary(g, a.seed))
    _show(coloring.color_classes(coloring.greedy_color(g, a.strategy, a.seed)))
    if a.exact:
        print(f"chromatic number: {coloring.chromatic_number(g)}")


def eulerian(g, a):
    if not coloring.has_eulerian_path(g):
        print(f"no Eulerian path; nodes of odd degree: {coloring.odd_degree_nodes(g).count()}")
        return 1
    circuit = coloring.is_eulerian(g)
    print("circuit" if circuit else "path")
    _show((coloring.eulerian_circuit if circuit else coloring.eulerian_path)(g, a.source))


def isomorphic(g, a):
    print(f"hash: {isomorphism.wl_graph_hash(g, a.iterations)}\nautomorphisms: {isomorphism.automorphism_count(g, a.limit)}")
    _show(isomorphism.color_refinement(g))
    if a.limit is None:
        print(f"orbits: {isomorphism.automorphism_orbits(g)}")
    if a.compare:
        found = isomorphism.find_isomorphism(g, from_edge_list(g.spark, a.compare, a.directed).cut())
        print(f"isomorphic: {found is not None}" + (f"\nmapping: {found}" if found else ""))
        return 0 if found is not None else 1


def dags(g, a):
    cycle = dag.find_cycle(g)
    if cycle:
        print(f"cycle: {cycle}")
        return 1
    print(f"order: {[r['id'] for r in dag.topological_sort(g).orderBy('step').collect()]}\nlongest path: {dag.dag_longest_path(g)}")
    _show(dag.transitive_reduction(g).orderBy("src", "dst"))
    if a.durations:
        given = {int(k): float(v) for k, v in (x.split("=") for x in a.durations.split(","))}
        rows, whole, path = dag.critical_path(g, given)
        _show(rows.orderBy("es", "id"))
        print(f"duration: {whole:.6g}\ncritical path: {path}")


def tour(g, a):
    r = tours.solve_tsp(g, a.method, not a.no_closure, True, n_starts=a.starts)
    print(f"method: {r.method}\ncost: {r.cost:.6g}\ntour: {r.tour}\noptimal: {r.optimal}\nlower bound: {r.lower_bound}\npath: {r.path}")


def matchings(g, a):
    if a.bipartite_weight:
        found = flow.maximum_weight_bipartite_matching(g, None, a.max_cardinality).cache()
        _show(found.orderBy("u", "v"))
        print(f"weight: {found.agg(F.sum('weight')).first()[0] or 0.0:.6g}")
        return
    found = flow.matching_edges(flow.maximum_matching(g)).cache()
    _show(found)
    print(f"size: {found.count()}\nperfect: {flow.is_perfect_matching(g, found)}\nedge cover: {flow.minimum_edge_cover(g).count()}")


def dominance(g, a):
    _show(structure.immediate_dominators(g, a.root).orderBy("id"))
    _show(structure.dominator_tree(g, a.root).orderBy("id"))
    _show(structure.dominance_frontiers(g, a.root).groupBy("id").agg(F.array_sort(F.collect_list("member")).alias("frontier")).orderBy("id"))
    if a.post is not None:
        _show(structure.post_dominators(g, a.post).orderBy("id"))


def _int(name, default=None, **more):
    return f"--{name}", {"type": int, "default": default} | more


def _flag(name):
    return f"--{name}", {"action": "store_true"}


_EDGES = ("--edges", {"default": None})
_NEED_EDGES = ("--edges", {"required": True})
#: Handler and options of each command; ``directed`` is fixed where a command needs it.
COMMANDS = {
    "demo": (demo, [("--output", {"default": "artifacts/demo_report.md"})]),
    "stats": (stats, []),
    "centrality": (centralities, [("--measure", {"choices": list(MEASURES), "default": "degree"}), _int("top", 5), ("--alpha", {"type": float, "default": None})]),
    "clustering": (clustering, []),
    "communities": (communities, [("--method", {"choices": ["louvain", "label-propagation", "girvan-newman", "spectral"], "default": "louvain"}), _int("max-iter"), _int("seed"), _int("n-communities"), _flag("normalized"), _flag("unnormalized")]),
    "shortest-path": (shortest_path, [_int("source", 0), _int("target"), _int("top", 5)]),
    "distances": (distances, [_flag("weighted"), _flag("eccentricity")]),
    "connectivity": (connectivity, [_flag("components")]),
    "cliques": (cliques, [_int("min-size", 3), _int("top", 10)]),
    "flow": (flows, [_int("source", 0), _int("sink", 33), _flag("unit")]),
    "link-prediction": (link_prediction, [_int("u", required=True), _int("v", required=True), _int("top-pairs", 0), ("--metric", {"choices": [*PAIR_METRICS, "simrank", "both"], "default": "both"}), ("--decay", {"type": float, "default": 0.8})]),
    "similar": (similar, [_int("node", required=True), _int("top", 5), ("--decay", {"type": float, "default": 0.8})]),
    "coloring": (colors, [("--strategy", {"choices": coloring.COLORING_STRATEGIES, "default": "dsatur"}), _int("seed", 0), _flag("exact")]),
    "eulerian": (eulerian, [_int("source")]),
    "isomorphism": (isomorphic, [_EDGES, _flag("directed"), ("--compare", {"default": None}), _int("iterations", 3), _int("limit")]),
    "dag": (dags, [_NEED_EDGES, _flag("weighted"), ("--durations", {"default": None})]),
    "tsp": (tour, [_EDGES, _flag("weighted"), _flag("directed"), ("--method", {"choices": tours.METHODS, "default": "auto"}), _flag("no-closure"), _int("starts")]),
    "matching": (matchings, [_EDGES, _flag("weighted"), _flag("bipartite-weight"), _flag("max-cardinality")]),
    "dominators": (dominance, [_NEED_EDGES, _int("root", required=True), _int("post")]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = sub.add_parser(name)
        if "--edges" not in [o for o, _ in options]:
            p.add_argument("--dataset", choices=["karate"], default="karate")
        for option, how in options:
            p.add_argument(option, **how)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    directed = getattr(a, "directed", False) or a.command in ("dag", "dominators")
    try:
        if getattr(a, "edges", None):
            g = from_edge_list(spark, a.edges, directed, weighted=getattr(a, "weighted", False))
        else:
            g = Graph.karate_club(spark)
        return COMMANDS[a.command][0](g.cut(), a) or 0
    except (ValueError, KeyError, ArithmeticError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2

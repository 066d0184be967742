"""Golden values on small graphs, from closed forms and textbooks."""

import math

import numpy as np
import pytest

from lattica.graph import Graph
from lattica.operators import centrality as C
from lattica.operators import coloring as K
from lattica.operators import community as M
from lattica.operators import dag as D
from lattica.operators import flow as W
from lattica.operators import isomorphism as I
from lattica.operators import local as L
from lattica.operators import paths as P
from lattica.operators import similarity as S
from lattica.operators import structure as T
from lattica.operators import tours as R
from lattica.sources.edge_list import from_edge_list


@pytest.fixture(scope="module")
def karate(spark):
    return Graph.karate_club(spark).cut()


def G(spark, edges, directed=False, nodes=()):
    return Graph.from_edges(spark, edges, directed, nodes)


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def as_map(df):
    return {r[0]: r[1] for r in df.collect()}


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[1], []).append(r[0])
    return sorted(sorted(x) for x in out.values())


def test_model(spark, karate, tmp_path):
    assert karate.summary().first().asDict() == {"n_nodes": 34, "n_edges": 78, "directed": False, "density": pytest.approx(78 / 561), "connected": True}
    assert karate.degree(0) == 16 and [r[0] for r in karate.neighbors(4).collect()] == [0, 6, 10]
    g = G(spark, [(1, 2, 3.0), (2, 3), (2, 1, 5.0), (3, 3)], nodes=[9])
    assert [r[0] for r in g.node_labels().collect()] == [1, 2, 3, 9]
    assert g.get_weight(1, 2) == 5.0 and g.has_edge(3, 3) and g.number_of_edges() == 2
    assert [(r.src, r.dst) for r in g.edges().orderBy("pos").collect()] == [(1, 2), (2, 3), (3, 3)]
    with pytest.raises(KeyError):
        g.get_weight(1, 3)
    assert sorted(r[0] for r in g.without_edges([(2, 1)]).nodes.collect()) == [2, 3]
    assert as_map(g.connected_components()) == {1: 1, 2: 1, 3: 1, 9: 9} and not g.is_connected()
    f = tmp_path / "e.txt"
    f.write_text("# c\n1 2 0.5\n\n2\t3  7\n")
    h = from_edge_list(spark, str(f), weighted=True)
    assert h.get_weight(2, 3) == 7.0 and h.number_of_edges() == 2
    f.write_text("1,2\n2,3\n")
    assert from_edge_list(spark, str(f), directed=True, delimiter=",").number_of_edges() == 2


def test_growing(spark):
    g = G(spark, [(5, 1), (1, 2)]).add_edge(2, 7, 3.0).add_node(4).add_edge(1, 5, 9.0)
    assert [r[0] for r in g.node_labels().collect()] == [5, 1, 2, 7, 4] and len(g) == 5
    assert g.get_weight(5, 1) == 9.0 and g.get_weight(7, 2) == 3.0 and g.number_of_edges() == 3
    assert repr(g) == "Graph(nodes=5, edges=3, directed=False)"
    assert [r.members for r in M.members(M.label_propagation(g)).collect()] == [[1, 5], [2, 7], [4]]


def test_centrality(spark, karate):
    p = G(spark, path(4))
    assert as_map(C.betweenness_centrality(p)) == pytest.approx({0: 0, 1: 2 / 3, 2: 2 / 3, 3: 0})
    assert as_map(C.betweenness_centrality(p, False)) == pytest.approx({0: 0, 1: 2, 2: 2, 3: 0})
    assert as_map(C.closeness_centrality(p))[0] == pytest.approx(3 / 6)
    assert as_map(C.harmonic_centrality(p))[0] == pytest.approx(1 + 1 / 2 + 1 / 3)
    ring = G(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    assert as_map(C.pagerank(ring)) == pytest.approx(dict.fromkeys(range(4), 0.25))
    assert as_map(C.eigenvector_centrality(ring)) == pytest.approx(dict.fromkeys(range(4), 0.5))
    assert as_map(C.katz_centrality(ring, normalized=False)) == pytest.approx(dict.fromkeys(range(4), 1 / 0.8), abs=1e-5)
    star = G(spark, [(0, 1), (0, 2), (0, 3)], True)
    h = {r[0]: (r[1], r[2]) for r in C.hits(star).collect()}
    assert h[0] == pytest.approx((1, 0)) and h[1] == pytest.approx((0, 1 / math.sqrt(3)))
    assert sum(as_map(C.pagerank(star)).values()) == pytest.approx(1)
    ppr = as_map(C.personalized_pagerank(ring, {0: 1.0}))
    assert ppr[0] > ppr[1] > ppr[2]
    core = as_map(C.core_number(karate))
    assert max(core.values()) == 4 and core[0] == core[33] == 4
    assert [r[1] for r in C.voterank(karate, 4).collect()] == [33, 0, 32, 2]
    with pytest.raises(ValueError):
        C.pagerank(ring, alpha=1.5)
    with pytest.raises(ArithmeticError):
        C.katz_centrality(ring, alpha=0.9, max_iter=5)


def test_similarity(spark):
    tri = G(spark, [(0, 1), (1, 2), (0, 2)])
    assert S.adamic_adar(tri, 0, 1) == pytest.approx(1 / math.log(2)) and S.jaccard(tri, 0, 1) == 1.0
    assert S.common_neighbors(tri, 0, 1) == 1.0 and S.resource_allocation(tri, 0, 1) == 0.5
    assert S.preferential_attachment(tri, 0, 1) == 4.0 and S.hub_promoted_index(tri, 0, 1) == 0.5
    assert S.jaccard(tri, 0, 77) == 0.0
    assert S.katz_index(G(spark, path(3)), 0, 2, 0.1) == pytest.approx(0.010204081632653062)
    s = {(r.u, r.v): r.score for r in S.simrank_matrix(G(spark, [(0, 1), (0, 2)], True)).collect()}
    assert s[1, 2] == pytest.approx(0.8) and s[0, 1] == 0
    assert [r[0] for r in S.most_similar(G(spark, [(0, 1), (0, 2), (3, 2)], True), 1, 1).collect()] == [2]
    scores = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    assert S.auc(scores) == 0.75


def test_local(spark, karate):
    tri = as_map(L.triangles(karate))
    assert L.total_triangles(karate) == 45 and (tri[0], tri[33], tri[11]) == (18, 15, 0)
    assert L.average_clustering(karate) == pytest.approx(0.5706384782076823)
    assert L.degree_assortativity(karate) == pytest.approx(-0.47561309768461457)
    assert as_map(L.rich_club_coefficient(karate))[0] == pytest.approx(156 / 1122)
    t = L.structural_holes(G(spark, [(0, 1), (1, 2), (0, 2)], nodes=[5])).collect()
    t = {r.id: r for r in t}
    assert t[0].constraint == pytest.approx(1.125) and t[0].effective_size == pytest.approx(1.0) and math.isnan(t[5].constraint)
    assert t[0].hierarchy == pytest.approx(0, abs=1e-9)


def test_communities(spark, karate):
    k5 = [(a, b) for a in range(5) for b in range(a)] + [(a, b) for a in range(5, 10) for b in range(5, a)] + [(4, 5)]
    g = G(spark, k5).cut()
    want = [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    for df in (M.communities(g), M.girvan_newman(g, 2), M.girvan_newman(g), M.spectral_clustering(g, 2), M.label_propagation(g)):
        assert parts(df) == want
    assert M.modularity(g, want) > 0.4
    w = [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert parts(M.label_propagation(G(spark, w))) == [[0, 1, 2], [3, 4]]
    assert parts(M.label_propagation(G(spark, [(0, 1), (1, 2), (2, 3, 5.0), (3, 4)]))) == [[0, 1], [2, 3, 4]]
    assert M.modularity(karate, M.communities(karate)) > 0.38
    with pytest.raises(ValueError):
        M.modularity(g, [[0, 1]])


def test_structure(spark, karate):
    c = T.cut_structure(karate)
    assert c["bridges"] == [(0, 11)] and c["articulation_points"] == [0]
    assert [len(x) for x in c["biconnected_components"]] == [28, 6, 2] and c["n_two_edge_connected_components"] == 2
    s = G(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3)], True)
    assert parts(T.strongly_connected_components(s)) == [[0, 1, 2], [3, 4]] and not T.is_strongly_connected(s)
    dag, of = T.condensation_dag(s)
    assert [(r.src, r.dst) for r in dag.arcs.collect()] == [(0, 3)]
    assert T.number_of_maximal_cliques(karate) == 36 and T.clique_number(karate) == 5
    d = G(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], True).cut()
    assert as_map(T.immediate_dominators(d, 0)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 3}
    assert sorted(map(tuple, T.dominance_frontiers(d, 0).collect())) == [(1, 3), (2, 3)]
    assert as_map(T.post_dominators(d, 4)) == {4: 4, 3: 4, 1: 3, 2: 3, 0: 3}
    assert T.dominates(d, 0, 3, 4) and not T.dominates(d, 0, 1, 3)
    assert as_map(T.dominator_tree(d, 0))[0] == [1, 2, 3]


def test_paths(spark, karate):
    s = P.distance_summary(karate)
    assert (s["diameter"], s["radius"]) == (5, 3) and s["center"] == [0, 1, 2, 3, 8, 13, 19, 31] or sorted(s["center"]) == [0, 1, 2, 3, 8, 13, 19, 31]
    assert sorted(s["periphery"]) == [14, 15, 16, 18, 20, 22, 23, 26, 29]
    assert s["average_shortest_path_length"] == pytest.approx(2.408199643493761)
    assert s["wiener_index"] == 1351 and s["global_efficiency"] == pytest.approx(0.4920083184789052)
    n = G(spark, [(0, 1, 4.0), (0, 2, 1.0), (2, 1, -2.0), (1, 3, 1.0)], True)
    assert {r.id: r.distance for r in P.bellman_ford(n, 0).collect()} == {0: 0, 1: -1, 2: 1, 3: 0}
    with pytest.raises(P.NegativeCycleError) as e:
        P.bellman_ford(G(spark, [(0, 1, 1.0), (1, 2, -3.0), (2, 0, 1.0)], True), 0)
    assert set(e.value.cycle) == {0, 1, 2} and e.value.cycle[0] == e.value.cycle[-1]
    w = G(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)]).cut()
    d = P.dijkstra_shortest_path(w, 0)
    assert as_map(d)[2] == 2.0 and P.reconstruct_path(d, 0, 2) == [0, 1, 2]
    assert {(r.dst): r.distance for r in P.sssp(w, spark.createDataFrame([(0,)], "source long")).collect()} == {0: 0, 1: 1, 2: 2}
    assert P.floyd_warshall_path(P.floyd_warshall(w, True), 0, 2) == [0, 1, 2]
    assert [r.id for r in P.dfs_traversal(w, 0).collect()] == [0, 1, 2]
    assert P.dfs_path(G(spark, path(4)), 0, 3) == [0, 1, 2, 3] and P.dfs_path(G(spark, path(4)), 0, 3, 2) is None
    assert P.mst_weight(w) == 2.0
    with pytest.raises(ValueError):
        P.diameter(G(spark, [(0, 1), (2, 3)]))


def test_dag(spark):
    g = G(spark, [(0, 2), (0, 3), (1, 3), (2, 4), (3, 4), (0, 4)], True).cut()
    assert [r.id for r in D.topological_sort(g).collect()] == [0, 2, 1, 3, 4] and D.is_dag(g)
    assert D.transitive_reduction(g).count() == 5 and D.count_paths(g, 0, 4) == 3
    assert sorted(r.id for r in D.ancestors(g, 4).collect()) == [0, 1, 2, 3]
    assert as_map(D.topological_generations(g)) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    assert D.dag_longest_path(g)[0] == 2.0
    assert D.transitive_closure(g).count() == 7 or D.transitive_closure(g).count() == 6
    c = G(spark, [(0, 1), (1, 2), (2, 0)], True)
    assert set(D.find_cycle(c)) == {0, 1, 2} and not D.is_dag(c)
    with pytest.raises(D.CycleError):
        D.topological_sort(c)
    cpm = G(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], True)
    rows, whole, crit = D.critical_path(cpm, {0: 3, 1: 4, 2: 2, 3: 5, 4: 1})
    assert whole == 13 and crit == [0, 1, 3, 4] and {r.id: r.slack for r in rows.collect()}[2] == 2


def test_flow(spark, karate):
    clrs = G(spark, [(0, 1, 16), (0, 2, 13), (1, 3, 12), (2, 1, 4), (3, 2, 9), (2, 4, 14), (4, 3, 7), (3, 5, 20), (4, 5, 4)], True).cut()
    r = W.maximum_flow(clrs, 0, 5)
    assert r.value == 23 and r.source_side == [0, 1, 2, 4] and r.cut_edges == [(1, 3), (4, 3), (4, 5)] and r.cut_capacity == 23
    assert W.edge_connectivity(karate, 0, 33) == 10 and W.edge_connectivity(karate) == 1
    pet = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(i + 5, (i + 2) % 5 + 5) for i in range(5)]
    p = G(spark, pet).cut()
    m = W.maximum_matching(p)
    assert m.count() == 5 and W.is_perfect_matching(p, m) and K.chromatic_number(p) == 3 and I.automorphism_count(p) == 120
    b = G(spark, [(0, 10), (0, 11), (1, 10), (2, 11)]).cut()
    assert W.maximum_bipartite_matching(b).count() == 2
    assert W.minimum_edge_cover(b).count() == 3
    cost = spark.createDataFrame([(i, j, float(x)) for i, r in enumerate([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) for j, x in enumerate(r)], "row long, col long, cost double")
    assert sum(r.cost for r in W.linear_sum_assignment(cost).collect()) == 5
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(5):
        c = rng.integers(0, 20, (4, 5)).astype(float)
        assert W.assignment(c)[2] == min(sum(c[i, q[i]] for i in range(4)) for q in permutations(range(5), 4))
    wb = W.maximum_weight_bipartite_matching(G(spark, [(0, 10, 5.0), (0, 11, 4.0), (1, 10, 4.0)]))
    assert sum(r.weight for r in wb.collect()) == 8


def test_blossom_against_brute_force():
    from itertools import combinations
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 8)
        e = [x for x in combinations(range(n), 2) if rng.random() < 0.45]
        near = [[b if a == v else a for a, b in e if v in (a, b)] for v in range(n)]
        best = max(k for k in range(n // 2 + 1) if any(len({x for p in c for x in p}) == 2 * k for c in combinations(e, k)))
        mate = W._mates(near)
        assert sum(x >= 0 for x in mate) == 2 * best and all(mate[mate[v]] == v for v in range(n) if mate[v] >= 0)


def test_coloring_euler(spark, karate):
    used = as_map(K.coloring_summary(karate))
    assert (used["largest_first"], used["smallest_last"], used["dsatur"]) == (5, 5, 5)
    n, c = K.chromatic_number(karate, return_coloring=True)
    assert n == 5 and K.is_proper_coloring(karate, c)
    assert K.odd_degree_nodes(karate).count() == 12
    ring = G(spark, [(0, 1), (1, 2), (2, 0)]).cut()
    assert K.is_eulerian(ring) and [tuple(r)[1:] for r in K.eulerian_circuit(ring).collect()] == [(0, 1), (1, 2), (2, 0)]
    p = G(spark, path(3)).cut()
    assert K.has_eulerian_path(p) and not K.is_eulerian(p) and K.eulerian_path(p).count() == 2
    with pytest.raises(ValueError):
        K.eulerian_circuit(p)


def test_isomorphism(spark, karate):
    c6 = G(spark, [(i, (i + 1) % 6) for i in range(6)]).cut()
    two = G(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]).cut()
    assert I.wl_graph_hash(c6) == I.wl_graph_hash(two) and I.could_be_isomorphic(c6, two) and not I.is_isomorphic(c6, two)
    assert I.automorphism_count(G(spark, [(i, (i + 1) % 7) for i in range(7)])) == 14
    assert I.automorphism_count(karate) == 480
    assert I.automorphism_orbits(G(spark, path(3))) == [[0, 2], [1]]
    k = I.wl_subtree_kernel([c6, two], normalize=True)
    assert k[0, 1] == pytest.approx(1)
    assert [r.size for r in I.color_refinement(G(spark, path(4))).collect()] == [2, 2]


def test_tours(spark):
    sq = G(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2, 1.4), (1, 3, 1.4)]).cut()
    r = R.solve_tsp(sq)
    assert r.cost == 4 and r.optimal and r.gap == 0
    assert R.solve_tsp(sq, "heuristic").cost == 4
    star = G(spark, [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0)]).cut()
    s = R.solve_tsp(star, metric_closure=True, expand_path=True)
    assert s.cost == 12 and s.path[0] == s.path[-1]
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(5):
        d = rng.random((7, 7))
        d = d + d.T
        np.fill_diagonal(d, 0)
        best = min(R.tour_cost(d, [0, *q]) for q in permutations(range(1, 7)))
        assert R.held_karp(d)[1] == pytest.approx(best) and R.one_tree_bound(d) <= best + 1e-9
        assert R.tour_cost(d, R.or_opt(d, R.two_opt(d, R.nearest_neighbor_tour(d)))) >= best - 1e-9


def test_predicted_links_over_all_pairs(spark):
    """The best pairs of all that no edge joins, against every pair, whatever the metric."""
    import random

    rng = random.Random(13)
    stars = [(0, i) for i in (1, 2, 3)] + [(10, i) for i in (11, 12, 13)]
    for edges in (stars, sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(16)}), [(1, 2), (3, 4), (5, 6)]):
        g = Graph.from_edges(spark, edges).cut()
        for metric in (S.preferential_attachment_scores, S.adamic_adar_scores):
            want = [tuple(r) for r in S.predicted_links(g, metric, 6, S.non_edges(g)).collect()]
            assert [tuple(r) for r in S.predicted_links(g, metric, 6).collect()] == want
    best = S.predicted_links(Graph.from_edges(spark, stars), S.preferential_attachment_scores, 1).first()
    assert tuple(best) == (0, 10, 9.0)


def test_large_graphs_need_no_dense_matrix(spark, monkeypatch):
    """Katz and SimRank by rounds against the dense forms."""
    for directed in (False, True):
        g = Graph.from_edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 4), (5, 3)], directed, [9]).cut()
        pairs = [(0, 4), (1, 3), (2, 2), (4, 4), (9, 0), (0, 77)]
        dense = [r["score"] for r in S.katz_index_scores(g, pairs, 0.1).orderBy("pair_pos").collect()]
        matrix = {(r["u"], r["v"]): r["score"] for r in S.simrank_matrix(g, max_iter=4, tol=0.0).collect()}
        monkeypatch.setattr(S, "MOST_DENSE", 0)
        assert [r["score"] for r in S.katz_index_scores(g, pairs, 0.1).orderBy("pair_pos").collect()] == pytest.approx(dense, abs=1e-9)
        sparse = {(r["u"], r["v"]): r["score"] for r in S.simrank_matrix(g, max_iter=4, tol=0.0).collect()}
        assert {k: sparse.get(k, 0.0) for k in matrix} == pytest.approx(matrix, abs=1e-9)
        monkeypatch.setattr(S, "MOST_DENSE", 5000)

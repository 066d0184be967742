"""Cut structure, strong components, cliques and dominators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators.kernels import LONGS, Net, frame
from lattica.plans.components import components
from lattica.plans.cut import cut, written
from lattica.plans.forest import below, rooted, spanning_forest
from lattica.plans.layers import onward
from lattica.plans.triangles import closed


def blocks(g: Graph) -> DataFrame:
    """``(child, parent, block)``: the edges of a spanning forest of the simple view, each with its biconnected component, named by some child.

    An edge of the forest and that above it are in one block if an edge leaves what hangs below
    them both, which the least and greatest places of the neighbours below tell; so are the
    edges above two nodes that an edge joins, neither of which is over the other.
    """
    edges = cut(g.simple())
    forest, label = spanning_forest(edges)
    tree = rooted(forest, label)
    rest = edges.join(forest, ["a", "b"], "left_anti")
    at = lambda x: tree.select(F.col("id").alias(x), F.col("enter").alias(f"e{x}"), F.col("leave").alias(f"l{x}"))
    back = cut(rest.join(at("a"), "a").join(at("b"), "b"))
    seen = back.select(F.col("a").alias("id"), F.col("eb").alias("e")).unionByName(back.select(F.col("b").alias("id"), F.col("ea").alias("e")))
    seen = seen.groupBy("id").agg(F.min("e").alias("l"), F.max("e").alias("h"))
    own = tree.join(seen, "id", "left").select("id", "parent", F.least("enter", "l").alias("low"), F.greatest("enter", "h").alias("high"))
    reach = below(own)
    aside = back.where("not (ea <= eb and lb <= la) and not (eb <= ea and la <= lb)").select(F.col("a").alias("u"), F.col("b").alias("v"))
    kids = cut(tree.where("parent is not null").select(F.col("id").alias("child"), "parent"))
    above = tree.where("parent is not null").select(F.col("id").alias("parent"), "enter", "leave")
    out = kids.join(above, "parent").join(reach.withColumnRenamed("id", "child"), "child").where("low < enter or high > leave").select(F.col("parent").alias("u"), F.col("child").alias("v"))
    roots = components(aside.unionByName(out)).select(F.col("id").alias("child"), F.col("root").alias("block"))
    return cut(kids.join(roots, "child", "left").select("child", "parent", F.coalesce("block", "child").alias("block")))


def bridges(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """``(a, b)``, a < b: edges whose loss parts their component: blocks of one edge. ``found`` are the graph's ``blocks``."""
    one = (found or blocks(g)).groupBy("block").agg(F.count("*").alias("n"), F.min("child").alias("u"), F.min("parent").alias("v")).where("n = 1")
    return one.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).orderBy("a", "b")


def _members(found: DataFrame) -> DataFrame:
    return found.select("block", F.explode(F.array("child", "parent")).alias("id")).distinct()


def articulation_points(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """``(id)``: nodes whose loss parts their component, which are in several blocks."""
    return _members(found or blocks(g)).groupBy("id").count().where("count > 1").select("id").orderBy("id")


def biconnected_labels(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """``(id, block)``: the blocks that a node is in."""
    return _members(found or blocks(g)).select("id", "block")


def biconnected_components(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """``(size, members)``, the largest first; isolated nodes are in none. A block's members are one row: ``biconnected_labels`` has a row for each."""
    rows = _members(found or blocks(g)).groupBy("block").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return rows.select(F.size("members").cast("long").alias("size"), "members").orderBy(F.desc("size"), "members")


def two_edge_connected_components(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """``(id, component)``, named by its least member."""
    gone = cut(bridges(g, found))
    left = g.simple().join(gone, ["a", "b"], "left_anti")
    roots = components(left.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return g.nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def cut_structure(g: Graph) -> dict:
    """All of it, from one computation of the blocks; lists of all that is found come to the driver, as the result is one."""
    found = blocks(g)
    b, a, c = bridges(g, found).collect(), articulation_points(g, found).collect(), biconnected_components(g, found).collect()
    t = two_edge_connected_components(g, found).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("m")).collect()
    return {
        "bridges": [tuple(x) for x in b], "articulation_points": [x["id"] for x in a], "biconnected_components": [x["members"] for x in c],
        "two_edge_connected_components": sorted(x["m"] for x in t), "n_bridges": len(b), "n_articulation_points": len(a),
        "n_biconnected_components": len(c), "n_two_edge_connected_components": len(t),
    }


def _directed(g: Graph) -> None:
    if not g.directed:
        raise ValueError("a directed graph is needed")


def strongly_connected_components(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, component)``, named by its least member.

    Forward colouring: each node of the rest takes the least id that reaches it; what reaches
    the head of its colour within the colour is the head's component, and leaves the rest. A
    node without arcs in or out in the rest is alone and leaves at once.
    """
    _directed(g)
    rest = cut(g.nodes.select("id"))
    arcs = cut(g.arcs.where("src <> dst").select("src", "dst"))
    done = rest.where(F.lit(False)).select("id", F.col("id").alias("component"))
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        alone = cut(rest.join(arcs.select(F.col("src").alias("id")).distinct().intersect(arcs.select(F.col("dst").alias("id"))), "id", "left_anti"))
        if not alone.isEmpty():
            done = done.unionByName(alone.select("id", F.col("id").alias("component")))
            rest = cut(rest.join(alone, "id", "left_anti"))
        else:
            color = rest.select("id", F.col("id").alias("color"))
            while True:
                got = arcs.join(color.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("c"))
                new = cut(color.join(got, "id", "left").select("id", F.least("color", "c").alias("color"), (F.col("c") < F.col("color")).alias("moved")))
                color = new.drop("moved")
                if new.where("moved").isEmpty():
                    break
            inner = cut(arcs.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst"))
            found = front = cut(color.where("id = color"))
            while not front.isEmpty():
                step = inner.join(front.select(F.col("id").alias("dst"), "color"), "dst").select(F.col("src").alias("id"), "color").distinct()
                front = cut(step.join(found, "id", "left_anti"))
                found = cut(found.unionByName(front))
            done = done.unionByName(found.select("id", F.col("color").alias("component")))
            rest = cut(rest.join(found, "id", "left_anti"))
        arcs = cut(arcs.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi"))
        done = cut(done)
    else:
        raise RuntimeError(f"components aren't all found after {max_rounds} rounds")
    return done


def is_strongly_connected(g: Graph) -> bool:
    _directed(g)
    first = g.nodes.orderBy("pos").first()
    if first is None:
        return False
    n = g.number_of_nodes()
    return g.bfs_distances(first["id"]).count() == n and g.reversed().bfs_distances(first["id"]).count() == n


def condensation_dag(g: Graph) -> tuple[Graph, DataFrame]:
    """The DAG of the strong components, of weight 1, and ``(id, component)``."""
    of = cut(strongly_connected_components(g))
    e = g.arcs.join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
    return Graph.from_frame(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), True, of.select(F.col("component").alias("id")).distinct()), of


def _within(later: list[int], edges: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Maximal cliques of a small graph, from a node with most candidates beside it at each step."""
    near: dict[int, set[int]] = {v: set() for v in later}
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    todo = [([], set(later), set())]
    while todo:
        clique, may, barred = todo.pop()
        if not may:
            if not barred:
                yield clique
            continue
        pivot = max(may | barred, key=lambda x: len(may & near[x]))
        for v in may - near[pivot]:
            todo.append(([*clique, v], may & near[v], barred & near[v]))
            may = may - {v}
            barred = barred | {v}


#: Candidates and edges between them that a task has as Python objects at once, if one row has no more.
HELD = 50_000


def _cliques(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(x, rest, lead)``: maximal cliques of rows ``(x, later, edges)``, of which few are objects at once, whatever a batch holds."""
    schema = pa.schema([("x", pa.int64()), ("rest", pa.list_(pa.int64())), ("lead", pa.int64())])
    for batch in batches:
        size = np.cumsum(sum(pa.compute.fill_null(batch[c].value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("later", "edges")))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + HELD, "right")))
            out: list[dict] = []
            for row in batch.slice(i, j - i).to_pylist():
                seen = {p["y"]: p["seen"] for p in row["later"]}
                for rest in _within(list(seen), [(e["y"], e["z"]) for e in row["edges"] or ()]):
                    lead = min(rest, key=lambda v: (seen[v], v))
                    out.append({"x": row["x"], "rest": sorted(rest), "lead": lead if seen[lead] else None})
                    if len(out) >= HELD:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema)
            i = j


def find_cliques(g: Graph, min_size: int = 1) -> DataFrame:
    """``(size, members)``: all maximal cliques of the simple view, the largest first.

    In an order with few later neighbours (``layers``) a clique belongs to its first node. A
    row holds a node's later neighbours and the edges between them, from the triangles that the
    node begins: at most four times the degeneracy of nodes. In it the maximal cliques are found; one of
    them isn't maximal in the whole graph if a node before the first sees all of it, which a
    join with what earlier nodes see tells, led by the member that fewest of them see. The
    graph is never in one place, and no node's earlier neighbours are gathered.
    """
    g = g.once()
    edges = g.simple() if g.stored else written(g.simple())
    way = onward(edges)
    corner = written(closed(way.select(F.col("x").alias("a"), F.col("y").alias("b")), True, True))
    # How many nodes before y see both y and its later neighbour z.
    seen = corner.groupBy(F.col("y").alias("x"), F.col("z").alias("y")).agg(F.count("*").alias("seen"))
    later = way.join(seen, ["x", "y"], "left").groupBy("x").agg(F.collect_list(F.struct("y", F.coalesce("seen", F.lit(0)).alias("seen"))).alias("later"))
    small = later.join(corner.groupBy("x").agg(F.collect_list(F.struct("y", "z")).alias("edges")), "x", "left")

    made = written(small.mapInArrow(lambda batches: _cliques(batches), "x long, rest array<long>, lead long").where(F.size("rest") + 1 >= min_size))
    # What a node w before x sees of x's later neighbours, once for each distinct set, under each member.
    views = corner.groupBy(F.col("x").alias("w"), F.col("y").alias("x")).agg(F.sort_array(F.collect_list("z")).alias("view")).select("x", "view").distinct()
    views = views.select("x", "view", F.explode("view").alias("lead"))
    whole = made.alias("m").join(views.alias("v"), (F.col("m.x") == F.col("v.x")) & (F.col("m.lead") == F.col("v.lead")) & (F.size(F.array_except("m.rest", "v.view")) == 0), "left_anti")
    whole = whole.select((F.size("rest") + 1).cast("long").alias("size"), F.array_sort(F.concat(F.array("x"), "rest")).alias("members"))
    if min_size <= 1:
        alone = g.nodes.select("id").join(edges.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti")
        whole = whole.unionByName(alone.select(F.lit(1).cast("long").alias("size"), F.array("id").alias("members")))
    return whole.orderBy(F.desc("size"), "members")


def number_of_maximal_cliques(g: Graph) -> int:
    return find_cliques(g).count()


def max_clique(g: Graph) -> list[int]:
    row = find_cliques(g).first()
    return row["members"] if row else []


def clique_number(g: Graph) -> int:
    return len(max_clique(g))


def node_clique_number(g: Graph) -> DataFrame:
    """``(id, size)``: the largest clique that holds a node."""
    return find_cliques(g).select(F.explode("members").alias("id"), "size").groupBy("id").agg(F.max("size").alias("size"))


def _idoms(net: Net, root: int) -> dict[int, int]:
    """Immediate dominators by iteration over a reverse postorder."""
    order, seen, stack = [], {root}, [(root, iter(net.adj[root]))]
    while stack:
        u, rest = stack[-1]
        v = next((v for v, _ in rest if v not in seen), None)
        if v is None:
            order.append(u)
            stack.pop()
        else:
            seen.add(v)
            stack.append((v, iter(net.adj[v])))
    rank = {v: k for k, v in enumerate(order)}
    back, idom = net.back(), {root: root}
    moved = True
    while moved:
        moved = False
        for v in reversed(order[:-1]):
            new = None
            for u, _ in back[v]:
                if u in idom:
                    a, b = u, new if new is not None else u
                    while a != b:
                        if rank[a] < rank[b]:
                            a = idom[a]
                        else:
                            b = idom[b]
                    new = a
            if idom.get(v) != new:
                idom[v], moved = new, True
    return idom


def immediate_dominators(g: Graph, root: int) -> DataFrame:
    """``(id, idom)`` of what the root reaches; the root's is itself."""
    _directed(g)
    g.require(root)
    return frame(g, lambda net: [(net.ids[v], net.ids[d]) for v, d in _idoms(net, net.index[root]).items()], LONGS("id", "idom"))


def dominator_tree(g: Graph, root: int) -> DataFrame:
    """``(id, children)``, children in node order."""
    t = cut(immediate_dominators(g, root))
    kids = t.where("id <> idom").join(g.nodes, "id").groupBy(F.col("idom").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("children"))
    return t.join(kids, t["id"] == kids["k"], "left").select("id", F.coalesce("children", F.array().cast("array<long>")).alias("children"))


def dominators(g: Graph, root: int) -> DataFrame:
    """``(id, dominator)``, a node among its own."""
    t = cut(immediate_dominators(g, root))
    out = t.select("id", F.col("id").alias("dominator"))
    front = t.where("id <> idom").select("id", F.col("idom").alias("dominator"))
    while not front.isEmpty():
        out = cut(out.unionByName(front))
        up = t.where("id <> idom").select(F.col("id").alias("dominator"), F.col("idom").alias("up"))
        front = cut(front.join(up, "dominator").select("id", F.col("up").alias("dominator")))
    return out


def dominates(g: Graph, root: int, d: int, v: int) -> bool:
    g.require(d, v)
    return not dominators(g, root).where((F.col("id") == v) & (F.col("dominator") == d)).isEmpty()


def dominance_frontiers(g: Graph, root: int) -> DataFrame:
    """``(id, member)``: nodes with a predecessor that ``id`` dominates but that it doesn't strictly dominate."""
    doms = cut(dominators(g, root))
    pred = g.arcs.select(F.col("src").alias("p"), F.col("dst").alias("member")).join(doms.select(F.col("id").alias("member")).distinct(), "member")
    pairs = pred.join(doms.select(F.col("id").alias("p"), F.col("dominator").alias("id")), "p").select("id", "member").distinct()
    strict = doms.where("id <> dominator").select(F.col("dominator").alias("id"), F.col("id").alias("member"))
    return pairs.join(strict, ["id", "member"], "left_anti")


def post_dominators(g: Graph, exit_node: int) -> DataFrame:
    return immediate_dominators(g.reversed(), exit_node)

"""The graph handle: ordered nodes and arcs as DataFrames.

``nodes (id, pos)`` and ``arcs (src, dst, weight, pos)``; ``pos`` keeps insertion order, of
nodes over the graph and of arcs in a node's neighbourhood. An undirected edge is an arc each
way, a self-loop is one arc. A repeated edge takes the last weight and keeps its first place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.components import components
from lattica.plans.cut import cut, written
from lattica.plans.ranked import ranked

EDGES = "seq long, src long, dst long, weight double"
NODES = "id long, seq long"

#: Zachary's karate club, the later neighbours of each member in order.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31],
    1: [2, 3, 7, 13, 17, 19, 21, 30],
    2: [3, 7, 8, 9, 13, 27, 28, 32],
    3: [7, 12, 13],
    4: [6, 10],
    5: [6, 10, 16],
    6: [16],
    8: [30, 32, 33],
    9: [33],
    13: [33],
    14: [32, 33],
    15: [32, 33],
    18: [32, 33],
    19: [33],
    20: [32, 33],
    22: [32, 33],
    23: [25, 27, 29, 32, 33],
    24: [25, 27, 31],
    25: [31],
    26: [29, 33],
    27: [33],
    28: [31, 33],
    29: [32, 33],
    30: [32, 33],
    31: [32, 33],
    32: [33],
}


class Builder:
    """Collects nodes and edges in order; ``build`` makes the graph."""

    def __init__(self, directed: bool = False):
        self.directed, self._seq = directed, 0
        self._edges: list[tuple] = []
        self._nodes: list[tuple] = []

    def add_node(self, n: int) -> Builder:
        self._nodes.append((int(n), 2 * self._seq))
        self._seq += 1
        return self

    def add_edge(self, u: int, v: int, weight: float = 1.0) -> Builder:
        self._edges.append((self._seq, int(u), int(v), float(weight)))
        self._seq += 1
        return self

    def build(self, spark: SparkSession) -> Graph:
        edges = spark.createDataFrame(self._edges, EDGES)
        return Graph.from_frame(edges, self.directed, spark.createDataFrame(self._nodes, NODES))


class Graph:
    """An immutable graph over two DataFrames."""

    def __init__(self, nodes: DataFrame, arcs: DataFrame, directed: bool = False, by_id: bool = False):
        # by_id: nodes stand in the order of their ids.
        self.nodes, self.arcs, self.directed, self.by_id = nodes, arcs, directed, by_id
        #: The distinct ``(src, dst, weight)``, src < dst, that the graph was made from by ``from_pairs``.
        self.pairs: DataFrame | None = None
        #: Whether the pairs are in files.
        self.stored = False
        self.spark = arcs.sparkSession

    @classmethod
    def from_edges(cls, spark: SparkSession, edges: Iterable[tuple], directed: bool = False, nodes: Iterable[int] = ()) -> Graph:
        """From ``(u, v)`` or ``(u, v, weight)``; ``nodes`` come after them."""
        builder = Builder(directed)
        for edge in edges:
            builder.add_edge(*edge)
        for n in nodes:
            builder.add_node(n)
        return builder.build(spark)

    @classmethod
    def from_frame(cls, edges: DataFrame, directed: bool = False, extra: DataFrame | None = None) -> Graph:
        """From ``src, dst[, weight][, seq]`` and extra nodes ``id[, seq]``.

        Without ``seq`` nodes and neighbours are in order of their ids, which needs no sort of
        the whole table, and of a repeated edge's weights the greatest counts.
        """
        ordered = "seq" in edges.columns
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        seq = F.col("seq").cast("long") if ordered else F.lit(0).cast("long")
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"), seq.alias("seq"))
        if directed:
            first = e.groupBy("src", "dst").agg(F.min("seq").alias("pos"), F.max_by("weight", F.struct("seq", "weight")).alias("weight"))
            arcs = first.select("src", "dst", "weight", (2 * F.col("pos")).alias("pos"))
        else:
            pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
            first = e.groupBy(*pair).agg(F.min("seq").alias("pos"), F.max_by("weight", F.struct("seq", "weight")).alias("weight"), F.min_by("src", F.struct("seq", "src")).alias("u"))
            ends = first.select("u", F.when(F.col("u") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v"), "weight", "pos")
            ways = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("k")))).otherwise(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("k")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.lit(1).alias("k"))))
            arcs = ends.select(F.explode(ways).alias("w"), "weight", "pos").select("w.src", "w.dst", "weight", (2 * F.col("pos") + F.col("w.k")).alias("pos"))
        if not ordered:
            arcs = arcs.withColumn("pos", F.col("dst"))
        place = (lambda c, k: (2 * F.col("seq") + k).alias("pos")) if ordered else (lambda c, k: F.col(c).alias("pos"))
        seen = e.select(F.col("src").alias("id"), place("src", 0)).unionByName(e.select(F.col("dst").alias("id"), place("dst", 1)))
        if extra is not None:
            seen = seen.unionByName(extra.select(F.col("id").cast("long").alias("id"), F.col("seq" if ordered and "seq" in extra.columns else "id").cast("long").alias("pos")))
        return cls(seen.groupBy("id").agg(F.min("pos").alias("pos")), arcs.select("src", "dst", "weight", "pos"), directed)

    @classmethod
    def from_pairs(cls, pairs: DataFrame) -> Graph:
        """Undirected, from ``src, dst[, weight]`` with src < dst, no pair twice: as ``from_frame``, without its search for repeats."""
        weight = F.col("weight").cast("double") if "weight" in pairs.columns else F.lit(1.0)
        pairs = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
        ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls._paired(pairs, ids.select("id", F.col("id").alias("pos")))

    @classmethod
    def _paired(cls, pairs: DataFrame, nodes: DataFrame) -> Graph:
        ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        g = cls(nodes, pairs.select(ways.alias("w"), "weight").select("w.src", "w.dst", "weight", F.col("w.dst").alias("pos")), False, True)
        g.pairs = pairs
        return g

    @classmethod
    def karate_club(cls, spark: SparkSession) -> Graph:
        return cls.from_edges(spark, [(u, v) for u, vs in KARATE.items() for v in vs])

    @classmethod
    def from_edge_list(cls, spark: SparkSession, path: str, directed: bool = False, delimiter: str | None = None, weighted: bool = False, comments: str = "#") -> Graph:
        from lattica.sources.edge_list import from_edge_list

        return from_edge_list(spark, path, directed, delimiter, weighted, comments)

    def __len__(self) -> int:
        return self.number_of_nodes()

    def __repr__(self) -> str:
        return f"Graph(nodes={self.number_of_nodes()}, edges={self.number_of_edges()}, directed={self.directed})"

    def with_edges(self, edges: Iterable[tuple], nodes: Iterable[int] = ()) -> Graph:
        """With more edges and nodes: new ones come last, known ones keep their place and take the new weight."""
        more = Graph.from_edges(self.spark, edges, self.directed, nodes)
        after = lambda df: (df.agg(F.max("pos")).first()[0] or 0) + 1
        late = more.nodes.withColumn("pos", F.col("pos") + after(self.nodes))
        new = more.arcs.select("src", "dst", F.col("weight").alias("w"), (F.col("pos") + after(self.arcs)).alias("p"))
        arcs = self.arcs.join(new, ["src", "dst"], "full").select("src", "dst", F.coalesce("w", "weight").alias("weight"), F.coalesce("pos", "p").alias("pos"))
        return Graph(self.nodes.unionByName(late).groupBy("id").agg(F.min("pos").alias("pos")), arcs, self.directed)

    def add_edge(self, u: int, v: int, weight: float = 1.0) -> Graph:
        return self.with_edges([(u, v, weight)])

    def add_node(self, n: int) -> Graph:
        return self.with_edges([], [n])

    def cut(self) -> Graph:
        """The same graph, computed once; of pairs, each is kept once and nodes are read off what was kept."""
        if self.pairs is not None:
            kept = Graph.from_pairs(written(self.pairs))
            g = Graph._paired(kept.pairs, cut(kept.nodes))
            g.stored = True
            return g
        return Graph(cut(self.nodes), cut(self.arcs), self.directed, self.by_id)

    def once(self) -> Graph:
        """``cut`` where pairs are still to be made from a table, so that nodes and edges don't both make them."""
        return self if self.pairs is None or self.stored else self.cut()

    def reversed(self) -> Graph:
        return Graph(self.nodes, self.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "pos"), self.directed)

    def simple(self) -> DataFrame:
        """``(a, b)`` with a < b: each edge of the undirected simple view once."""
        if self.pairs is not None:
            return self.pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        if not self.directed:  # both arcs of an edge are there, once each
            return self.arcs.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return self.arcs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def both(self) -> DataFrame:
        """``(src, dst)`` each way, of the undirected simple view."""
        if not self.directed:
            return self.arcs.where("src <> dst").select("src", "dst")
        s = self.simple()
        return s.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(s.select(F.col("b").alias("src"), F.col("a").alias("dst")))

    def edges(self) -> DataFrame:
        """``(src, dst, weight, pos)``; an undirected edge once, from the endpoint inserted first."""
        if self.directed:
            return self.arcs
        if self.pairs is not None:
            return self.pairs.withColumn("pos", F.col("dst"))
        if self.by_id:
            return self.arcs.where("src <= dst")
        at = self.nodes.select(F.col("id").alias("src"), F.col("pos").alias("ps")), self.nodes.select(F.col("id").alias("dst"), F.col("pos").alias("pd"))
        return self.arcs.join(at[0], "src").join(at[1], "dst").where("ps <= pd").select("src", "dst", "weight", "pos")

    def node_labels(self) -> DataFrame:
        return self.nodes.orderBy("pos").select("id")

    def neighbors(self, n: int) -> DataFrame:
        return self.arcs.where(F.col("src") == n).orderBy("pos").select(F.col("dst").alias("id"))

    def has_edge(self, u: int, v: int) -> bool:
        return not self.arcs.where((F.col("src") == u) & (F.col("dst") == v)).isEmpty()

    def get_weight(self, u: int, v: int) -> float:
        row = self.arcs.where((F.col("src") == u) & (F.col("dst") == v)).first()
        if row is None:
            raise KeyError(f"no edge {u} - {v}")
        return row["weight"]

    def degrees(self) -> DataFrame:
        """``(id, degree)``; a self-loop counts once, and arcs out where directed."""
        return self.nodes.join(self.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))

    def degree(self, n: int) -> int:
        return self.arcs.where(F.col("src") == n).count()

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        """Where undirected half the arcs, rounded down, so that a self-loop is half an edge."""
        if self.pairs is not None:
            return self.pairs.count()
        n = self.arcs.count()
        return n if self.directed else n // 2

    def density(self) -> float:
        return self._density(self.number_of_nodes(), self.number_of_edges())

    def _density(self, n: int, m: int) -> float:
        return 0.0 if n < 2 else m / (n * (n - 1) * (1 if self.directed else 0.5))

    def has_node(self, n: int) -> bool:
        return not self.nodes.where(F.col("id") == n).isEmpty()

    def require(self, *ids: int) -> None:
        for n in ids:
            if not self.has_node(n):
                raise KeyError(f"no node {n}")

    def adjacency_matrix(self) -> DataFrame:
        """``(i, j, value)`` by place in node order; places that aren't there are zero."""
        at = cut(ranked(self.nodes, ["pos", "id"], "k").select("id", F.col("k").cast("int").alias("k")))
        a, b = at.select(F.col("id").alias("src"), F.col("k").alias("i")), at.select(F.col("id").alias("dst"), F.col("k").alias("j"))
        return self.arcs.join(a, "src").join(b, "dst").select("i", "j", F.col("weight").alias("value"))

    def without_edges(self, edges: Iterable[tuple[int, int]]) -> Graph:
        """Without these edges, whatever their direction; nodes that lose all theirs go too."""
        gone = self.spark.createDataFrame([(min(u, v), max(u, v)) for u, v in edges], "a long, b long")
        kept = self.arcs.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(gone, ["a", "b"], "left_anti").select("src", "dst", "weight", "pos")
        left = kept.select(F.col("src").alias("id")).unionByName(kept.select(F.col("dst").alias("id"))).distinct()
        return Graph(self.nodes.join(left, "id", "left_semi"), kept, self.directed)

    def connected_components(self, weak: bool = True) -> DataFrame:
        """``(id, component)``, named by its least member. Directed graphs: ``weak=False`` follows
        arcs out from nodes in order of insertion, so parts depend on that order."""
        if self.directed and not weak:
            from lattica.operators.kernels import LONGS, on_executor

            def sweep(net):
                seen: dict[int, int] = {}
                for s in range(net.n):
                    if s not in seen:
                        part, queue = [s], [s]
                        seen[s] = s
                        for u in queue:
                            for v, _ in net.adj[u]:
                                if v not in seen:
                                    seen[v] = s
                                    queue.append(v)
                                    part.append(v)
                        least = min(net.ids[i] for i in part)
                        for i in part:
                            yield net.ids[i], least

            return on_executor(self, sweep, LONGS("id", "component"))
        roots = components(self.simple().select(F.col("a").alias("u"), F.col("b").alias("v")))
        if self.pairs is not None:  # every node is an end of a pair
            return roots.select("id", F.col("root").alias("component"))
        return self.nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))

    def is_connected(self) -> bool:
        if not self.directed:
            ends = self.connected_components().agg(F.min("component").alias("a"), F.max("component").alias("b")).first()
            return ends["a"] is not None and ends["a"] == ends["b"]
        n = self.number_of_nodes()
        if n == 0:
            return False
        first = self.nodes.orderBy("pos").first()["id"]
        return self.bfs_distances(first).count() == n

    def bfs_distances(self, source: int) -> DataFrame:
        """``(id, distance)`` in hops over arcs; nodes that aren't reached are left out."""
        from lattica.operators.paths import multi_source_bfs

        return multi_source_bfs(self, self.spark.createDataFrame([(source,)], "source long")).select(F.col("dst").alias("id"), "distance")

    def distance_counts(self) -> DataFrame:
        """``(id, d, n)``: how many nodes are ``d`` hops over arcs from each, itself at 0."""
        from lattica.plans.leaves import distance_counts, leaves

        near = self.arcs.where("src <> dst").select("src", "dst", "weight")
        return distance_counts(self.nodes, near, None if self.directed else leaves(near))

    def summary(self) -> DataFrame:
        n, m = self.number_of_nodes(), self.number_of_edges()
        row = (n, m, self.directed, self._density(n, m), self.is_connected())
        return self.spark.createDataFrame([row], "n_nodes long, n_edges long, directed boolean, density double, connected boolean")


def karate_club(spark: SparkSession) -> Graph:
    return Graph.karate_club(spark)

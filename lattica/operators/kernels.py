"""Sequential kernels in executors, on graphs of checked size.

Some algorithms follow the order of insertion or search exhaustively. They run as one Arrow
task for each graph or component (``on_executor``, ``per_component``), or over sources in
parallel with the graph broadcast (``per_source``). All refuse graphs beyond a set number of
arcs, so that nothing of unknown size is gathered.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import cut

#: Arcs that one task or one broadcast may hold.
MOST_ARCS = 5_000_000
#: Rows that a task over sources hands on at once.
FRAME_ROWS = 50_000


def LONGS(*names: str) -> str:  # noqa: N802
    return ", ".join(f"{n} long" for n in names)


class Net:
    """A graph in memory: nodes are numbered in order of insertion, neighbours in theirs."""

    def __init__(self, nodes: list[tuple[int, int]], arcs: list[tuple[int, int, float, int]], directed: bool):
        self.ids = [i for i, _ in sorted(nodes, key=lambda x: (x[1], x[0]))]
        self.index = {x: k for k, x in enumerate(self.ids)}
        self.n, self.directed = len(self.ids), directed
        self.adj: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for u, v, w, _ in sorted(arcs, key=lambda x: (x[3], x[0], x[1])):
            self.adj[self.index[u]].append((self.index[v], w))

    def back(self) -> list[list[tuple[int, float]]]:
        out: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for u, row in enumerate(self.adj):
            for v, w in row:
                out[v].append((u, w))
        return out

    def simple(self) -> list[set[int]]:
        """Neighbours in the undirected simple view."""
        out: list[set[int]] = [set() for _ in self.ids]
        for u, row in enumerate(self.adj):
            for v, _ in row:
                if u != v:
                    out[u].add(v)
                    out[v].add(u)
        return out

    def has(self, u: int, v: int) -> bool:
        return any(x == v for x, _ in self.adj[u])


def guard(g, most: int | None = None) -> None:
    most = most or MOST_ARCS
    if (n := g.arcs.count()) > most:
        raise ValueError(f"{n} arcs are more than the {most} that a sequential kernel may hold")


def _frame(rows: Iterable, schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(",")]
    rows = list(rows)
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


def _rows(g, key) -> DataFrame:
    nodes = g.nodes.select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"), "pos", F.lit(0).alias("kind"))
    arcs = g.arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"), "pos", F.lit(1).alias("kind"))
    return nodes.unionByName(arcs)


def _net(part: pd.DataFrame, directed: bool) -> Net:
    nodes, arcs = part[part.kind == 0], part[part.kind == 1]
    return Net(list(zip(nodes.a.tolist(), nodes.pos.tolist(), strict=True)), list(zip(arcs.a.tolist(), arcs.b.tolist(), arcs.w.tolist(), arcs.pos.tolist(), strict=True)), directed)


def on_executor(g, kernel: Callable[[Net], Iterable[tuple]], schema: str, most: int | None = None) -> DataFrame:
    """Rows of ``kernel`` on the whole graph, in one task."""
    guard(g, most)
    directed = g.directed
    lone = g.spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("pos"), F.lit(2).alias("kind"))
    rows = _rows(g, None).unionByName(lone).withColumn("one", F.lit(0))
    return rows.groupBy("one").applyInPandas(lambda part: _frame(kernel(_net(part, directed)), schema), schema)


def run(g, kernel: Callable[[Net], Iterable[tuple]], schema: str) -> list:
    """``on_executor``, collected; an exception of the kernel is raised here as it was there."""

    def caught(net: Net) -> Iterator[tuple]:
        try:
            rows = list(kernel(net))
        except Exception as e:  # noqa: BLE001
            yield pickle.dumps(e), None
            return
        yield None, pickle.dumps(rows)

    row = on_executor(g, caught, "error binary, rows binary").first()
    if row["error"] is not None:
        raise pickle.loads(bytes(row["error"]))
    return pickle.loads(bytes(row["rows"]))


def frame(g, kernel: Callable[[Net], Iterable[tuple]], schema: str) -> DataFrame:
    """``on_executor``, computed once: errors come now, not when it is read, and rows don't pass the driver."""
    width = len(schema.split(","))

    def caught(net: Net) -> Iterator[tuple]:
        try:
            rows = list(kernel(net))
        except Exception as e:  # noqa: BLE001
            yield pickle.dumps(e), *[None] * width
            return
        for row in rows:
            yield None, *row

    made = cut(on_executor(g, caught, f"error binary, {schema}"))
    if (bad := made.where("error is not null").first()) is not None:
        raise pickle.loads(bytes(bad["error"]))
    return made.drop("error")


def per_component(g, kernel: Callable[[Net], Iterable[tuple]], schema: str, parts: DataFrame | None = None) -> DataFrame:
    """Rows of ``kernel`` for each connected component, in parallel; ``parts`` are the components, if known."""
    parts = g.connected_components() if parts is None else parts
    directed = g.directed
    largest = g.arcs.join(parts.withColumnRenamed("id", "src"), "src").groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > MOST_ARCS:
        raise ValueError(f"a component has {largest} arcs, more than the {MOST_ARCS} that a kernel may hold")
    rows = _rows(g, None).join(parts.withColumnRenamed("id", "a"), "a")
    return rows.groupBy("component").applyInPandas(lambda part: _frame(kernel(_net(part, directed)), schema), schema)


def per_source(g, kernel: Callable[[Net, list[int]], Iterable[tuple]], schema: str, sources: DataFrame | None = None) -> DataFrame:
    """Rows of ``kernel`` over the numbers of ``sources`` (all nodes), with the graph broadcast to the tasks."""
    guard(g)
    spark = g.spark
    nodes = [(r["id"], r["pos"]) for r in g.nodes.collect()]
    arcs = [tuple(r) for r in g.arcs.select("src", "dst", "weight", "pos").collect()]
    held = spark.sparkContext.broadcast((nodes, arcs, g.directed))
    wanted = (sources or g.nodes.select("id")).repartition(max(8, spark.sparkContext.defaultParallelism), "id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Net(*held.value)
        for part in batches:
            rows = iter(kernel(net, [net.index[x] for x in part["id"].tolist() if x in net.index]))
            while some := list(islice(rows, FRAME_ROWS)):
                yield _frame(some, schema)

    return wanted.mapInPandas(work, schema)

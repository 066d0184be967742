"""Programmes over a DAG that need all of a node's predecessors before the node itself."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import discard, round_cut, shared_dir

#: Rounds after which what is done is put together.
TOGETHER = 16
#: Nodes and arcs of a block, which one task holds.
BLOCK_ROWS = 1_000_000
_TOLD = "block long, id long, own boolean, x double, generation long, pos long, via long, met long, next long"


def _firsts(to: np.ndarray, x: np.ndarray, generation: np.ndarray, pos: np.ndarray, via: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``to`` and what is best for it, and where in it each ``to`` begins."""
    order = np.lexsort((-via, pos, generation, -x, to))
    return order, np.flatnonzero(np.append(True, np.diff(to[order]) != 0)[: len(to)])


class _Block:
    """The nodes of a block, by id, and what is known of the arcs into them."""

    def __init__(self, nodes: pa.Table):
        by = np.argsort(nodes["src"].to_numpy())
        self.ids, self.pos, self.start, self.left = (nodes[c].to_numpy()[by] for c in ("src", "pos", "weight", "need"))
        n = len(self.ids)
        self.best = [np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)]
        self.generation, self.length, self.done = np.zeros(n, np.int64), self.start.copy(), np.zeros(n, bool)

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``ids`` here, and whether they are."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        return at, self.ids[at] == ids

    def hear(self, to: np.ndarray, x: np.ndarray, generation: np.ndarray, pos: np.ndarray, via: np.ndarray, met: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Nodes that nothing is missing before any more, once ``to`` have these offers."""
        order, new = _firsts(to, x, generation, pos, via)
        at, pick = to[order[new]], order[new]
        a, b = [c[pick] for c in (x, generation, pos, via)], [c[at] for c in self.best]
        better = a[3] > b[3]
        for u, v in ((a[2], b[2]), (a[1], b[1]), (b[0], a[0])):
            better = (u < v) | ((u == v) & better)
        for k in range(4):
            self.best[k][at[better]] = a[k][better]
        np.maximum.at(self.generation, to, after)
        self.left[at] -= np.add.reduceat(met[order], new) if len(new) else 0
        return at[self.left[at] == 0]

    def finish(self, front: np.ndarray) -> None:
        self.done[front] = True
        self.length[front] = np.maximum(self.start[front], self.best[0][front])


def _turn(rows: pa.Table, told: pa.Table, bounds: np.ndarray) -> pa.Table:
    """What a block's nodes come to by all that it was told so far, and what that is to nodes of other blocks: of news alone."""
    names = [c.split()[0] for c in _TOLD.split(", ")]
    if not rows.num_rows:
        return pa.table({c: pa.array([], pa.bool_() if c == "own" else pa.float64() if c == "x" else pa.int64()) for c in names})
    number, arcs = rows["block"][0].as_py(), rows.filter(pc.is_valid(rows["dst"]))
    b = _Block(rows.filter(pc.is_null(rows["dst"])))
    u, known = b.place(arcs["src"].to_numpy())
    order = np.flatnonzero(known)[np.argsort(u[known], kind="stable")]
    u, dst, weight = u[order], arcs["dst"].to_numpy()[order], arcs["weight"].to_numpy()[order]
    to = np.searchsorted(bounds, dst, "right")
    at, known = b.place(dst)
    inside, outside = np.flatnonzero((to == number) & known), np.flatnonzero(to != number)
    u_in, at, w_in = u[inside], at[inside], weight[inside]
    ends = np.cumsum(np.bincount(u_in, minlength=len(b.ids)))
    own = told.filter(told["own"])
    letters = told.filter(pc.invert(told["own"]))
    there, known = b.place(letters["id"].to_numpy())
    b.hear(there[known], *(letters[c].to_numpy()[known] for c in ("x", "generation", "pos", "via", "met", "next")))
    front = np.flatnonzero(b.left == 0)
    while len(front):
        b.finish(front)
        n = ends[front] - np.where(front > 0, ends[front - 1], 0)
        arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[front] - n, n)
        s, w = u_in[arc], w_in[arc]
        front = b.hear(at[arc], b.length[s] + w, b.generation[s], b.pos[s], b.ids[s], np.ones(len(s), np.int64), b.generation[s] + 1)
    news = b.done.copy()
    news[b.place(own["id"].to_numpy())[0]] = False
    mine = np.flatnonzero(news)
    out = outside[news[u[outside]]]
    s = u[out]
    x, generation = b.length[s] + weight[out], b.generation[s]
    order, new = _firsts(dst[out], x, generation, b.pos[s], b.ids[s])
    pick = order[new]
    met = np.diff(np.append(new, len(order)))
    after = np.maximum.reduceat(generation[order], new) + 1 if len(new) else new
    grew, none = b.best[0][mine] > b.start[mine], np.zeros(len(mine), np.int64)
    both = lambda a, c, t=pa.int64(): pa.chunked_array([pa.array(a, t), pa.array(c, t)])
    previous = pa.chunked_array([pa.array(b.best[3][mine], pa.int64(), mask=~grew), pa.array(b.ids[s[pick]], pa.int64())])
    columns = [
        both(np.full(len(mine), number), to[out[pick]]),
        both(b.ids[mine], dst[out[pick]]),
        both(np.ones(len(mine), bool), np.zeros(len(pick), bool), pa.bool_()),
        both(b.length[mine], x[pick], pa.float64()),
        both(b.generation[mine], generation[pick]),
        both(b.pos[mine], b.pos[s[pick]]),
        previous,
        both(none, met),
        both(none, after),
    ]
    return pa.table(columns, names)


def heaviest(nodes: DataFrame, arcs: DataFrame, max_rounds: int = 100_000) -> tuple[DataFrame, bool]:
    """``(id, pos, length, previous, generation)`` of ``nodes (id, pos, start)``, and whether every node came to its turn.

    ``length`` is the greatest of ``start`` and the lengths before plus the weights of ``arcs (src, dst, weight)``, by way
    of ``previous`` where that is greater; of equal ones the earliest generation counts, then the least ``pos``.
    Nodes are in blocks by ranges of ids. A block keeps its nodes and arcs in a bucketed table and goes as far as what it
    was told allows; then it tells other blocks what their nodes get, once for all its arcs into a node. A block waits for
    blocks with news that have arcs into it, so where blocks are in the order of the arcs each has one turn.
    """
    spark = arcs.sparkSession
    bare = nodes.where("id is null").select("id", "pos", F.col("start").alias("length"), F.lit(None).cast("long").alias("previous"), F.lit(0).cast("long").alias("generation"))
    nodes, arcs = nodes.where("id is not null"), arcs.where("src is not null and dst is not null")
    size = nodes.count()
    count = max(1, math.ceil((size + arcs.count()) / BLOCK_ROWS))
    ends = arcs.select(F.col("src").alias("id")).unionByName(nodes.select("id"))
    bounds = np.array(sorted(set(ends.approxQuantile("id", [k / count for k in range(1, count)], 1 / (4 * count)))) if count > 1 else [])
    need = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    none = F.lit(None).cast("long")
    rows = nodes.join(need, "id", "left").select(F.col("id").alias("src"), none.alias("dst"), F.col("start").alias("weight"), "pos", F.coalesce("need", F.lit(0)).alias("need"))
    rows = rows.unionByName(arcs.select("src", "dst", F.coalesce("weight", F.lit(-math.inf)).alias("weight"), none.alias("pos"), none.alias("need")))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, batch["src"].to_numpy(), "right")), *batch.columns], ["block", *batch.schema.names])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.unique(np.stack([batch["block"].to_numpy(), np.searchsorted(bounds, batch["dst"].to_numpy(), "right")]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    name = f"lattica_sweep_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows.mapInArrow(dealt, "block long, src long, dst long, weight double, pos long, need long").repartition(count, "block").write.bucketBy(count, "block").option("path", f"{path}_rows").saveAsTable(name)
    table = spark.table(name)
    before: dict[int, set[int]] = {}
    if count > 1:
        for r in table.where("dst is not null").select("block", "dst").mapInArrow(met, "a long, b long").where("a <> b").distinct().collect():
            before.setdefault(r["b"], set()).add(r["a"])
    news, paths = {r["block"] for r in table.select("block").distinct().collect()}, []
    while news:
        if len(paths) == max_rounds:
            raise RuntimeError(f"blocks aren't settled after {max_rounds} rounds")
        turn = {b for b in news if not before.get(b, set()) & news} or news
        told = spark.read.schema(_TOLD).parquet(*paths) if paths else spark.createDataFrame([], _TOLD)
        part, told = (df.where(F.col("block").isin(sorted(turn))) for df in (table, told))
        out = part.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _turn(a, b, bounds), _TOLD)
        paths.append(f"{path}_told{len(paths)}")
        out.write.parquet(paths[-1])
        news = (news - turn) | {r["block"] for r in spark.read.schema(_TOLD).parquet(paths[-1]).where("not own").select("block").distinct().collect()}
    spark.sql(f"DROP TABLE {name}")
    discard(spark, f"{path}_rows")
    done = (spark.read.schema(_TOLD).parquet(*paths) if paths else spark.createDataFrame([], _TOLD)).where("own")
    found = done.select("id", "pos", F.col("x").alias("length"), F.col("via").alias("previous"), "generation")
    return found.unionByName(bare), found.count() == size


def sweep(nodes: DataFrame, arcs: DataFrame, push: list[Column], merge: Callable[[], dict[str, Column]]) -> tuple[DataFrame, bool]:
    """``nodes (id, ...)`` with their last values and ``generation``, and whether every node came to its turn.

    A node's turn is the round after that of its last predecessor. Then it sends its values
    along ``arcs (src, dst, ...)``: ``push`` are aggregates over the columns of sender and arc, and
    ``merge()`` makes a node's columns from its own, which hold what earlier rounds sent, and
    these. Every arc is used once. A round keeps what is left of the nodes; a cycle never comes to
    its turn.
    """
    need = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_need"))
    left = round_cut(nodes.join(need, "id", "left").fillna(0, ["_need"]))
    columns, done, k = nodes.columns, None, 0
    while True:
        count = left.groupBy((F.col("_need") == 0).alias("ready")).count().collect()
        sizes = {r["ready"]: r["count"] for r in count}
        if not sizes.get(True):
            return (nodes.where(F.lit(False)).withColumn("generation", F.lit(0).cast("long")) if done is None else done), not sizes
        front = left.where("_need = 0").drop("_need")
        ready = front.withColumn("generation", F.lit(k).cast("long"))
        done = ready if done is None else done.unionByName(ready)
        if k % TOGETHER == TOGETHER - 1:
            done = round_cut(done)
        if not sizes.get(False):
            return done, True
        sent = arcs.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_met"), *push)
        met = left.where("_need > 0").join(sent, "id", "left").withColumn("_need", F.col("_need") - F.coalesce("_met", F.lit(0)))
        left = round_cut(met.withColumns(merge()).select(*columns, "_need"))
        k += 1


def along(start: int, steps: DataFrame) -> DataFrame:
    """``(id)``: ``start`` and all that following ``steps (id, next)`` from it comes to, in rounds that each look twice as far ahead."""
    spark = steps.sparkSession
    on = round_cut(spark.createDataFrame([(start,)], "id long"))
    jump = round_cut(steps.where("next is not null").select("id", "next"))
    while True:
        new = round_cut(on.join(jump, "id").select(F.col("next").alias("id")).join(on, "id", "left_anti"))
        if new.isEmpty():
            return on
        on = round_cut(on.unionByName(new))
        jump = round_cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))

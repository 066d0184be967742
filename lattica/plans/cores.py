"""Core numbers from blocks of nodes that settle by themselves and tell each other what fell."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import cut, discard, shared_dir

#: Arcs of a block, which one task holds.
BLOCK_ARCS = 8_000_000
_TOLD = "block long, id long, core long, own boolean"


def _settled(src: np.ndarray, dst: np.ndarray, told: np.ndarray, cores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of arcs sorted by ``src`` in one numbering, the numbers of the sources, and estimates of all.

    Sources are peeled off level by level; the other ends go at the level that was ``told`` of
    them, or never. What is left of a source's neighbours at its level is the most that all of this allows.
    """
    new = np.concatenate([[True], src[1:] != src[:-1]])
    ids, size = src[new], np.diff(np.append(np.flatnonzero(new), len(src)))
    names = np.unique(np.concatenate([ids, np.unique(dst)]))
    own, near = np.searchsorted(names, ids), np.searchsorted(names, dst).astype(np.int32)
    never = np.iinfo(np.int64).max
    estimate = np.full(len(names), never)
    at = np.minimum(np.searchsorted(names, told), len(names) - 1)
    known = names[at] == told
    np.minimum.at(estimate, at[known], cores[known])
    estimate[own] = never
    # The sources that each end is a neighbour of.
    back = np.repeat(own, size).astype(np.int32)[np.argsort(near, kind="stable")]
    upto = np.cumsum(np.bincount(near, minlength=len(names)))
    degree = np.full(len(names), never)
    degree[own] = size
    outer = np.flatnonzero(estimate < never)
    outer = outer[np.argsort(estimate[outer], kind="stable")]
    levels, gone, k, left = estimate[outer], 0, 0, own
    while len(left):
        k = max(k, int(min(degree[left].min(), levels[gone] if gone < len(levels) else never)))
        more = gone + int(np.searchsorted(levels[gone:], k, "right"))
        front, gone = outer[gone:more], more
        off = left[degree[left] <= k]
        while True:
            estimate[off] = k
            degree[off] = never
            front = np.concatenate([front, off])
            if not len(front):
                break
            n = upto[front] - np.where(front > 0, upto[front - 1], 0)
            hit = back[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(upto[front] - n, n)]
            hit, lost = np.unique(hit[degree[hit] < never], return_counts=True)
            degree[hit] -= lost
            front, off = np.empty(0, np.int64), hit[degree[hit] <= k]
        left = left[degree[left] < never]
    return names, own, estimate


def core_numbers(both: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(id, core)`` for ``both (src, dst)``, each edge both ways, no loops and none twice.

    Nodes are in blocks by ranges of ids. A block keeps its arcs in a bucketed table and settles its estimates as far
    as what it was told of other blocks' nodes allows; only then nodes that fell are told to the blocks that
    name them, and only blocks that were told something go on. Estimates never are below the
    core numbers, and where nothing falls any more they are these.
    """
    spark = both.sparkSession
    arcs = cut(both.select("src", "dst"))
    count = max(1, math.ceil(arcs.count() / BLOCK_ARCS))
    bounds = np.array(sorted(set(arcs.approxQuantile("src", [k / count for k in range(1, count)], 1 / (4 * count)))) if count > 1 else [])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, batch["src"].to_numpy(), "right")), batch["src"], batch["dst"]], ["block", "src", "dst"])

    def settle(part: pa.Table, told: pa.Table) -> pa.Table:
        src, dst = part["src"].to_numpy(), part["dst"].to_numpy()
        if (src[1:] < src[:-1]).any():
            order = np.argsort(src, kind="stable")
            src, dst = src[order], dst[order]
        block = part["block"][0].as_py() if part.num_rows else 0
        names, own, now = _settled(src, dst, told["id"].to_numpy(), told["core"].to_numpy()) if part.num_rows else (np.empty(0, np.int64),) * 3
        before = np.full(len(names), -1)
        mine = told.filter(told["own"])
        before[np.searchsorted(names, mine["id"].to_numpy())] = mine["core"].to_numpy()
        fell = np.zeros(len(names), bool)
        fell[own] = now[own] != before[own]
        # Both ends of an edge name each other, so a node is told to the blocks of its neighbours.
        lone, to = np.flatnonzero(fell), np.searchsorted(bounds, dst, "right")
        pick = to != block
        who = np.searchsorted(names, src[pick])
        who, to = np.divmod(np.unique((who * (len(bounds) + 1) + to[pick])[fell[who]]), len(bounds) + 1)
        at = np.concatenate([lone, who])
        return pa.table({"block": pa.array(np.concatenate([np.full(len(lone), block), to]), pa.int64()), "id": pa.array(names[at], pa.int64()), "core": pa.array(now[at], pa.int64()), "own": pa.array(np.arange(len(at)) < len(lone))})

    name = f"lattica_cores_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    arcs.mapInArrow(dealt, "block long, src long, dst long").repartition(count, "block").write.bucketBy(count, "block").sortBy("src").option("path", path).saveAsTable(name)
    table, known = spark.table(name), spark.createDataFrame([], _TOLD)
    active = None
    for _ in range(max_rounds):
        part, told = (table, known) if active is None else (x.where(F.col("block").isin(active)) for x in (table, known))
        out = cut(part.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: settle(a, b), _TOLD))
        known = cut(known.unionByName(out).groupBy("block", "id", "own").agg(F.min("core").alias("core")).select("block", "id", "core", "own"))
        active = [r["block"] for r in out.where("not own").select("block").distinct().collect()]
        if not active:
            break
    else:
        raise RuntimeError(f"core numbers aren't settled after {max_rounds} rounds")
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    return known.where("own").select("id", "core")

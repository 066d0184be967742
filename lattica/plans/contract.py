"""Edges that a task has, put for fewer that join the same nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Edges that a task holds before it contracts them.
HELD = 1_000_000


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's part, for edges ``a, b`` between nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _stars(u: np.ndarray, v: np.ndarray, odd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Each node with the least of its part, and whether their sides differ; a part without sides has a loop that is odd."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    if odd is None:
        label = _labels(a, b, len(names))
        rest = np.flatnonzero(label != np.arange(len(names)))
        return names[rest], names[label[rest]], None
    label = _labels(np.concatenate([2 * a, 2 * a + 1]), np.concatenate([2 * b + odd, 2 * b + 1 - odd]), 2 * len(names))
    even, least = label[::2], label[::2] // 2
    rest = np.flatnonzero(least != np.arange(len(names)))
    loops = np.flatnonzero((label[1::2] == even) & (least == np.arange(len(names))))
    return np.concatenate([names[rest], names[loops]]), np.concatenate([names[least[rest]], names[loops]]), np.concatenate([even[rest] % 2, np.ones(len(loops), np.int64)])


def _contracted(edges: DataFrame, sides: bool) -> DataFrame:
    names = ["u", "v", "odd"] if sides else ["u", "v"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> list[np.ndarray]:
            u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            out = _stars(u, v, np.concatenate([h[2] for h in held]) if sides else None)
            return list(out[: len(names)])

        held, size = [], 0
        for batch in batches:
            held.append([batch[k].to_numpy().astype(np.int64) for k in range(len(names))])
            size += batch.num_rows
            if size >= HELD:
                held = [made()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made()], names)

    return edges.mapInArrow(work, ", ".join(f"{c} long" for c in names))


def contracted(edges: DataFrame) -> DataFrame:
    """``(u, v)``: edges that leave the parts of ``edges (u, v)`` as they are, at most one a node in a task's share, if that isn't too large.

    The nearer to each other neighbours are kept, the fewer they are.
    """
    return _contracted(edges.select("u", "v"), False)


def with_sides(edges: DataFrame) -> DataFrame:
    """``(u, v, odd)``, as ``contracted``, for ``edges (u, v, odd)`` whose ends are on different sides where odd is 1 and on the same where it is 0: with the same parts, sides and lack of sides."""
    return _contracted(edges.select("u", "v", "odd"), True)

"""A batch of many rows becomes Python objects a few rows at a time."""

import pyarrow as pa

from lattica.operators import structure as T


def test_few_rows_are_objects_at_once(monkeypatch):
    monkeypatch.setattr(T, "HELD", 10)
    kind = pa.list_(pa.struct([("y", pa.int64()), ("seen", pa.int64())]))
    other = pa.list_(pa.struct([("y", pa.int64()), ("z", pa.int64())]))
    rows = [{"x": x, "later": [{"y": x + k, "seen": k - 1} for k in (1, 2, 3)], "edges": [{"y": x + 1, "z": x + 2}] if x % 2 else None} for x in range(100)]
    rows[7]["later"] = [{"y": 7 + k, "seen": 0} for k in range(1, 30)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("x", pa.int64()), ("later", kind), ("edges", other)]))
    out = list(T._cliques(iter([batch])))
    assert len(out) > 30 and max(b.num_rows for b in out) <= 10
    got = sorted((r["x"], tuple(r["rest"]), r["lead"]) for b in out for r in b.to_pylist())
    want = []
    for r in rows:
        x, ys = r["x"], [p["y"] for p in r["later"]]
        seen = {p["y"]: p["seen"] for p in r["later"]}
        sets = [(x + 1, x + 2), *((y,) for y in ys[2:])] if r["edges"] else [(y,) for y in ys]
        want += [(x, s, min(s, key=lambda v: (seen[v], v)) if seen[min(s, key=lambda v: (seen[v], v))] else None) for s in sets]
    assert got == sorted(want)

"""Exponent, epochs, blocks and positions of a mix, against an independent version."""

import math
from collections import defaultdict

import pytest

from lattica.llm import mixing


def entropy(weights):
    return -sum(w * math.log(w) for w in weights)


def test_skewed_sources(spark):
    """One source has most of the words: its exponent, budget and permutations are those worked out here."""
    sizes = {"big": (600, 20), "mid": (60, 20), "low": (30, 20), None: (12, 15)}
    docs, k = [], 0
    for source, (n, words) in sizes.items():
        for _ in range(n):
            docs.append((k, " ".join(["w"] * words), source))
            k += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df, target_entropy=0.9, repeats=40.0).collect()
    tokens = {s: n * (w + 1) for s, (n, w) in sizes.items()}
    total = sum(tokens.values())

    def weights(alpha):
        raised = {s: (t / total) ** alpha for s, t in tokens.items()}
        z = sum(raised.values())
        return {s: x / z for s, x in raised.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights(mid).values()) >= 0.9 * math.log(4) else (low, mid)
    want = weights(low)
    assert {r["source"]: r["weight"] for r in out} == pytest.approx(want, rel=2e-3)
    budget = max(t / want[s] for s, t in tokens.items())
    seen, epochs = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for r in out:
        seen[r["source"]] += r["n_tokens"]
        epochs[r["source"]][r["epoch"]].append(r)
    for s, t in tokens.items():
        assert abs(seen[s] - want[s] * budget) <= 0.02 * want[s] * budget + 21
        assert len(epochs[s]) == math.ceil(round(seen[s] / t, 6))
    orders = {}
    for s, found in epochs.items():
        for e, rows in found.items():
            rows.sort(key=lambda r: r["ahead"])
            if e < len(found) - 1 or seen[s] % tokens[s] == 0:  # a full epoch sees every document once
                assert sorted(r["doc_id"] for r in rows) == [i for i, _, x in docs if x == s]
            at, line = 0, []
            for r in rows:
                assert r["ahead"] == at
                at += r["n_tokens"]
                if not line or line[-1] != r["block"]:
                    line.append(r["block"])
            assert len(line) == len(set(line)), "a block stands together"
            orders[s, e] = line
    assert len(orders["big", 0]) > 50
    low0, low1 = orders["low", 0], orders["low", 1]
    assert set(low0) == set(low1) and low0 != low1, "every epoch has its own order"
    both = set(orders["mid", 0]) & set(low0)
    assert [b for b in orders["mid", 0] if b in both] != [b for b in low0 if b in both], "and every source"
    mixed = mixing.repeated(df, 0.9, 40.0)
    times = defaultdict(int)
    for r in out:
        times[r["doc_id"]] += 1
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times


def test_large_side_of_switches(spark, monkeypatch):
    """Sources that meet by a shuffle give the same mix as those that are broadcast."""
    df = spark.createDataFrame([(i, "a b c " * (1 + i % 7), f"s{i % 9 % 4}") for i in range(200)], "doc_id long, text string, source string")
    rows = lambda: sorted(tuple(r) for r in mixing.mix(df).collect())
    near = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == near

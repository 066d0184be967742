"""Few edges for many, with the same parts and sides."""

import random

from pyspark.sql import functions as F

from lattica.plans import contract
from lattica.plans.components import components


def roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        up[b] = a
    return {x: top(x) for x in up}


def test_contracted(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(30 * k + rng.randrange(30), 30 * k + rng.randrange(30)) for k in range(10) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]] + [(1000 + i, 1001 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(2)
    few = contract.contracted(df)
    assert few.count() <= 2 * len(roots(edges)) and few.count() < len(edges)
    assert dict(map(tuple, components(df).collect())) == roots(edges)
    assert roots([tuple(r) for r in few.collect()]) == roots(edges)


def test_with_sides(spark):
    rng, edges = random.Random(4), []
    for k in range(40):
        edges += [(20 * k + a, 20 * k + b) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(12)) if a != b and (k % 3 == 0 or (a + b) % 2)]
    few = contract.with_sides(spark.createDataFrame(edges, "u long, v long").withColumn("odd", F.lit(1).cast("long")).repartition(3))
    twice = lambda rows: [(2 * u + s, 2 * v + (s ^ odd)) for u, v, odd in rows for s in (0, 1)]
    assert roots(twice((u, v, 1) for u, v in edges)) == roots(twice(map(tuple, few.collect())))

"""Components against union-find, also of struct nodes."""

import random

from pyspark.sql import functions as F

from facetflow.operators.graph import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5300)] + [(None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    pairs = spark.createDataFrame([((1, 2), (1, 1)), ((1, 1), (1, 1)), ((2, 5), (1, 2)), ((7, 7), (7, 8))], "a struct<m:int,f:int>, b struct<m:int,f:int>")
    assert {tuple(r.node): tuple(r.component) for r in components(pairs).collect()} == {(1, 1): (1, 1), (1, 2): (1, 1), (2, 5): (1, 1), (7, 7): (7, 7), (7, 8): (7, 7)}
    assert components(pairs.where(F.lit(False))).count() == 0
    assert got == {n: top(n) for e in edges if e[0] is not None and e[0] != e[1] for n in e}



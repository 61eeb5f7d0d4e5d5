"""Connected components on random graphs, chains and hubs."""

import random

from lintlake.plans.graph import connected_components


def model(edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    r = random.Random(2)
    cases = [
        [(i, i + 1) for i in range(40)],
        [(0, i) for i in range(1, 30)] + [(50, 50)],
        [(r.randrange(-20, 60), r.randrange(-20, 60)) for _ in range(50)],
    ]
    for edges in cases:
        df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
        assert {x.node: x.component for x in connected_components(df).collect()} == model(edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0

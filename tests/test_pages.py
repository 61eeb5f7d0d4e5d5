"""Pages hold the sorted lists of their groups, whatever the sizes of the groups."""

import random

from pyspark.sql import functions as F

from lintlake.operators.pages import in_pages


def pages(df, keys, value, n):
    got = {}
    for r in in_pages(df, keys, value, n).collect():
        assert r.n_before == r.page * n and 0 < len(r["values"]) <= n
        got.setdefault(tuple(r[k] for k in keys), {})[r.page] = r["values"]
    return {k: [got_[i] for i in range(len(got_))] for k, got_ in got.items()}


def test_groups_of_all_sizes(spark):
    r = random.Random(8)
    rows = [("hot", "x", f"v{r.randint(0, 4000):05d}") for _ in range(3000)] + [(None, "x", f"é{i % 7}") for i in range(25)] + [("b", None, "one"), ("b", None, None), ("c", "x", None)]
    rows += [(f"g{i}", "y", f"v{j}") for i in range(30) for j in range(i % 5)]
    df = spark.createDataFrame(rows, "a string, b string, v string").repartition(5)
    want = {}
    for a, b, v in rows:
        if v is not None:
            want.setdefault((a, b), []).append(v)
    for n in (1000, 7):
        got = pages(df, ["a", "b"], "v", n)
        assert {k: sum(p, []) for k, p in got.items()} == {k: sorted(v, key=str.encode) for k, v in want.items()}
        assert all(len(p) == n for parts in got.values() for p in parts[:-1])


def test_empty_and_numbers(spark):
    assert in_pages(spark.createDataFrame([], "k string, v long"), ["k"], "v").count() == 0
    assert pages(spark.range(10).select(F.lit("k").alias("k"), "id"), ["k"], "id", 4) == {("k",): [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]}

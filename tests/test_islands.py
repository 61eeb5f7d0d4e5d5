"""Merging within islands of lines, over borders of blocks, against the greedy loop over a whole file."""

import random

from pyspark.sql import functions as F

from lintlake.operators import findings as M
from lintlake.operators.scan import ORDER
from tests.test_findings import finding, frame, greedy


def test_islands_over_blocks(spark):
    lines = [*range(1, 5), *range(1000, 3100), 3102, 4095, 4096, 5119, 5121, *range(6143, 6146), None]
    df = spark.createDataFrame([("f", x) for x in lines * 2] + [("g", 3)], "file string, line int")
    want, first = {}, None
    for before, x in zip([None, *lines], lines):
        first = x if x is None or before is None or x - before > 1 else first
        want[x] = first
    got = M.with_islands(df, ["file"]).collect()
    assert len(got) == 2 * len(lines) + 1
    assert {(r.file, r.line): r["__island"] for r in got} == {("f", k): v for k, v in want.items()} | {("g", 3): 3}


def test_merge_in_one_large_file(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BITS", 4)
    r = random.Random(9)
    rows = {}
    for k in range(1500):
        x = finding(r.choice(["sql-injection", "command-injection", "xss-html"]), r.randint(1, 900), r.choice(["high", "medium", "low"]), "a", f"e{k % 3}", project="p", engine=r.randint(0, 1))
        rows.setdefault((x[1], x[10], x[11], x[2], x[3], x[12]), x)
    expected = greedy([v for _, v in sorted(rows.items())])
    got = M.deduplicate(frame(spark, list(rows.values())).withColumn("note", F.lit(None).cast("string")), ORDER).drop("note").collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(map(repr, expected))


def test_merge_of_nothing(spark):
    assert M.deduplicate(frame(spark, []), ORDER).collect() == []


def test_lone_findings_need_no_island(spark, monkeypatch):
    """Only findings that have others near their line, or that are at the border of a block, are put together to islands."""
    seen, put_together = [], M.with_islands

    def counted(rows, keys):
        seen.append(sorted(r.line for r in rows.select("line").collect()))
        return put_together(rows, keys)

    monkeypatch.setattr(M, "with_islands", counted)
    rows = [finding("sql-injection", x, "high", "a", "e", project="p", engine=0) for x in [3, 10, 11, 20, 22, 1023, 1024, 3000]]
    got = M.deduplicate(frame(spark, rows), ORDER).collect()
    assert seen == [[10, 11, 1023, 1024]] and sorted(r.line for r in got) == [3, 10, 20, 22, 1023, 3000]

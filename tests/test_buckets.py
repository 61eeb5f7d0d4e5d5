"""Updates of a bucketed table write what they touch, survive replays and failures, and agree with whole rewrites."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lintlake.operators import governance as G
from lintlake.sources import buckets as B
from lintlake.streaming import jobs

SCHEMA = "project_id string, key string, n long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def add(rows, changes):
    """Adds up by key; a sum of zero drops the row."""
    return rows.unionByName(changes).groupBy("project_id", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def content(df):
    return {(r.project_id, r.key): r.n for r in df.collect()}


def test_updates_agree_with_a_dictionary(spark, tmp_path):
    r, path, want = random.Random(3), str(tmp_path / "t"), {}
    assert B.read_buckets(spark, path) is None
    projects = [None, "", "1", "01", "hot"] + [f"p{i}" for i in range(12)]
    for v in range(7):
        some = r.sample(projects, r.choice([0, 1, 3]) if v else 9)
        rows = [(p, r.choice("ab"), r.choice([-1, 1])) for p in some for _ in range(4)]
        for p, k, n in rows:
            want[p, k] = want.get((p, k), 0) + n
        want = {k: n for k, n in want.items() if n}
        B.update_buckets(table(spark, rows), path, v, add, table(spark, []), buckets=8)
        assert content(B.read_buckets(spark, path)) == want
        B.update_buckets(table(spark, rows), path, v, add, table(spark, []), buckets=8)
        assert content(B.read_buckets(spark, path)) == want
        B.drop_before(spark, path, v - 1)
        assert B.versions(spark, path) == [x for x in (v - 1, v) if x >= 0]
    assert B.read_buckets(spark, path).schema == table(spark, []).schema


def test_untouched_buckets_stay(spark, tmp_path):
    path = tmp_path / "t"
    B.write_buckets(table(spark, [(f"p{i}", "k", 1) for i in range(50)]), str(path), 0, buckets=16)
    touched = B.update_buckets(table(spark, [("p7", "k", 5)]), str(path), 1, add, table(spark, []))
    assert len(touched) == 1
    assert [p.name for p in (path / "data" / "version=1").glob("bucket=*")] == [f"bucket={touched[0]}"]
    assert content(B.read_buckets(spark, str(path)))["p7", "k"] == 6
    assert content(B.read_buckets(spark, str(path), 0))["p7", "k"] == 1
    B.drop_before(spark, str(path), 1)
    assert not (path / "data" / "version=0" / f"bucket={touched[0]}").exists()
    assert len(content(B.read_buckets(spark, str(path)))) == 50


def test_failed_update_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    B.write_buckets(table(spark, [("p", "k", 1)]), path, 0)

    def broken(rows, changes):
        return rows.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        B.update_buckets(table(spark, [("p", "k", 1)]), path, 1, broken, table(spark, []))
    assert B.versions(spark, path) == [0] and content(B.read_buckets(spark, path)) == {("p", "k"): 1}
    B.update_buckets(table(spark, [("p", "k", 1)]), path, 1, add, table(spark, []))
    assert content(B.read_buckets(spark, path)) == {("p", "k"): 2}
    B.update_buckets(table(spark, [("p", "k", -2)]), path, 2, add, table(spark, []))
    assert content(B.read_buckets(spark, path)) == {} and B.read_buckets(spark, path).columns == ["project_id", "key", "n"]


def test_lifecycle_by_buckets_is_the_lifecycle(spark, tmp_path):
    """Scans of the given findings by batches of months, against one application of all of them."""
    from lintlake.plans import adapters as A

    found = A.sql(spark, "/root/testdata/sf0.001", A.FINDINGS).withColumn("scanned_at", F.date_trunc("year", "seen_at")).where("project_id < 'p3'").persist()
    empty, path = spark.createDataFrame([], jobs.HISTORY), str(tmp_path / "h")
    step = lambda history, batch: G.apply_scans(batch, history).select(*history.columns)
    for v, (low, high) in enumerate([(0, 1993), (1993, 1996), (1996, 9999)]):
        year = F.year("scanned_at")
        B.update_buckets(found.where((year >= low) & (year < high)), path, v, step, empty, buckets=8)
    whole = G.apply_scans(found, empty).select(*empty.columns)
    got = B.read_buckets(spark, path)
    assert got.count() > 1000
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()

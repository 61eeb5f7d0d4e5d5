"""Queries whose work must not meet in a row, or grow with the product of two tables."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintlake.operators.scan import ORDER
from lintlake.plans import adapters as A
from lintlake.plans import queries as Q
from lintlake.plans import stored  # noqa: F401
from lintlake.sources import state

SF = "/root/testdata/sf0.001"


def test_history_of_a_project_is_many_documents(spark, tmp_path):
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("p"), (F.col("id") % 2).cast("string"))).alias("project_id"), F.concat(F.lit("fp"), F.col("id").cast("string")).alias("fingerprint"),
        F.lit("r").alias("rule_id"), F.lit("a.py").alias("file"), F.col("id").cast("int").alias("line"), F.lit("t").alias("title"), F.lit("HIGH").alias("severity"),
        F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.lit("2024-01-02").cast("timestamp").alias("last_seen"), F.lit(2).alias("times_seen"), F.lit("open").alias("status"),
    )
    state.write_history(rows, str(tmp_path / "out"), records=50)
    sizes = [len(json.loads(p.read_text())["findings"]) for p in (tmp_path / "out").rglob("part-*")]
    assert sum(sizes) == 3_000 and max(sizes) < 150 and len(sizes) > 30
    columns = [c for c in rows.columns if c != "project_id"]
    got = state.read_state(spark, str(tmp_path / "out"), "history").select(*columns)
    assert Counter(got.collect()) == Counter(rows.select(*columns).collect())


@pytest.mark.parametrize("query, whole", [("s2_read_state", None), ("w3_sarif", "to_sarif"), ("w4_html", "to_html")])
def test_no_document_is_whole_in_a_row(spark, monkeypatch, query, whole):
    want = {}
    if whole:
        documents = getattr(state, whole)(Q.findings(spark, SF).select(*Q.F_COLS), ORDER).collect()
        want = {r.project_id: r.document for r in documents}
        monkeypatch.setattr(state, whole, lambda *a: pytest.fail("a whole document in a row"))
    monkeypatch.setattr(state, "DOCUMENT_RECORDS", 10)
    got = Q.QUERIES[query](spark, SF).collect()
    if query == "w3_sarif":
        runs = {p: json.loads(d)["runs"][0] for p, d in want.items()}
        assert {tuple(r) for r in got} == {(p, len(want[p]), len(r["tool"]["driver"]["rules"]), len(r["results"])) for p, r in runs.items()}
    elif query == "w4_html":
        bodies = {p: d.split("Evidence</th></tr>")[1].removesuffix("</table>") for p, d in want.items()}
        assert {tuple(r) for r in got} == {(p, len(b), b.count("<tr>")) for p, b in bodies.items()}
    else:
        assert len(got) > 100


def test_parts_of_a_large_report_are_small(spark):
    """A reader's batch of 4096 parts stays in memory."""
    rows = Q.findings(spark, SF).select(*Q.F_COLS)
    for parts in (state.sarif_parts(rows, ORDER), state.html_parts(rows, ORDER)):
        assert parts.agg(F.max(F.length("text"))).first()[0] * 4096 < 128 << 20


def test_packages_do_not_grow_with_the_product(spark, tmp_path):
    """Copies of both tables with shifted keys: their pairs are sixteen times as many, the different packages are the same."""
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.crossJoin(spark.range(4).withColumnRenamed("id", "i")).withColumn(key, F.col(key) + 10_000 * F.col("i")).drop("i").write.parquet(str(tmp_path / f"{name}.parquet"))
    pairs = A.sql(spark, str(tmp_path), A.PACKAGES)
    few = A.sql(spark, str(tmp_path), A.DIFFERENT_PACKAGES)
    assert Counter(few.collect()) == Counter(pairs.distinct().collect())
    # sources differ by shifted keys modulo 3, no more than that
    assert few.count() <= 3 * A.sql(spark, SF, A.DIFFERENT_PACKAGES).count() < pairs.count()

"""What a query does not ask for is neither made nor dealt, and results stay the same."""

from pyspark.sql import functions as F

from lintlake.operators import correlate, governance as G
from lintlake.operators.scan import ORDER
from lintlake.plans import adapters as A

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merged_remediation_makes_no_text_that_is_not_asked_for(spark):
    f = A.sql(spark, SF, A.FINDINGS)
    t0, t1 = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp") for y in (2023, 2024))
    old = G.remediation_records(f.where("line <= 4"), t0).dropDuplicates(["project_id", "fingerprint"])
    merged = G.merge_remediation(old, G.remediation_records(f.where("line >= 3"), t1), t1)
    assert "Manual review" not in _plan(merged.select("project_id", "fingerprint", "status"))
    rows = {(r.project_id, r.fingerprint): r for r in merged.collect()}
    line = {r.finding.line for r in rows.values()}
    assert len(rows) == f.select("project_id", "rule_id", "file", "line", "evidence").distinct().count() and line >= {1, 3, 5}
    for r in rows.values():
        assert r.created_at.year == (2023 if r.finding.line <= 4 else 2024) and r.updated_at.year == (2023 if r.finding.line <= 2 else 2024)
        assert r.patch_preview.startswith("Manual review at " + r.finding.file)


def test_members_do_not_ask_for_reasons(spark):
    f = A.sql(spark, SF, A.FINDINGS)
    groups, members = correlate.correlate(f, ORDER)
    assert "by_family" not in _plan(members) and "by_family" in _plan(groups)
    sizes = {r.group_id: r["count"] for r in members.groupBy("group_id").count().collect()}
    assert sizes == {r.group_id: r.n_findings for r in groups.collect()}


def test_history_does_not_seek_records_that_are_not_asked_for(spark):
    f = A.sql(spark, SF, A.FINDINGS)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "project_id string, fingerprint string, rule_id string, file string, line int, title string, severity string, first_seen timestamp, last_seen timestamp, times_seen int, status string")
    done = G.update_lifecycle(f, empty, now)
    assert "max_by" not in _plan(done.select("project_id", "fingerprint", "status")) and "max_by" in _plan(done)

"""What large tables leave on disk while they are written and read."""

import os
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lintlake.operators.scan import ORDER
from lintlake.plans.lineage import written
from lintlake.sources import state


def _size(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def _shuffles(spark):
    """Bytes of each shuffle in the session's local folders, by number."""
    found = defaultdict(int)
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for folder, _, names in os.walk(top.getPath()):
            for name in names:
                if name.startswith("shuffle_") and name.endswith(".data"):
                    try:
                        found[int(name.split("_")[1])] += os.path.getsize(os.path.join(folder, name))
                    except FileNotFoundError:
                        pass
    return found


def _left(spark, before, most):
    """Shuffles of some size made since ``before``; Spark removes files in the background, so they may take a moment to go."""
    for _ in range(50):
        left = [k for k, size in _shuffles(spark).items() if k not in before and size > 100_000]
        if len(left) <= most:
            break
        time.sleep(0.2)
    return left


def _history(spark, n=40_000):
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    k = F.col("id")
    rows = spark.range(0, n, 1, 4).select(
        text("p", k % 3).alias("project_id"), F.substring(F.sha2(k.cast("string"), 256), 1, 20).alias("fingerprint"), text("rule-", k % 7).alias("rule_id"), text("src/f", k, ".py").alias("file"),
        (k % 9).cast("int").alias("line"), text("Title of rule ", k % 7).alias("title"), F.lit("HIGH").alias("severity"), F.lit("2024-01-01").cast("timestamp").alias("first_seen"),
        F.lit("2024-01-02").cast("timestamp").alias("last_seen"), F.lit(2).alias("times_seen"), F.lit("open").alias("status"),
    )
    return rows.repartition(4, "project_id", "fingerprint")


def test_a_lean_table_keeps_no_shuffle(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows, set_before = _history(spark), spark.conf.get(key, None)
    before = _shuffles(spark)
    table = written(rows, "lean", lean=True)
    assert _left(spark, before, 0) == [] and spark.conf.get(key, None) == set_before
    assert Counter(table.collect()) == Counter(rows.collect())


def test_history_is_dealt_once_and_documents_may_be_compressed(spark, tmp_path):
    rows, before = _history(spark), _shuffles(spark)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")  # less than the history, as for a large one
    try:
        state.write_history(rows, str(tmp_path / "small"), records=1_000, compression="gzip")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(_left(spark, before, 1)) == 1
    state.write_history(rows, str(tmp_path / "plain"), records=1_000)
    assert _size(tmp_path / "small") < _size(tmp_path / "plain") / 4
    columns = [c for c in rows.columns if c != "project_id"]
    want = Counter(rows.select(*columns).collect())
    for name in ("small", "plain"):
        assert Counter(state.read_state(spark, str(tmp_path / name), "history").select(*columns).collect()) == want


def _findings(spark, n=60_000):
    return spark.range(0, n, 1, 4).selectExpr(
        "concat('p', id % 5) as project_id", "0 as engine_rank", "concat('f', id) as file", "1 as line", "0 as rule_rank", "concat('rule-', id % 7) as rule_id", "concat('value ', id) as evidence",
        "concat('Title of rule ', id % 7) as title", "if(id % 3 = 0, 'HIGH', 'LOW') as severity", "'CWE-1' as cwe", "'fix' as remediation",
    )


def test_entries_are_made_after_findings_are_dealt(spark, monkeypatch):
    plans = {}

    def spy(df, label, **how):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString().lower()
        return written(df, label, **how)

    monkeypatch.setattr(state, "written", spy)
    for parts, sign in ((state.sarif_parts, "structstojson|to_json|sha2"), (state.html_parts, "<td>")):
        parts(_findings(spark, 100), ORDER)
        above, below = plans["document-parts"].split("repartitionbyexpression")
        assert any(x in above for x in sign.split("|")) and not any(x in below for x in sign.split("|")), plans["document-parts"]


def test_digests_deal_parts_once_and_compressed(spark):
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for parts in (state.sarif_parts, state.html_parts):
        before = _shuffles(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")  # less than the parts, as for large reports
        try:
            got = state.part_digests(parts(_findings(spark), ORDER)).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        left = _left(spark, before, 1)
        assert len(got) == 5 and len(left) <= 1
        assert sum(_shuffles(spark)[k] for k in left) < sum(r.n_bytes for r in got) / 4


def test_history_of_the_query_is_compressed(spark, monkeypatch, tmp_path):
    from lintlake.plans import stored

    monkeypatch.setattr(stored, "scratch_path", lambda spark, label: str(tmp_path / label))
    stored.s2(spark, "/root/testdata/sf0.001").count()
    names = [p.name for p in (tmp_path / "documents").rglob("part-*")]
    assert names and all(n.endswith(".gz") for n in names)

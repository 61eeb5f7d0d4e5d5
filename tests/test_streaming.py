"""Streams fed batch by batch give what the batch functions give."""

from datetime import datetime

from lintlake.sources import state
from lintlake.streaming import jobs

FILES = "project_id string, rel_path string, name string, suffix string, parts array<string>, size long, content string"


def test_scan_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("p", "a.py", "a.py", ".py", ["a.py"], 10, "DEBUG = True\n")], FILES).write.parquet(src)
    stream = spark.readStream.schema(FILES).parquet(src)
    jobs.scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["heuristics"]).awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["debug"]


FINDINGS = (
    "project_id string, engine_rank int, rule_rank int, rule_id string, title string, severity string, cwe string, file string, line int, evidence string, scanned_at timestamp"
)


def test_lifecycle_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k, evidence in enumerate(["x", "y", "x"]):
        row = ("p", 0, 0, "r", "t", "HIGH", "c", "f", 1, evidence, datetime(2024, 1, k + 1))
        spark.createDataFrame([row], FINDINGS).write.mode("append").parquet(src)
        jobs.lifecycle_stream(spark.readStream.schema(FINDINGS).parquet(src), out, cp).awaitTermination()
    got = {(r.times_seen, r.status) for r in state.current_state(spark, out).collect()}
    assert got == {(2, "reappeared"), (1, "fixed")}


def test_actions_and_registry(spark, tmp_path):
    actions = "project_id string, fingerprint string, state string, owner string, due_date date, decision string, rationale string, expires_at date, ts timestamp"
    src = str(tmp_path / "a")
    for k, s in enumerate(["open", "resolved"]):
        spark.createDataFrame([("p", "f", s, None, None, None, None, None, datetime(2024, 1, k + 1))], actions).write.mode("append").parquet(src)
        jobs.actions_stream(spark.readStream.schema(actions).parquet(src), str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    row = state.current_state(spark, str(tmp_path / "w")).first()
    assert (row.state, row.created_at) == ("resolved", datetime(2024, 1, 1))
    summaries = "project_id string, scan_id string, scanned_at timestamp"
    reg = str(tmp_path / "r")
    for k in range(3):
        spark.createDataFrame([("p", f"s{k}", datetime(2024, 1, k + 1))], summaries).write.mode("append").parquet(reg)
        jobs.registry_stream(spark.readStream.schema(summaries).parquet(reg), str(tmp_path / "ro"), str(tmp_path / "rc"), 2).awaitTermination()
    assert {r.scan_id for r in state.current_state(spark, str(tmp_path / "ro")).collect()} == {"s1", "s2"}


def test_audit_stream(spark, tmp_path):
    schema = "timestamp timestamp, event string, details map<string,string>"
    spark.createDataFrame([(datetime(2024, 1, 1), "e", {"secret": "1", "k": "v"})], schema).write.parquet(str(tmp_path / "in"))
    jobs.audit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first().details.asDict() == {"k": "v"}


def test_scans_of_a_batch_are_applied_together(spark):
    """Random scans, dealt to batches in all ways, against one scan after another; accepted risks between batches."""
    import random

    from pyspark.sql import functions as F

    from lintlake.operators import governance as G

    r = random.Random(12)
    for round_ in range(3):
        together = spark.createDataFrame([], jobs.HISTORY)
        one_by_one = spark.createDataFrame([], jobs.HISTORY)
        day = 1
        for _ in range(2):
            rows = []
            for _ in range(r.choice([1, 2, 3])):
                for p in "pqr":
                    if r.random() < 0.8:
                        rows += [(p, 0, k, f"r{k}", "t", "HIGH", "c", "f", r.randint(1, 9), e, datetime(2024, 1, day)) for k, e in enumerate("abcd") if r.random() < 0.5]
                day += 1
            batch = spark.createDataFrame(rows, FINDINGS)
            together = spark.createDataFrame(G.apply_scans(batch, together).select(*together.columns).collect(), jobs.HISTORY)
            for at in sorted({x[-1] for x in rows}):
                part = batch.where(F.col("scanned_at") == F.lit(at))
                here = part.select("project_id").distinct()
                rest, touched = one_by_one.join(here, "project_id", "left_anti"), one_by_one.join(here, "project_id", "left_semi")
                after = rest.unionByName(G.update_lifecycle(part, touched, F.lit(at)).select(*rest.columns))
                one_by_one = spark.createDataFrame(after.collect(), jobs.HISTORY)
            assert sorted(map(str, together.collect())) == sorted(map(str, one_by_one.collect()))
            risky = F.when(F.col("rule_id") == "r1", "accepted-risk").otherwise(F.col("status"))
            together, one_by_one = together.withColumn("status", risky), one_by_one.withColumn("status", risky)


def test_late_scan_and_replayed_batch(spark, tmp_path):
    """A scan that arrives late counts when it arrives; a batch that runs again changes nothing."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for evidence, day in (("x", 5), ("y", 2)):
        spark.createDataFrame([("p", 0, 0, "r", "t", "HIGH", "c", "f", 1, evidence, datetime(2024, 1, day))], FINDINGS).write.mode("append").parquet(src)
        for _ in range(2):
            jobs.lifecycle_stream(spark.readStream.schema(FINDINGS).parquet(src), out, cp).awaitTermination()
    got = {(r.last_seen.day, r.times_seen, r.status) for r in state.current_state(spark, out).collect()}
    assert got == {(5, 1, "fixed"), (2, 1, "open")}


def test_changes_are_few(spark):
    """A fingerprint that stays has one row for any number of scans."""
    from lintlake.operators import governance as G

    rows = [("p", 10 * k, "stays") for k in range(200)] + [("p", 10 * k, "comes and goes") for k in (3, 4, 9, 150)] + [("p", 0, None)]
    df = spark.createDataFrame(rows + rows[:5], "project_id string, scan_no int, fingerprint string")
    got = sorted((str(r.fingerprint), r.from_scan, r.to_scan, r.status, r.times_seen, r.last_seen or 0) for r in G.lifecycle_changes(df).collect())
    assert got == [
        ("None", 0, 0, "open", 1, 0), ("None", 10, 1990, "fixed", 1, 0),
        ("comes and goes", 30, 40, "open", 1, 0), ("comes and goes", 50, 80, "fixed", 2, 40), ("comes and goes", 90, 90, "reappeared", 3, 0),
        ("comes and goes", 100, 1490, "fixed", 3, 90), ("comes and goes", 1500, 1500, "reappeared", 4, 0), ("comes and goes", 1510, 1990, "fixed", 4, 1500),
        ("stays", 0, 1990, "open", 1, 0),
    ]
    assert G.replay_lifecycle(df).count() == 200 + 197 + 200

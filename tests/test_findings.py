"""Merging, correlation and the tables derived from findings."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintlake.functions import scalars as S
from lintlake.operators import correlate, dependencies, governance as G
from lintlake.operators.findings import deduplicate
from lintlake.plans.adapters import RULES
from lintlake.sources import state
from lintlake.sources.files import with_path_parts

SCHEMA = (
    "project_id string, engine_rank int, rule_rank int, rule_id string, title string, severity string, confidence string, cwe string, cve string,"
    " cvss string, file string, line int, evidence string, remediation string, status string"
)
ORDER = ["engine_rank", "file", "line", "rule_rank", "rule_id", "evidence"]
NOW = "2024-01-01 00:00:00"


def finding(rule="sql-injection", line=1, confidence="medium", file="a.py", evidence="x", severity="HIGH", project="p", title=None, cwe=None, engine=0):
    known = {r[0]: r for r in RULES}.get(rule, (rule, rule, "CWE-0"))
    return (project, engine, 0, rule, title or known[1], severity, confidence, cwe or known[2], None, "c", file, line, evidence, "fix", "open")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def now():
    return F.lit(NOW).cast("timestamp")


def greedy(rows):
    """Plain loop over findings in order."""
    families = [("command", "exec"), ("sql", "query"), ("xss", "html"), ("path", "traversal")]
    rank = {"high": 3, "medium": 2, "low": 1}

    def fams(r):
        t = f"{r[3]} {r[4]}".lower()
        return {i for i, f in enumerate(families) if any(x in t for x in f)}

    kept = {}
    for r in rows:
        key = (r[3], r[10], r[11], r[12])
        if key in kept:
            continue
        hit = next((k for k, o in kept.items() if o[10] == r[10] and o[7] == r[7] and abs(o[11] - r[11]) <= 1 and fams(o) & fams(r)), None)
        if hit is None:
            kept[key] = r
        elif rank.get(r[6], 0) > rank.get(kept[hit][6], 0):
            kept[hit] = r
    return list(kept.values())


def test_merge_equals_greedy_loop(spark):
    r = random.Random(7)
    rows = []
    for p in range(120):
        for _ in range(r.randint(1, 9)):
            rule = r.choice(["sql-injection", "java-sql-injection", "command-injection", "weak-crypto"])
            rows.append(finding(rule, r.randint(1, 6), r.choice(["high", "medium", "low", "HIGH"]), r.choice("ab"), r.choice("xy"), project=f"p{p}", engine=r.randint(0, 1)))
    key = lambda x: (x[1], x[10], x[11], x[2], x[3], x[12])
    expected = []
    for p in range(120):
        seen = {}
        for row in sorted((x for x in rows if x[0] == f"p{p}"), key=lambda x: (key(x), x[6])):
            seen.setdefault((key(row)), []).append(row)
        # rows that agree in the whole order and differ in confidence only have no defined order: leave one
        expected += greedy([v[0] for v in seen.values()])
    unique = {}
    for row in sorted(rows, key=lambda x: (x[0], key(x), x[6])):
        unique.setdefault((row[0], key(row)), row)
    got = deduplicate(frame(spark, list(unique.values())), ORDER).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(map(repr, expected))


def test_surer_finding_replaces(spark):
    rows = [finding("command-injection", 4, "medium"), finding("python-command-injection", 4, "high", engine=1)]
    assert [x.rule_id for x in deduplicate(frame(spark, rows), ORDER).collect()] == ["python-command-injection"]


def pairs_model(rows):
    """Groups and reasons by all pairs of one project."""
    import re

    src = re.compile(r"(?i)\b(request|input|query|param|upload|user|source)\b")
    snk = re.compile(r"(?i)\b(exec|command|sql|query|html|innerhtml|deserialize|path|file|sink)\b")
    cfg = re.compile(r"(?i)docker|compose|k8s|kubernetes|workflow|action|\.ya?ml|dockerfile")
    n, edges = len(rows), {}
    for i in range(n):
        for j in range(i + 1, n):
            a, b = rows[i], rows[j]
            if a[10] == b[10]:
                why = correlate.SHARED_FILE
            elif a[3].split("-")[0] == b[3].split("-")[0]:
                why = correlate.SHARED_FAMILY
            elif (src.search(a[12]) and snk.search(b[12])) or (src.search(b[12]) and snk.search(a[12])):
                why = correlate.SOURCE_SINK
            elif (cfg.search(a[10]) or cfg.search(b[10])) and a[12].strip() and b[12].strip():
                why = correlate.CONFIG_CODE
            else:
                continue
            edges[i, j] = why
    label = list(range(n))
    for _ in range(n):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i in range(n):
        groups.setdefault(label[i], []).append(i)
    return sorted(
        (len(m), "; ".join(sorted({w for (i, j), w in edges.items() if i in m and j in m}))) for m in groups.values() if len(m) > 1
    )


def test_correlation_equals_pairs(spark):
    r = random.Random(3)
    projects = {}
    for p in range(60):
        rows = []
        for k in range(r.randint(1, 6)):
            rows.append(finding(r.choice(["sql-a", "xss-b", "debug", "weak-x", "tls"]), k, "high", r.choice(["a.py", "b.py", "c.yml", "d.java"]), r.choice(["", " ", "request", "exec", "user file", "plain"]), project=f"p{p}", engine=k))
        projects[f"p{p}"] = rows
    got = correlate.correlate_findings(frame(spark, [x for v in projects.values() for x in v]), ORDER).collect()
    found = {}
    for g in got:
        found.setdefault(g.project_id, []).append((len(g.finding_references), g.rationale))
    assert {p: sorted(v) for p, v in found.items()} == {p: m for p, rows in projects.items() if (m := pairs_model(rows))}
    assert all("exploitability" in g.limitations[0] for g in got)


HISTORY = "project_id string, fingerprint string, rule_id string, file string, line int, title string, severity string, first_seen timestamp, last_seen timestamp, times_seen int, status string"


def test_lifecycle(spark):
    history = spark.createDataFrame([], HISTORY)
    seen = []
    for k, rows in enumerate([[finding()], [], [finding(line=9)]]):
        t = F.lit(f"2024-01-0{k + 1} 00:00:00").cast("timestamp")
        history = spark.createDataFrame(G.update_lifecycle(frame(spark, rows), history, t).collect(), HISTORY)
        seen.append([(r.status, r.times_seen, r.line) for r in history.collect()])
    assert seen == [[("open", 1, 1)], [("fixed", 1, 1)], [("reappeared", 2, 9)]]
    dropped = history.withColumn("status", F.lit("accepted-risk"))
    assert G.update_lifecycle(frame(spark, []), dropped, now()).count() == 0


def test_risk_and_dates(spark):
    row = spark.range(1).select(S.risk_score(F.lit("HIGH"), F.lit("MEDIUM")).alias("r"), S.risk_score(F.lit(None), F.lit("odd")).alias("o")).first()
    assert (row.r.score, row.r.priority, row.o.score, row.o.priority) == (5.25, "high", 0.0, "informational")
    with pytest.raises(Exception, match="due_date must use YYYY-MM-DD"):
        spark.range(1).select(S.parse_workflow_date(F.lit("2020-1-1"), "due_date")).collect()


ACTIONS = "project_id string, fingerprint string, state string, owner string, due_date date, decision string, rationale string, expires_at date, ts timestamp"
EMPTY = "project_id string, fingerprint string, state string, owner string, due_date date, decision string, rationale string, expires_at date, updated_at timestamp, created_at timestamp"


def test_workflow(spark):
    from datetime import date

    t = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [
        ("p", "f", "open", None, None, None, None, None, t[0]),
        ("p", "f", "accepted-risk", "o", date(2020, 1, 1), None, "why", date(2020, 1, 1), t[1]),
        ("p", "g", "accepted-risk", "o", None, None, None, date(2020, 1, 1), t[0]),
        ("p", "h", "odd", None, None, None, None, None, t[0]),
    ]
    done, bad = G.apply_finding_actions(spark.createDataFrame([], EMPTY), spark.createDataFrame(rows, ACTIONS))
    record = done.collect()
    assert [(r.fingerprint, r.state, r.created_at) for r in record] == [("f", "accepted-risk", t[0])]
    assert sorted(r.problem.split()[0] for r in bad.collect()) == ["rationale", "state"]
    today = F.lit("2024-01-01").cast("date")
    f = spark.createDataFrame([("p", "f", "HIGH", "HIGH"), ("p", "z", "LOW", "LOW")], "project_id string, fingerprint string, severity string, confidence string")
    got = {r.fingerprint: r.workflow for r in G.enrich_workflow(f, done, today).collect()}
    assert got["f"].overdue and got["f"].expired and got["f"].attention_required and not got["z"].attention_required
    g = G.governance_summary(done, f, today).first()
    assert (g.overdue, g.expired_accepted_risks, g.tracked, g.observed_findings) == (1, 1, 1, 2)


def test_policy(spark):
    rows = [finding(severity="HIGH", confidence="MEDIUM"), finding(severity="LOW", confidence="LOW", line=2)]
    policy = lambda s, c, ignored=None: spark.createDataFrame([("p", s, c, ignored)], "project_id string, max_severity string, minimum_confidence string, ignored_rule_ids array<string>")
    passed = lambda f, p: G.evaluate_policy(frame(spark, f), p)[1].first().passed
    assert passed(rows, policy("HIGH", "HIGH"))
    assert not passed([finding(severity="HIGH", confidence="HIGH")], policy("high", "MEDIUM"))
    assert passed([finding(severity="CRITICAL", confidence="HIGH")], policy("LOW", "LOW", ["sql-injection"]))
    with pytest.raises(Exception, match="max_severity must be one of"):
        G.normalize_policy(policy("NOPE", "LOW")).collect()


def test_remediation(spark):
    f = frame(spark, [finding(evidence='token = "super-secret-value"')]).withColumn("remediation", F.lit('token = "super-secret-value"'))
    plan = G.remediation_records(f, now())
    first = plan.first()
    assert "super-secret-value" not in str(first) and first.status == "proposed"
    named = plan.select("project_id", "fingerprint")
    approved = G.approve_remediation(plan, named, now())
    verified = G.verify_remediation(approved, frame(spark, []), now())
    again = G.verify_remediation(verified, f, now())
    assert [approved.first().status, verified.first().status, again.first().status] == ["approved", "verified", "reappeared"]
    assert [h.status for h in again.first().history] == ["proposed", "approved", "verified", "reappeared"]
    with pytest.raises(Exception, match="no such finding"):
        G.approve_remediation(plan, named.withColumn("fingerprint", F.lit("zz")), now()).collect()
    merged = G.merge_remediation(approved, plan, now()).first()
    assert merged.status == "approved"


def test_coverage_and_inventory(spark):
    rows = [("p", "safe.py", 5, ""), ("p", "notes.md", 5, ""), ("p", "Dockerfile", 5, ""), ("p", "deployment.yaml", 5, "kind: Deployment"), ("p", "build/x.py", 5, ""), ("p", "big.py", 3_000_000, "")]
    files = with_path_parts(spark.createDataFrame(rows, "project_id string, rel_path string, size long, content string"))
    counts, languages, skipped = G.scan_coverage(files)
    c = counts.first()
    assert (c.files_analyzed, c.files_skipped, c.files_ignored) == (3, 2, 1)
    assert {r.reason for r in skipped.collect()} == {"unsupported file type", "file exceeds 2 MB limit"}
    assert {r["class"] for r in G.inventory_assets(files).collect()} == {"source", "docker", "kubernetes", "configuration"}


def test_dependencies(spark):
    files = {
        "package-lock.json": '{"packages": {"": {"version": "1"}, "node_modules/demo": {"name": "demo", "version": "1.2.3"}}}',
        "package.json": "{broken", "Pipfile.lock": '{"default": {"requests": {"version": "==2.0"}}}',
        "pom.xml": '<project xmlns="u"><dependencies><dependency><groupId>org.demo</groupId><artifactId>demo</artifactId><version> 1 </version></dependency><dependency><groupId>a</groupId><artifactId>b</artifactId><version>${v}</version></dependency></dependencies></project>',
        "build.gradle": "implementation('g:n:3')", "poetry.lock": '[[package]]\nname = "po"\nversion = "4"\n', "requirements.txt": "a==1 ; x\nb\nc>=2\n", "sub/pom.xml": "<project/>",
    }
    df = with_path_parts(spark.createDataFrame([("p", k, 1, v) for k, v in files.items()], "project_id string, rel_path string, size long, content string"))
    deps = dependencies.dependencies(df)
    got = {(r.package, r.version, r.lockfile) for r in deps.collect()}
    assert got == {("demo", "1.2.3", True), ("requests", "2.0", True), ("org.demo:demo", "1", False), ("g:n", "3", False), ("po", "4", True), ("a", "1", False), ("c", "2", False)}
    adv = spark.createDataFrame([("demo", "1.2.3", "OSV-1", "", None, None), ("demo", "9", "OSV-2", "", None, None), ("a", "1", None, "", None, None)], "package string, version string, id string, summary string, severity string, cvss string")
    f = dependencies.dependency_findings(deps, adv).collect()
    assert [(r.cve, r.confidence, r.severity, r.title) for r in f] == [("OSV-1", "high", "HIGH", "Known vulnerability in demo")]


def test_registry(spark):
    s = spark.createDataFrame([("p", n, datetime(2024, 1, d)) for d, n in enumerate(["one", "two", "three"], 1)], "project_id string, scan_id string, scanned_at timestamp")
    kept = G.bounded_history(s, 2).collect()
    assert {(r.scan_id, r.last_scan) for r in kept} == {("two", False), ("three", True)}


def test_rule_evaluation(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y")], "case_id string, rule_id string")
    o = spark.createDataFrame([("a", "x"), ("b", "z")], "case_id string, rule_id string")
    got = {r.case_id: (r.matched, r.missing, r.unexpected, r.recall) for r in G.evaluate_rules(e, o).collect()}
    assert got == {"a": (["x"], ["y"], [], 0.5), "b": ([], [], ["z"], 1.0)}


def test_reports(spark, tmp_path):
    f = frame(spark, [finding(evidence="<b> & 'q'"), finding("weak-crypto", 2, severity="LOW", title="say \"x\"")])
    doc = json.loads(state.to_sarif(f, ORDER).first().document)
    run = doc["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "note"] and run["tool"]["driver"]["rules"][0]["helpUri"].endswith("/89.html")
    assert list(run["results"][0]["partialFingerprints"].values())[0] == list(run["results"][0]["fingerprints"].values())[0]
    assert "&lt;b&gt; &amp; &#x27;q&#x27;" in state.to_html(f, ORDER).first().document
    state.write_findings_csv(frame(spark, []), str(tmp_path / "csv"))
    assert "rule_id,title" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    state.write_findings_json(f, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_state(spark, tmp_path):
    assert state.read_state(spark, str(tmp_path / "none.json"), "history").count() == 0
    (tmp_path / "h.json").write_text('{"findings": {"f1": {"rule_id": "r", "line": 3, "status": "open"}}}')
    assert [(r.fingerprint, r.line) for r in state.read_state(spark, str(tmp_path / "h.json"), "history").collect()] == [("f1", 3)]
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception, match="cannot read history state"):
        state.read_state(spark, str(tmp_path / "bad.json"), "history").collect()
    for v in range(2):
        state.write_state(spark.createDataFrame([("p", v)], "project_id string, x int"), str(tmp_path / "t"), v)
    assert state.current_state(spark, str(tmp_path / "t")).first().x == 1
    (tmp_path / "adv.json").write_text('{"package":"a","version":"1","id":"I","severity":[{"score":"medium x"}],"affected":[{"ranges":[{"type":"S","events":[{"introduced":"0"}]}]}]}\n')
    a = state.read_advisories(spark, str(tmp_path / "adv.json")).first()
    assert (a.severity, a.cvss, a.affected[0].type) == ("MEDIUM", "advisory-provided", "S")


def test_audit(spark):
    rows = [(datetime(2024, 1, 1), "scan", {"Token": "t", "job": "1"}), (datetime(2024, 1, 1), "x", None)]
    got = state.audit_events(spark.createDataFrame(rows, "timestamp timestamp, event string, details map<string,string>")).collect()
    assert [r.details for r in got] == [{"job": "1"}, {}]

"""Queries over all findings against plain loops."""

import hashlib
from collections import Counter

import pytest

from lintlake.plans import adapters as A
from lintlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return A.sql(spark, SF, A.FINDINGS).collect()


def digest(*parts, sep, n):
    return hashlib.sha256(sep.join(parts).encode()).hexdigest()[:n]


def test_lifecycle_over_all_findings(spark, rows):
    fp = lambda r: (r.project_id, digest(r.rule_id, r.cwe, r.file, r.evidence, sep="\n", n=20))
    early = [r for r in rows if str(r.seen_at) < "1995-06-01"]
    late = [r for r in rows if str(r.seen_at) >= "1995-06-01"]
    old = {fp(r): {"a": "fixed", "b": "accepted-risk"}.get(fp(r)[1][0], "open") for r in early}
    new = {fp(r) for r in late}
    want = {}
    for k in old.keys() | new:
        if k in new:
            want[k] = ("reappeared" if old.get(k) == "fixed" else "open", 1 + (k in old))
        elif old[k] != "accepted-risk":
            want[k] = ("fixed", 1)
    got = QUERIES["j2_update_lifecycle_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.project_id, r.fingerprint): (r.status, r.times_seen) for r in got} == want
    counts = Counter((k[0], v[0]) for k, v in want.items())
    assert {(r.project_id, r.status): r.n for r in QUERIES["a7_lifecycle_counts_all"](spark, SF).collect()} == counts
    place = lambda r: (r.project_id, r.rule_id, r.file, r.line)
    got = QUERIES["j4_attach_fingerprint"](spark, SF).collect()
    assert Counter(map(place, got)) == Counter(map(place, late))
    assert sum(r.findings_count for r in QUERIES["a8_scan_summary"](spark, SF).collect()) == len(late)


def test_remediation_over_all_findings(spark, rows):
    fps = {(r.project_id, digest(r.rule_id, r.file, str(r.line), r.evidence, sep="|", n=16)) for r in rows}
    want = {k: "approved" if k[1][0] == "c" else "proposed" for k in fps}
    got = QUERIES["j10_approve_remediation_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.project_id, r.fingerprint): r.status for r in got} == want
    counts = Counter((k[0], v) for k, v in want.items())
    assert {(r.project_id, r.status): r.n for r in QUERIES["a6_remediation_summary_all"](spark, SF).collect()} == counts


def test_compose_keeps_plaintext_secrets(spark, monkeypatch):
    monkeypatch.setattr(A, "CODE_LINES", "SELECT 'p' AS project_id, 'compose.yml' AS rel_path, 1 AS line, 'API_TOKEN: k3yk3yk3y' AS text")
    assert [r.rule_id for r in QUERIES["d3_compose"](spark, SF).collect()] == ["compose-plaintext-secret"]

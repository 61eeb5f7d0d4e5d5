"""Run blocks by one order of a file's lines, and reports in compressed files."""

import random
import re

from lintlake.operators import detect
from lintlake.sources import state

TEXTS = ["run: |", "  run: x", "  echo", "", "   ", "# note", "name: y", "    deep", "\trun:", None]


def blocks(texts):
    """Line by line: null before any line that has a text, as nothing is known there."""
    told, key, inside = [], None, None
    for t in texts:
        if t is not None:
            s, indent = t.strip(), len(t) - len(t.lstrip())
            if re.match(r"run\s*:", s):
                key, inside = indent, True
            elif key is not None and s and not s.startswith("#") and indent <= key:
                inside = False
            inside = bool(inside)
        told.append(inside)
    return told


def test_blocks_are_those_of_a_loop_over_the_lines(spark):
    random.seed(5)
    files = {f"f{i}": random.choices(TEXTS, k=random.randint(1, 9)) for i in range(150)}
    lines = spark.createDataFrame([("p", f, k, t) for f, ts in files.items() for k, t in enumerate(ts, 1)], "project_id string, rel_path string, line int, text string")
    got = {(r.rel_path, r.line): r.in_run for r in detect.run_block_flag(lines).collect()}
    assert got == {(f, k): b for f, ts in files.items() for k, b in enumerate(blocks(ts), 1)}


def test_lines_are_sorted_once(spark):
    lines = spark.createDataFrame([("p", "f", 1, "run: x")], "project_id string, rel_path string, line int, text string")
    plan = detect.run_block_flag(lines).select("project_id", "rel_path", "line", "in_run")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_json_findings_are_compressed(spark, tmp_path):
    rows = spark.range(5000).selectExpr("'r' AS rule_id", "'t' AS title", "'LOW' AS severity", "'high' AS confidence", "'c' AS cwe", "null AS cve", "'x' AS cvss", "'f' AS file", "cast(id AS int) AS line", "'e' AS evidence", "'m' AS remediation", "'open' AS status")
    state.write_findings_json(rows, str(tmp_path / "out"))
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("part-*")]
    assert 0 < sum(sizes) < 5000 * 40
    assert spark.read.json(str(tmp_path / "out")).select("line").distinct().count() == 5000

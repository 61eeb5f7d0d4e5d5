"""Snippets with the rule ids that they must give."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import detect, flows
from lintlake.operators.scan import register_detector, run_detectors, scan
from lintlake.sources.files import config_kind, explode_lines, read_project_files, with_path_parts


def table(spark, files: dict[str, str]):
    rows = [("p", path, len(text), text) for path, text in files.items()]
    return with_path_parts(spark.createDataFrame(rows, "project_id string, rel_path string, size long, content string"))


def rules(df):
    return {r.rule_id for r in df.select("rule_id").collect()}


JAVA = 'class Store {\n  static final String password = "kettle-7-blue-moss";\n  void find(String town) { run("select id from shops where town = " + town); }\n}'


def test_secret_and_sql(spark):
    assert rules(scan(table(spark, {"unsafe.java": JAVA}))) == {"secret", "sql-injection"}


def test_safe_java(spark):
    assert rules(scan(table(spark, {"safe.java": "PreparedStatement statement = connection.prepareStatement(sql);"}))) == set()


@pytest.mark.parametrize(
    "files, expected",
    [
        ({"a.js": "const value = req.query.name;\nchild_process.exec(value);"}, {"js-command-injection"}),
        ({"a.js": 'child_process.execFile("whoami", []);'}, set()),
        ({"a.js": "function run(command) { exec(command); }\nrun(req.body.command);"}, {"js-command-injection"}),
        ({"runner.js": "export function run(command) { exec(command); }", "route.js": "import { run } from './runner.js';\nrun(req.body.command);"}, {"js-command-injection"}),
        ({"a.js": "el.innerHTML = DOMPurify.sanitize(req.body.comment);"}, set()),
        ({"a.js": "el.innerHTML = req.body.comment; // exec(req.body.x)"}, {"js-xss"}),
    ],
)
def test_javascript(spark, files, expected):
    assert rules(flows.scan_javascript(table(spark, files))) == expected


def test_python(spark):
    text = "import os, pickle\nfrom flask import request\nv = request.args['x']\nos.system(v)\npickle.loads(v)\n"
    assert rules(flows.scan_python_flows(table(spark, {"a.py": text}))) >= {"python-command-injection", "python-unsafe-deserialization"}
    bound = "value = request.args['x']\nconn.execute('select ?', (value,))\n"
    assert rules(flows.scan_python_flows(table(spark, {"b.py": bound, "broken.py": "def ("}))) == set()


def test_java(spark):
    text = 'public void a(@RequestParam String q) {\n  statement.executeQuery("select " + q);\n  Runtime.getRuntime().exec(q);\n  MessageDigest.getInstance("MD5");\n}'
    found = flows.scan_java_flows(table(spark, {"A.java": text})).collect()
    assert {r.rule_id for r in found} >= {"java-sql-injection", "java-command-injection", "java-weak-crypto"}
    assert {r.confidence for r in found} == {"high"}
    safe = 'String q = request.getParameter("q");\nString sql = "select 1";\nstatement.executeQuery(sql);\nPreparedStatement p = c.prepareStatement("x");\np.setString(1, q);'
    assert "java-sql-injection" not in rules(flows.scan_java_flows(table(spark, {"B.java": safe})))


def test_configuration(spark):
    files = {
        "Dockerfile": "FROM x\nENV API_TOKEN=abc123\nRUN curl https://e.invalid/i | sh\n",
        ".github/workflows/ci.yml": "on:\n  pull_request_target:\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - name: b\n        run: |\n          echo ${{ secrets.A }}\n",
    }
    assert rules(detect.scan_configuration(config_kind(table(spark, files)))) >= {
        "docker-pipe-to-shell", "docker-secret-in-build", "docker-user-missing", "github-action-unpinned", "github-target-checkout", "github-secrets-in-run",
    }
    safe = {"Dockerfile": "FROM x\nUSER app\n", "compose.yml": "services:\n  web:\n    image: x\n"}
    assert rules(detect.scan_configuration(config_kind(table(spark, safe)))) == set()
    assert rules(detect.scan_configuration(config_kind(table(spark, {"Dockerfile": ""})))) == {"docker-user-missing"}


def k8s_model(lines):
    """The state machine, line by line: lines at which a container without limits is reported."""
    found, inside, indent, limits, at = [], False, 0, False, 1
    for n, raw in enumerate(lines, 1):
        s, i = raw.strip(), len(raw) - len(raw.lstrip())
        if s.startswith("- name:") and indent and i == indent:
            if inside and not limits:
                found.append(at)
            inside, at, limits = True, n, False
        if s.startswith(("containers:", "initContainers:")):
            inside, indent = False, i + 2
        if s.startswith("limits:"):
            limits = True
    return found + ([at] if inside and not limits else [])


def test_kubernetes_windows(spark):
    import random

    r = random.Random(4)
    parts = ["containers:", "  - name: a", "    limits:", "  initContainers:", "    - name: b", "x: 1", "", "      limits: 2"]
    cases = {f"f{i}.yml": [r.choice(parts) for _ in range(r.randint(1, 14))] for i in range(300)}
    rows = [("p", f, n, t) for f, lines in cases.items() for n, t in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "project_id string, rel_path string, line int, text string")
    got = {}
    for row in detect.k8s_missing_limits(df).collect():
        got.setdefault(row.file, []).append(row.line)
    assert {f: sorted(v) for f, v in got.items()} == {f: m for f, lines in cases.items() if (m := sorted(k8s_model(lines)))}


def test_provider_token_and_placeholder(spark):
    lines = explode_lines(table(spark, {"a.env": "GITHUB_TOKEN=ghp_" + "1" * 24, "b.env": 'API_KEY="change-me"', "c.java": 'String t = System.getenv("TOKEN");'}))
    found = detect.scan_secrets(lines).collect()
    assert [r.rule_id for r in found] == ["github-token"]
    assert "[REDACTED]" in found[0].evidence and "ghp_" not in found[0].evidence


def test_secret_history(spark):
    rows = [("p", "c1", "a.py", 3, 'password = "hunter2secret"'), ("p", "c2", "a.py", 3, None)]
    found = detect.scan_secret_history(spark.createDataFrame(rows, "project_id string, commit string, path string, line int, text string")).collect()
    assert [(r["commit"], r.rule_id) for r in found] == [("c1", "secret")]


def test_headers(spark):
    df = spark.createDataFrame([({"X-Content-Type-Options": "nosniff", "REFERRER-POLICY": "x"},), (None,)], "headers map<string,string>")
    assert [len(r.missing) for r in detect.missing_security_headers(df).collect()] == [2, 4]


def test_lines(spark):
    texts = {"a": "x\ny\n", "b": "x\r\ny", "c": "", "d": "\n\n", "e": "a\x0bb\x0cc\x1cd e", "f": "x\r", "g": "x\n\r\ny"}
    rows = explode_lines(table(spark, texts)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.rel_path, []).append((r.line, r.text))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {k: v.splitlines() for k, v in texts.items() if v}


def test_read_files_and_registered_detector(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"DEBUG = True\n\xff\n")
    files = read_project_files(spark, [str(tmp_path)])
    assert [(r.rel_path, r.name, r.suffix) for r in files.collect()] == [("src/a.py", "a.py", ".py")]
    register_detector("own", lambda f: detect.scan_heuristics(explode_lines(f)).withColumn("engine_id", F.lit("own")))
    assert rules(run_detectors(files, ["own"])) == {"debug"}


def test_vulnerable_project(spark):
    app = (
        "import subprocess as sp\nfrom bottle import request\n\n\nclass Report:\n    def rows(self, db):\n        town = request.query_params.get(\"town\")\n"
        "        wanted = \"select * from visits where town = \" + town\n        for row in db.cursor().execute(wanted):\n            yield row\n\n"
        "    def convert(self):\n        name = request.form[\"file\"]\n        sp.call([\"convert\", name, \"out.png\"])\n"
    )
    docker = "FROM debian:12\nADD http://files.invalid/tool.tgz /opt/\nUSER 0\n"
    assert rules(scan(table(spark, {"app.py": app, "Dockerfile": docker}))) == {"python-command-injection", "python-sql-injection", "docker-user-root", "docker-add-remote"}


def test_python_taint_follows_order_and_helpers(spark):
    """What is constant, and what helpers receive, by hand."""
    text = (
        "from flask import request\ndef show(path, mode):\n    return open(path)\n"
        "a = request.args['q']\nb = f'{a}'\nshow(b, 'r')\nq = 'select ?'\ndb.execute(q, (a,))\nq = b\ndb.execute(q, (a,))\n"
    )
    found = flows.scan_python_flows(table(spark, {"a.py": text, "empty.py": ""})).collect()
    assert {(r.rule_id, r.line) for r in found} == {("python-path-traversal", 3), ("python-sql-injection", 10)}


def test_java_taint_ends_with_a_constant(spark):
    text = (
        'void a(@PathVariable String id) {\n  load(id);\n  id = "x";\n  String id = "x";\n  stmt.execute(id);\n}\n'
        "private void load(String name) {\n  Paths.get(name);\n}\n"
    )
    found = flows.scan_java_flows(table(spark, {"A.java": text})).collect()
    assert {(r.rule_id, r.line) for r in found} == {("java-path-traversal", 8)}

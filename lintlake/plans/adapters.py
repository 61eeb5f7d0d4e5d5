"""The given tables as inputs of the findings library.

The SELECTs are plain SQL that Spark and DuckDB read alike, so a query and its SQL form start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.sources.files import with_path_parts

#: Lines of code that the rows of lineitem stand for, by l_partkey.
SNIPPETS = [
    "total = price * 2",
    "rows = stmt.executeQuery(sql + name)",
    "os.system(command)",
    "panel.innerHTML = value",
    "with open(request.path) as f:",
    "digest = MD5(data)",
    "verify = false",
    "DEBUG = True",
    "USER root",
    "ADD https://example.com/a.tgz /opt",
    "RUN curl https://example.com/i.sh | bash",
    "ENV API_TOKEN=abc123def",
    "privileged: true",
    "hostNetwork: true",
    "- uses: actions/checkout@v4",
    "  ENV DB_PASSWORD=change-me",
    "key = a1b2c3",
    "network_mode: host",
    "- /var/run/docker.sock:/var/run/docker.sock",
    "type: LoadBalancer",
    "pull_request_target:",
]

_KEY = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SNIPPETS))

CODE_LINES = f"""
SELECT concat('p', CAST(l_orderkey % 20 AS STRING)) AS project_id,
       concat('src/f', CAST(l_orderkey AS STRING), CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.yml' ELSE '.rb' END) AS rel_path,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS INT) AS line,
       CASE l_partkey % {len(SNIPPETS)} {_CASE} END AS text
FROM lineitem
"""

#: Manifest lines: containers, run blocks and what is in them, for the ordered checks.
YAML = ["containers:", "  - name: web", "    limits:", "    privileged: true", "initContainers:", "run: |", "  echo ${{ secrets.A }}", "steps:", "# note", "  hostPath: /etc"]
_YAML_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(YAML))
YAML_LINES = f"""
SELECT concat('p', CAST(l_orderkey % 20 AS STRING)) AS project_id, concat('k8s/f', CAST(l_orderkey AS STRING), '.yml') AS rel_path,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS INT) AS line,
       CASE l_partkey % {len(YAML)} {_YAML_CASE} END AS text
FROM lineitem
"""

#: Manifest lines of which every rule of compose files, manifests and workflows finds some.
CONFIG = [
    "containers:", "  - name: web", "    limits:", "    privileged: true", "hostNetwork: true", "hostPID: true", "  hostPath: /etc", "type: LoadBalancer", "initContainers:",
    "privileged: true", "network_mode: host", '  - "/var/run/docker.sock:/s"', "API_TOKEN: k3yk3yk3y", "DB_PASSWORD: your-own-value", "SECRET: change-me", "pull_request_target:",
    "  - uses: actions/checkout@v4", "  - uses: a/b@0123456789abcdef0123456789abcdef01234567", "run: |", "  echo ${{ secrets.A }}", "steps:", "# note", "hostNetwork: false",
]
_CONFIG_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(CONFIG))
CONFIG_LINES = f"""
SELECT concat('p', CAST(l_orderkey % 20 AS STRING)) AS project_id, concat('deploy/f', CAST(l_orderkey AS STRING), '.yml') AS rel_path,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS INT) AS line,
       CASE l_partkey % {len(CONFIG)} {_CONFIG_CASE} END AS text
FROM lineitem
"""

#: Lines with tokens of each provider's format, built from digests of the rows; some too short, some spelled in other ways.
_TOKENS = [
    "concat('auth ghp_', substr(d, 1, n))", "concat('use ', substr('AKIA', 1, 3 + n % 2), upper(substr(d, 1, 16)), ' here')", "concat('hook xoxb-', substr(d, 1, n - 8))",
    "concat('maps AIza', d, substr(d, 1, n % 5))", "concat('pay sk_live_', substr(d, 1, n - 3))", "concat('-----BEGIN ', CASE n % 3 WHEN 0 THEN 'RSA ' WHEN 1 THEN '' ELSE 'rsa ' END, 'PRIVATE KEY-----')",
    "concat('Bearer eyJ', substr(d, 1, 12), '.eyJ', substr(d, 1, 12), '.', substr(d, 1, n - 12))", "concat('password = \"', substr(d, 1, n - 14), '\"')",
    "concat('api_key: \"ghp_', substr(d, 1, n), '\"')", "concat('token=\"', repeat(substr(d, 1, 1), n), '\"')", "'secret = \"change-me-please\"'", "concat('plain words ', d)",
    "concat('sk_live_', d, ' and xoxp-', substr(d, 1, 12))", "concat('tokens ', d)",
]
_TOKEN_CASE = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TOKENS))
SECRET_LINES = f"""
SELECT project_id, rel_path, line, CASE k {_TOKEN_CASE} END AS text FROM (
SELECT concat('p', CAST(l_suppkey % 20 AS STRING)) AS project_id, concat('conf/f', CAST(l_orderkey AS STRING), '.txt') AS rel_path,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS INT) AS line, l_partkey % {len(_TOKENS)} AS k,
       CAST(16 + l_linenumber + l_suppkey % 5 AS INT) AS n, md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING))) AS d
FROM lineitem)
"""

#: The rows of SECRET_LINES: lines are numbered first, so that texts and names are not dealt and sorted with them.
_NUMBER = f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS INT) AS line"
NUMBERED_SECRET_LINES = SECRET_LINES.replace(_NUMBER, "line").replace("FROM lineitem", f"FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_NUMBER} FROM lineitem)")

#: Statements of programs with flows from input to a sink.
STATEMENTS = {
    ".py": ["import os, pickle, hashlib", 'v = request.args["q"]', "os.system(v)", "v = 1", "conn.execute(v)", "pickle.loads(v)", "hashlib.md5(v)", "open(v)", 'conn.execute("select ?", (v,))'],
    ".java": ['String q = request.getParameter("q");', "statement.executeQuery(q);", "Runtime.getRuntime().exec(q);", 'String q = "x";', 'MessageDigest.getInstance("MD5");', "new FileInputStream(q);", "int n = 5;"],
}


def program_lines(suffix: str) -> str:
    lines = STATEMENTS[suffix]
    case = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(lines))
    return f"""
    SELECT concat('p', CAST(l_orderkey % 20 AS STRING)) AS project_id, concat('src/f', CAST(l_orderkey AS STRING), '{suffix}') AS rel_path,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS INT) AS line, CASE l_partkey % {len(lines)} {case} END AS text
    FROM lineitem
    """


#: Rules that the rows of lineitem stand for as findings: id, title, CWE.
RULES = [
    ("sql-injection", "Potential SQL injection", "CWE-89"),
    ("java-sql-injection", "Tainted request input reaches a JDBC query", "CWE-89"),
    ("command-injection", "Potential command injection", "CWE-78"),
    ("python-command-injection", "Tainted input reaches command execution", "CWE-78"),
    ("weak-crypto", "Weak cryptography", "CWE-327"),
    ("debug", "Debug mode enabled", "CWE-489"),
    ("docker-user-root", "Dockerfile runs as root", "CWE-250"),
]


def _rule(field: int) -> str:
    return "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{r[field]}'" for i, r in enumerate(RULES)) + " END"


FINDINGS = f"""
SELECT concat('p', CAST(l_suppkey % 50 AS STRING)) AS project_id, CAST(l_partkey % 3 AS INT) AS engine_rank, CAST(l_partkey % 7 AS INT) AS rule_rank,
       {_rule(0)} AS rule_id, {_rule(1)} AS title,
       CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'HIGH' ELSE 'medium' END AS severity,
       CASE l_linestatus WHEN 'O' THEN 'high' ELSE 'medium' END AS confidence,
       {_rule(2)} AS cwe, CAST(NULL AS STRING) AS cve, 'context-dependent' AS cvss,
       concat('src/f', CAST(l_orderkey AS STRING), '.py') AS file, CAST(l_linenumber AS INT) AS line,
       concat('value ', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 5 = 0 THEN ' token = "abc" request' WHEN l_partkey % 5 = 1 THEN ' exec' ELSE '' END) AS evidence,
       'Fix it, then rotate token=abc' AS remediation, 'open' AS status,
       CAST(l_shipdate AS TIMESTAMP) AS seen_at
FROM lineitem
"""

#: Findings that come back: a month is a scan, and few places hold them.
SCANNED = f"""
SELECT project_id, engine_rank, rule_rank, rule_id, title, severity, cwe, concat('src/f', CAST(line AS STRING), '.py') AS file, line,
       concat('value ', substr(evidence, 7, 1)) AS evidence, CAST(date_trunc('MONTH', seen_at) AS TIMESTAMP) AS scanned_at
FROM ({FINDINGS})
"""

#: A scan of a project is a month.
SCANS = """
SELECT concat('p', CAST(l_suppkey % 50 AS STRING)) AS project_id,
       CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS scan_no,
       concat('fp', CAST(l_partkey % 200 AS STRING)) AS fingerprint
FROM lineitem
"""

#: Finding actions from the event stream.
ACTIONS = """
SELECT concat('p', CAST(user_id % 10 AS STRING)) AS project_id, concat('fp', CAST(user_id AS STRING)) AS fingerprint,
       CASE event_id % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'accepted-risk' WHEN 3 THEN 'false-positive'
            WHEN 4 THEN 'resolved' WHEN 5 THEN 'unheard-of' ELSE 'open' END AS state,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('o', CAST(event_id % 11 AS STRING)) END AS owner,
       CAST(CASE WHEN event_id % 2 = 0 THEN '2020-01-01' ELSE '2999-01-01' END AS DATE) AS due_date,
       CAST(NULL AS STRING) AS decision,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'reviewed' END AS rationale,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CASE WHEN event_id % 3 = 0 THEN '2020-06-01' ELSE '2999-06-01' END AS DATE) END AS expires_at,
       CAST(ts AS TIMESTAMP) AS ts, event_id
FROM events
"""

PACKAGES = """
SELECT concat('p', CAST(s.s_suppkey % 50 AS STRING)) AS project_id, p.p_name AS package, CAST(p.p_size AS STRING) AS version,
       concat('m', CAST(s.s_suppkey % 3 AS STRING), '/package.json') AS source, 'npm' AS ecosystem, false AS lockfile
FROM part p JOIN supplier s ON p.p_partkey % 100 = s.s_suppkey % 100
"""

#: The different rows of PACKAGES: what parts and suppliers show of themselves is made different before they meet, as the
#: pairs of rows would grow with the product of both tables.
DIFFERENT_PACKAGES = """
SELECT DISTINCT s.project_id, p.package, p.version, s.source, 'npm' AS ecosystem, false AS lockfile
FROM (SELECT DISTINCT p_partkey % 100 AS k, p_name AS package, CAST(p_size AS STRING) AS version FROM part) p
JOIN (SELECT DISTINCT s_suppkey % 100 AS k, concat('p', CAST(s_suppkey % 50 AS STRING)) AS project_id, concat('m', CAST(s_suppkey % 3 AS STRING), '/package.json') AS source FROM supplier) s ON p.k = s.k
"""

ADVISORIES = """
SELECT p_name AS package, CAST(p_size AS STRING) AS version, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('OSV-', CAST(p_partkey AS STRING)) END AS id,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('Issue in ', p_brand) END AS summary,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'LOW' END AS severity, CAST(NULL AS STRING) AS cvss
FROM part WHERE p_partkey % 2 = 0
"""

#: Documents and pages as files.
FILES = """
SELECT source AS project_id,
       concat(CASE doc_id % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' WHEN 2 THEN '.github/workflows/' WHEN 3 THEN 'k8s/' ELSE '' END,
              CASE doc_id % 8 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN '.env' WHEN 2 THEN concat('a', CAST(doc_id AS STRING), '.PY') WHEN 3 THEN concat('b', CAST(doc_id AS STRING), '.tar.gz')
                   WHEN 4 THEN concat('c', CAST(doc_id AS STRING), '.yml') WHEN 5 THEN concat('compose.', CAST(doc_id AS STRING), '.yaml')
                   WHEN 6 THEN concat('d', CAST(doc_id AS STRING)) ELSE concat('e', CAST(doc_id AS STRING), '.java') END) AS rel_path,
       n_chars * 100 AS size, text AS content, doc_id
FROM documents
"""


_TABLE = re.compile(r"\b(?:FROM|JOIN) (lineitem|events|part|supplier|documents|pages|orders|labels|conversations)\b")


def sql(spark: SparkSession, sf_dir: str, query: str, stream: bool = False) -> DataFrame:
    """Run one of the SELECTs over the tables that it names, read as they are or as a stream of their files."""
    tables = {}
    for name in {m[1] for m in _TABLE.finditer(query)}:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        tables[name] = spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if stream else table
    plain = query.replace("{", "{{").replace("}", "}}")
    return spark.sql(_TABLE.sub(lambda m: m[0].replace(m[1], "{" + m[1] + "}"), plain), **tables)


def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_path_parts(sql(spark, sf_dir, FILES))


def code_files(spark: SparkSession, sf_dir: str, select: str = CODE_LINES) -> DataFrame:
    """Files put together from code lines; a file is one order's lines.

    The order is a key of its own, as lines are numbered by order: what is dealt by order need not be dealt again.
    """
    lines = sql(spark, sf_dir, select.replace("SELECT ", "SELECT l_orderkey, ", 1))
    files = lines.groupBy("l_orderkey", "project_id", "rel_path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content")
    )
    return with_path_parts(files.drop("l_orderkey").withColumn("size", F.octet_length("content").cast("long")))

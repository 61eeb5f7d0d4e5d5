"""Queries of the findings library over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions import scalars as S
from lintlake.operators import correlate, dependencies, detect, flows, governance as G
from lintlake.operators.findings import deduplicate
from lintlake.operators.scan import ORDER, run_detectors
from lintlake.plans import adapters as A
from lintlake.sources import files as FS
from lintlake.plans.lineage import scratch_path, written
from lintlake.sources import state
from lintlake.sources.buckets import read_buckets
from lintlake.streaming import jobs

TODAY = "2024-01-01"


def _now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _today():
    return F.lit(TODAY).cast("date")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _re(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


F_COLS = ["project_id", "engine_rank", "rule_rank", "rule_id", "title", "severity", "confidence", "cwe", "cve", "cvss", "file", "line", "evidence", "remediation", "status"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sql(spark, sf_dir, A.FINDINGS)


# -- merging, said in SQL ---------------------------------------------------------------------------------------

_MASK = """CAST((CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'command|exec') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'sql|query') THEN 2 ELSE 0 END)
 + (CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'xss|html') THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'path|traversal') THEN 8 ELSE 0 END) AS INTEGER)"""


#: The greedy loop, one finding of each (project, file, cwe) a step; ``kept`` is what stands, in order.
def _standing(source: str) -> str:
    return f"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT *, {_MASK} AS mask, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sure FROM ({source})
), a AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY project_id, file, cwe ORDER BY {', '.join(ORDER)}, sure) AS i FROM m WHERE mask <> 0
), fold(project_id, file, cwe, i, kept) AS (
  SELECT project_id, file, cwe, 0::BIGINT, [{{'k': '', 'mask': 0, 'line': 0, 'sure': 0, 'i': 0::BIGINT}}][2:] FROM (SELECT DISTINCT project_id, file, cwe FROM a)
  UNION ALL
  SELECT f.project_id, f.file, f.cwe, x.i,
    CASE WHEN len(list_filter(f.kept, lambda y: y.k = concat(x.rule_id, '|', x.line, '|', x.evidence))) > 0 THEN f.kept
         WHEN len(list_filter(f.kept, lambda y: y.mask & x.mask <> 0 AND abs(y.line - x.line) <= 1)) = 0
           THEN list_append(f.kept, {{'k': concat(x.rule_id, '|', x.line, '|', x.evidence), 'mask': x.mask, 'line': x.line, 'sure': x.sure, 'i': x.i}})
         ELSE list_transform(f.kept, lambda y, n: CASE WHEN y.sure < x.sure AND n = list_position(list_transform(f.kept, lambda z: z.mask & x.mask <> 0 AND abs(z.line - x.line) <= 1), true)
           THEN {{'k': y.k, 'mask': x.mask, 'line': x.line, 'sure': x.sure, 'i': x.i}} ELSE y END) END
  FROM fold f JOIN a x ON x.project_id = f.project_id AND x.file = f.file AND x.cwe = f.cwe AND x.i = f.i + 1
), last AS (
  SELECT project_id, file, cwe, unnest(arg_max(kept, i)) AS y FROM fold GROUP BY 1, 2, 3
), standing AS (
  SELECT a.project_id, a.rule_id, a.severity, a.file, a.line, a.confidence, a.evidence FROM last l JOIN a ON a.project_id = l.project_id AND a.file = l.file AND a.cwe = l.cwe AND a.i = l.y.i
  UNION ALL
  SELECT project_id, rule_id, arg_min(severity, first), file, line, arg_min(confidence, first), evidence
  FROM (SELECT *, [CAST(engine_rank AS INT), CAST(rule_rank AS INT)] AS first FROM m WHERE mask = 0) GROUP BY project_id, rule_id, file, line, evidence
)
"""


# -- flagship: lines -> rules -> merge -> gate -------------------------------------------------------------------


_LINE_FINDINGS = " UNION ALL ".join(
    f"SELECT project_id, rel_path AS file, line, 0 AS engine_rank, {i} AS rule_rank, '{r[0]}' AS rule_id, '{r[1]}' AS title, '{r[2]}' AS severity, '{r[3]}' AS cwe, 'medium' AS confidence, left(trim(text), 300) AS evidence"
    f" FROM ({A.CODE_LINES}) WHERE regexp_matches(text, {_re(r[4])})"
    for i, r in enumerate(K.LINE_RULES)
)
_POINTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.SEVERITY_POINTS.items())
_GATE = _standing(_LINE_FINDINGS) + f"""
SELECT p.project_id, coalesce(blocked, 0) = 0 AS passed, coalesce(blocked, 0)::BIGINT AS n_blocked, n_findings, total_score FROM (SELECT DISTINCT project_id FROM ({A.CODE_LINES})) p LEFT JOIN (
  SELECT project_id, count_if(severity IN ('CRITICAL', 'HIGH') AND rule_id <> 'debug') AS blocked, count(*) AS n_findings,
    round(sum(CASE severity {_POINTS} ELSE 0 END * {K.CONFIDENCE_WEIGHTS['MEDIUM']}::DOUBLE), 2) AS total_score FROM standing GROUP BY 1) USING (project_id)
"""


@query("scan_gate", _GATE)
def scan_gate(spark, sf_dir):
    """Lines of code to findings, merged, scored and gated: one verdict for each project."""
    lines = A.sql(spark, sf_dir, A.CODE_LINES)
    # the rules are held against the lines once, and what is merged is counted twice
    every = written(detect.scan_heuristics(lines), "line-findings")
    found = written(deduplicate(every, ORDER).select("project_id", "rule_id", "severity", "confidence"), "scan-findings")
    scored = found.withColumn("risk", S.risk_score(F.col("severity"), F.col("confidence")))
    policies = lines.select("project_id").distinct().select(
        "project_id", F.lit("high").alias("max_severity"), F.lit("MEDIUM").alias("minimum_confidence"), F.array(F.lit("debug")).alias("ignored_rule_ids")
    )
    verdict = G.evaluate_policy(found, policies)[1]
    risk = scored.groupBy("project_id").agg(F.count("*").alias("n_findings"), F.round(F.sum("risk.score"), 2).alias("total_score"))
    return verdict.join(risk, "project_id", "left")


# -- projections, files, lines -----------------------------------------------------------------------------------

_PARTS = f"""SELECT doc_id, rel_path, regexp_extract(rel_path, '[^/]*$') AS name,
 lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS suffix, string_split(rel_path, '/') AS parts, size, content, project_id
 FROM ({A.FILES}) f"""


@query("p1_path_parts", f"SELECT doc_id, name, suffix FROM ({_PARTS})")
def p1(spark, sf_dir):
    return A.files_table(spark, sf_dir).select("doc_id", "name", "suffix")


_IGNORED = "(" + ", ".join(f"'{d}'" for d in K.IGNORED_DIRECTORIES) + ")"
_SUFFIXES = "(" + ", ".join(f"'{d}'" for d in K.SCAN_SUFFIXES) + ")"


@query("p2_eligible_files", f"SELECT project_id, doc_id FROM ({_PARTS}) WHERE len(list_filter(parts, lambda x: x IN {_IGNORED})) = 0 AND size <= {K.MAX_BYTES} AND suffix IN {_SUFFIXES}")
def p2(spark, sf_dir):
    return FS.eligible_files(A.files_table(spark, sf_dir), K.SCAN_SUFFIXES).select("project_id", "doc_id")


@query("p3_explode_lines", """
SELECT doc_id, CAST(i AS INTEGER) AS line, parts[i] AS text FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, string_split(replace(CASE WHEN right(replace(text, chr(13) || chr(10), chr(10)), 1) = chr(10) THEN left(replace(text, chr(13) || chr(10), chr(10)), length(replace(text, chr(13) || chr(10), chr(10))) - 1) ELSE replace(text, chr(13) || chr(10), chr(10)) END, chr(13), chr(10)), chr(10)) AS parts
    FROM documents WHERE coalesce(text, '') <> ''))""")
def p3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return FS.explode_lines(docs, "doc_id")


@query("p4_config_kind", f"""SELECT doc_id, CASE WHEN lower(name) = 'dockerfile' OR starts_with(lower(name), 'dockerfile.') THEN 'dockerfile'
 WHEN starts_with(lower(name), 'docker-compose') OR starts_with(lower(name), 'compose') THEN 'compose'
 WHEN list_contains(parts, '.github') AND list_contains(parts, 'workflows') THEN 'actions'
 WHEN regexp_matches(content, {_re(K.KUBERNETES_KIND)}) THEN 'kubernetes' END AS config_kind FROM ({_PARTS})""")
def p4(spark, sf_dir):
    return FS.config_kind(A.files_table(spark, sf_dir)).select("doc_id", "config_kind")


_POLICY_SQL = "SELECT concat('p', CAST(i AS VARCHAR)) AS project_id, CASE WHEN i % 2 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS max_severity, CASE WHEN i % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS minimum_confidence, CASE WHEN i % 4 = 0 THEN ['debug'] ELSE [] END AS ignored FROM range(0, 50) t(i)"


def _policies(found: DataFrame) -> DataFrame:
    i = F.substring("project_id", 2, 9).cast("int")
    return found.select("project_id").distinct().select(
        "project_id",
        F.when(i % 2 == 0, "high").otherwise("CRITICAL").alias("max_severity"),
        F.when(i % 3 == 0, "High").otherwise("low").alias("minimum_confidence"),
        F.when(i % 4 == 0, F.array(F.lit("debug"), F.lit("debug"))).alias("ignored_rule_ids"),
    )


_BLOCKED = f"""SELECT f.*, q.max_severity, q.minimum_confidence FROM ({A.FINDINGS}) f JOIN ({_POLICY_SQL}) q ON f.project_id = q.project_id
 WHERE NOT list_contains(q.ignored, f.rule_id)
 AND list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], upper(f.severity)) <= list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], q.max_severity)
 AND list_position(['HIGH','MEDIUM','LOW'], upper(f.confidence)) <= list_position(['HIGH','MEDIUM','LOW'], q.minimum_confidence)"""


@query("p5_policy_blocked", f"""SELECT project_id, rule_id, file, line, evidence, concat(rule_id, ' (', upper(severity), ', ', upper(confidence), ' confidence) meets the ', max_severity, ' severity and ', minimum_confidence, ' confidence gate') AS reason FROM ({_BLOCKED})""")
def p5(spark, sf_dir):
    f = findings(spark, sf_dir)
    return G.evaluate_policy(f, _policies(f))[0].select("project_id", "rule_id", "file", "line", "evidence", "reason")


@query("p5b_policy_verdicts", f"""SELECT p.project_id, coalesce(n, 0) = 0 AS passed, CAST(coalesce(n, 0) AS BIGINT) AS n_blocked
 FROM (SELECT DISTINCT project_id FROM ({A.FINDINGS})) p LEFT JOIN (SELECT project_id, count(*) AS n FROM ({_BLOCKED}) GROUP BY 1) b USING (project_id)""")
def p5b(spark, sf_dir):
    f = findings(spark, sf_dir)
    return G.evaluate_policy(f, _policies(f))[1]


@query("p6_normalize_policy", f"SELECT project_id, max_severity, minimum_confidence, ignored AS ignored_rule_ids FROM ({_POLICY_SQL}) WHERE project_id IN (SELECT project_id FROM ({A.FINDINGS}))")
def p6(spark, sf_dir):
    return G.normalize_policy(_policies(findings(spark, sf_dir)))


@query("p7_placeholder_filter", f"SELECT project_id, rel_path, line, regexp_matches(trim(string_split(text, '=')[2], '\"'''), {_re(K.PLACEHOLDER)}) AS placeholder FROM ({A.CODE_LINES}) WHERE contains(text, '=')")
def p7(spark, sf_dir):
    lines = A.sql(spark, sf_dir, A.CODE_LINES).where(F.col("text").contains("="))
    return lines.select("project_id", "rel_path", "line", S.is_placeholder(F.split("text", "=")[1]).alias("placeholder"))


# -- detectors ---------------------------------------------------------------------------------------------------

_D1 = " UNION ALL ".join(
    f"SELECT project_id, rel_path AS file, line, '{r[0]}' AS rule_id, '{r[2]}' AS severity, left(trim(text), 300) AS evidence FROM ({A.CODE_LINES}) WHERE regexp_matches(text, {_re(r[4])})"
    for r in K.LINE_RULES
)
_OUT = ["project_id", "file", "line", "rule_id", "severity", "evidence"]


@query("d1_heuristics", _D1)
def d1(spark, sf_dir):
    return detect.scan_heuristics(A.sql(spark, sf_dir, A.CODE_LINES)).select(*_OUT)


def _config_sql(tests: list[tuple[str, str]]) -> str:
    severity = {r[0]: r[2] for r in K.CONFIG_RULES}
    return " UNION ALL ".join(
        f"SELECT project_id, rel_path AS file, line, '{rule}' AS rule_id, '{severity[rule]}' AS severity, trim(text) AS evidence FROM l WHERE {test}" for rule, test in tests
    )


@query("d2_dockerfile", f"WITH l AS ({A.CODE_LINES}) " + _config_sql([
    ("docker-user-root", "upper(string_split(trim(text), ' ')[1]) = 'USER' AND lower(trim(substr(trim(text), 6))) IN ('root', '0')"),
    ("docker-add-remote", "upper(string_split(trim(text), ' ')[1]) = 'ADD' AND regexp_matches(text, '(?i)\\bhttps?://')"),
    ("docker-pipe-to-shell", "upper(string_split(trim(text), ' ')[1]) IN ('RUN', 'CMD', 'ENTRYPOINT') AND regexp_matches(text, '(?i)\\b(?:curl|wget)\\b[^|]*\\|\\s*(?:sh|bash|zsh|ash)\\b')"),
    ("docker-secret-in-build", f"upper(string_split(trim(text), ' ')[1]) IN ('ENV', 'ARG') AND regexp_matches(text, {_re(K.SECRET_NAME)}) AND NOT regexp_matches(string_split(text, '=')[2], {_re(K.PLACEHOLDER)})"),
]))
def d2(spark, sf_dir):
    return detect.scan_dockerfile(A.sql(spark, sf_dir, A.CODE_LINES)).select(*_OUT)


@query("d2b_dockerfile_missing_user", f"SELECT project_id, rel_path AS file, 1 AS line, 'docker-user-missing' AS rule_id FROM ({A.CODE_LINES}) GROUP BY 1, 2 HAVING NOT bool_or(upper(string_split(trim(text), ' ')[1]) = 'USER')")
def d2b(spark, sf_dir):
    return detect.dockerfile_missing_user(A.sql(spark, sf_dir, A.CODE_LINES)).select("project_id", "file", "line", "rule_id")


@query("d3_compose", f"WITH l AS ({A.CODE_LINES}) " + _config_sql([
    ("compose-privileged", "regexp_matches(trim(text), '(?i)^privileged\\s*:\\s*true\\b')"),
    ("compose-host-network", "regexp_matches(trim(text), '(?i)^network_mode\\s*:\\s*host\\s*$')"),
    ("compose-docker-socket", "contains(lower(text), 'docker.sock')"),
]))
def d3(spark, sf_dir):
    return detect.scan_compose(A.sql(spark, sf_dir, A.CODE_LINES)).select(*_OUT)


_V1 = f"""
WITH l AS (SELECT *, length(text) - length(ltrim(text)) AS indent, regexp_matches(trim(text), '(?i)^(?:initC|c)ontainers\\s*:') AS head FROM ({A.YAML_LINES})),
a AS (SELECT *, last_value(CASE WHEN head THEN indent + 2 END IGNORE NULLS) OVER (PARTITION BY project_id, rel_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM l),
b AS (SELECT *, regexp_matches(trim(text), '^-\\s+name\\s*:') AND coalesce(indent = expected, false) AS opens FROM a),
c AS (SELECT *, sum(CAST(opens AS INT)) OVER w AS segment,
      coalesce(last_value(CASE WHEN head THEN 'head' WHEN opens THEN 'open' END IGNORE NULLS) OVER w = 'open', false) AS inside
      FROM b WINDOW w AS (PARTITION BY project_id, rel_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("v1_k8s_segments", _V1 + "SELECT project_id, rel_path, line, CAST(segment AS BIGINT) AS segment, inside FROM c")
def v1(spark, sf_dir):
    return detect.k8s_segments(A.sql(spark, sf_dir, A.YAML_LINES)).select("project_id", "rel_path", "line", "segment", "inside")


@query("d4_kubernetes", _V1 + ", l2 AS (SELECT * FROM c) " + _config_sql([
    ("k8s-privileged-container", "inside AND regexp_matches(trim(text), '(?i)^privileged\\s*:\\s*true\\b')"),
    ("k8s-hostpath", "regexp_matches(trim(text), '(?i)^-?\\s*hostPath\\s*:')"),
]).replace("FROM l WHERE", "FROM l2 WHERE"))
def d4(spark, sf_dir):
    return detect.scan_kubernetes(A.sql(spark, sf_dir, A.YAML_LINES)).select(*_OUT)


@query("d4b_k8s_missing_limits", _V1 + """SELECT project_id, rel_path AS file, CAST(min(line) AS INTEGER) AS line FROM c WHERE segment > 0 GROUP BY project_id, rel_path, segment
 HAVING NOT bool_or(regexp_matches(trim(text), '(?i)^limits\\s*:')) AND NOT bool_or(head)""")
def d4b(spark, sf_dir):
    return detect.k8s_missing_limits(A.sql(spark, sf_dir, A.YAML_LINES)).select("project_id", "file", "line")


_V2 = f"""
WITH l AS (SELECT *, length(text) - length(ltrim(text)) AS indent, regexp_matches(trim(text), '(?i)^run\\s*:') AS run FROM ({A.YAML_LINES})),
a AS (SELECT *, sum(CAST(run AS INT)) OVER (PARTITION BY project_id, rel_path ORDER BY line) AS block FROM l),
b AS (SELECT *, first_value(CASE WHEN run THEN indent END IGNORE NULLS) OVER (PARTITION BY project_id, rel_path, block ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ki FROM a),
c AS (SELECT *, max(CASE WHEN NOT run AND trim(text) <> '' AND NOT starts_with(trim(text), '#') AND indent <= ki THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, rel_path, block ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM b)
"""


@query("v2_run_blocks", _V2 + "SELECT project_id, rel_path, line, block > 0 AND ended = 0 AS in_run FROM c")
def v2(spark, sf_dir):
    return detect.run_block_flag(A.sql(spark, sf_dir, A.YAML_LINES)).select("project_id", "rel_path", "line", "in_run")


@query("d4c_actions", _V2 + """SELECT project_id, rel_path AS file, line, 'github-secrets-in-run' AS rule_id FROM c
 WHERE (regexp_matches(trim(text), '(?i)\\brun\\s*:') OR (block > 0 AND ended = 0)) AND regexp_matches(text, '\\$\\{\\{\\s*secrets\\.')""")
def d4c(spark, sf_dir):
    return detect.scan_actions(A.sql(spark, sf_dir, A.YAML_LINES)).select("project_id", "file", "line", "rule_id")


# -- manifests in which every rule finds something -----------------------------------------------------------------

_V1_ALL, _V2_ALL = _V1.replace(A.YAML_LINES, A.CONFIG_LINES), _V2.replace(A.YAML_LINES, A.CONFIG_LINES)


@query("d3_compose_rules", f"WITH l AS ({A.CONFIG_LINES}) " + _config_sql([
    ("compose-privileged", "regexp_matches(trim(text), '(?i)^privileged\\s*:\\s*true\\b')"),
    ("compose-host-network", "regexp_matches(trim(text), '(?i)^network_mode\\s*:\\s*host\\s*$')"),
    ("compose-docker-socket", "contains(lower(text), 'docker.sock')"),
    ("compose-plaintext-secret", f"""regexp_matches(trim(text), '(?i)^-?\\s*["'']?[^:]+:\\s*["'']?[^$]') AND regexp_matches(text, {_re(K.SECRET_NAME)})
      AND trim(substr(text, instr(text, ':') + 1)) <> '' AND NOT regexp_matches(trim(substr(text, instr(text, ':') + 1)), {_re(K.PLACEHOLDER)})"""),
]))
def d3_rules(spark, sf_dir):
    return detect.scan_compose(A.sql(spark, sf_dir, A.CONFIG_LINES)).select(*_OUT)


@query("d4_kubernetes_rules", _V1_ALL + ", l2 AS (SELECT * FROM c) " + _config_sql([
    ("k8s-privileged-container", "inside AND regexp_matches(trim(text), '(?i)^privileged\\s*:\\s*true\\b')"),
    ("k8s-host-network", "regexp_matches(trim(text), '(?i)^hostNetwork\\s*:\\s*true\\b')"),
    ("k8s-host-pid", "regexp_matches(trim(text), '(?i)^hostPID\\s*:\\s*true\\b')"),
    ("k8s-hostpath", "regexp_matches(trim(text), '(?i)^-?\\s*hostPath\\s*:')"),
    ("k8s-loadbalancer", "regexp_matches(trim(text), '(?i)^type\\s*:\\s*LoadBalancer\\s*$')"),
]).replace("FROM l WHERE", "FROM l2 WHERE"))
def d4_rules(spark, sf_dir):
    return detect.scan_kubernetes(A.sql(spark, sf_dir, A.CONFIG_LINES)).select(*_OUT)


@query("d4c_actions_rules", _V2_ALL + ", l2 AS (SELECT *, bool_or(regexp_matches(text, '(?i)pull_request_target\\s*:')) OVER (PARTITION BY project_id, rel_path) AS targeted FROM c) " + _config_sql([
    ("github-action-unpinned", "contains(text, '- uses:') AND contains(text, '@') AND NOT regexp_matches(text, '@[0-9a-fA-F]{40}$')"),
    ("github-pull-request-target", "regexp_matches(trim(text), '(?i)pull_request_target\\s*:')"),
    ("github-target-checkout", "targeted AND contains(text, 'uses: actions/checkout@')"),
    ("github-secrets-in-run", "(regexp_matches(trim(text), '(?i)\\brun\\s*:') OR (block > 0 AND ended = 0)) AND regexp_matches(text, '\\$\\{\\{\\s*secrets\\.')"),
]).replace("FROM l WHERE", "FROM l2 WHERE"))
def d4c_rules(spark, sf_dir):
    return detect.scan_actions(A.sql(spark, sf_dir, A.CONFIG_LINES)).select(*_OUT)


_DOC_LINES = "SELECT source AS project_id, concat('doc', CAST(doc_id AS STRING)) AS rel_path, text AS content FROM documents"
_SECRET_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
v AS (SELECT doc_id, t, regexp_extract(t, {_re(detect.ASSIGNMENT)}, 1) AS v, ({' OR '.join(f'regexp_matches(t, {_re(p)})' for _, _, p in detect.SECRET_RULES)}) AS known FROM l),
e AS (SELECT *, list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v)))) AS bits FROM v WHERE v <> '')
SELECT concat('doc', CAST(doc_id AS VARCHAR)) AS file, rule_id, CAST(count(*) AS BIGINT) AS n FROM (
 {' UNION ALL '.join(f"SELECT doc_id, '{n}' AS rule_id FROM v WHERE regexp_matches(t, {_re(p)})" for n, _, p in detect.SECRET_RULES)}
 UNION ALL SELECT doc_id, 'secret' FROM e WHERE NOT known AND bits >= {detect.MIN_ENTROPY} AND NOT regexp_matches(v, {_re(K.PLACEHOLDER)})) GROUP BY 1, 2
"""


@query("d5_secrets", _SECRET_SQL)
def d5(spark, sf_dir):
    lines = FS.explode_lines(A.sql(spark, sf_dir, _DOC_LINES), "project_id", "rel_path")
    return detect.scan_secrets(lines).groupBy("file", "rule_id").agg(F.count("*").alias("n"))


@query("d6_entropy", """SELECT doc_id, coalesce(list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -(len(list_filter(string_split(s, ''), lambda d: d = c)) / length(s)) * log2(len(list_filter(string_split(s, ''), lambda d: d = c)) / length(s)))), 0) AS bits
 FROM (SELECT doc_id, string_split(text, ' ')[1] AS s FROM documents WHERE text IS NOT NULL)""")
def d6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select("doc_id", S.shannon_entropy(F.substring_index("text", " ", 1)).alias("bits"))


@query("d6_entropy_lines", """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, line, unnest(string_split(parts[line], '')) AS c, length(parts[line]) AS n FROM l WHERE parts[line] <> ''),
 k AS (SELECT doc_id, line, c, any_value(n) AS n, count(*) AS m FROM c GROUP BY 1, 2, 3),
 b AS (SELECT doc_id, line, sum(-(m / n) * log2(m / n)) AS bits FROM k GROUP BY 1, 2)
 SELECT doc_id, CAST(line AS INTEGER) AS line, round(coalesce(b.bits, 0), 6) + 0 AS bits FROM l LEFT JOIN b USING (doc_id, line)""")
def d6_lines(spark, sf_dir):
    """Every line of every document, the empty ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line"), F.round(S.shannon_entropy(F.col("text")) + 0.0, 6).alias("bits"))


_BITS = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v))))"
_HIDDEN = "text"
for _, _, _pattern in detect.SECRET_RULES:
    _HIDDEN = f"regexp_replace({_HIDDEN}, {_re(_pattern)}, '[REDACTED]', 'g')"
_HIDDEN = f"""regexp_replace({_HIDDEN}, '(?i)((?:password|passwd|secret|token|api[_-]?key|private[_-]?key|credential)[A-Za-z0-9_]*["'']?\\s*[:=]\\s*["''])[^"'']{{6,}}(["''])', '\\1[REDACTED]\\2', 'g')"""


def _provider_sql(columns: str, lines: str = A.SECRET_LINES) -> str:
    """Findings in ``lines``, by every rule."""
    rules = [(n, "CRITICAL" if n == "private-key" else "HIGH", f"regexp_matches(text, {_re(p)})") for n, _, p in detect.SECRET_RULES]
    rules.append(("secret", "HIGH", f"NOT known AND v <> '' AND bits >= {detect.MIN_ENTROPY} AND NOT regexp_matches(v, {_re(K.PLACEHOLDER)})"))
    known = " OR ".join(test for _, _, test in rules[:-1])
    found = " UNION ALL ".join(f"SELECT *, '{n}' AS rule_id, '{s}' AS severity FROM k WHERE {test}" for n, s, test in rules)
    return f"""WITH l AS ({lines}), v AS (SELECT *, regexp_extract(text, {_re(detect.ASSIGNMENT)}, 1) AS v, {known} AS known FROM l),
 k AS (SELECT *, {_BITS} AS bits FROM v) SELECT {columns} FROM ({found})"""


@query("d5_secrets_providers", _provider_sql(f"project_id, rel_path AS file, line, rule_id, severity, trim({_HIDDEN}) AS evidence"))
def d5_providers(spark, sf_dir):
    """Tokens of every provider, too short ones and placeholders among them, with their evidence."""
    return detect.scan_secrets(A.sql(spark, sf_dir, A.NUMBERED_SECRET_LINES)).select(*_OUT)


@query("d7_secret_history_providers", _provider_sql(f"project_id, md5(rel_path) AS commit, rel_path AS file, line, rule_id, md5(trim({_HIDDEN})) AS evidence_md5"))
def d7_providers(spark, sf_dir):
    """The same lines as added lines of commits, one commit a file."""
    patches = A.sql(spark, sf_dir, A.NUMBERED_SECRET_LINES).select("project_id", F.md5("rel_path").alias("commit"), F.col("rel_path").alias("path"), "line", "text")
    return detect.scan_secret_history(patches).select("project_id", "commit", "file", "line", "rule_id", F.md5("evidence").alias("evidence_md5"))


_TURNS = "SELECT role AS project_id, CAST(conv_id AS STRING) AS commit, concat('t', CAST(turn AS STRING)) AS path, CAST(turn AS INT) AS line, text FROM conversations"


@query("d7_secret_history", _provider_sql(f"project_id, commit, path AS file, line, rule_id, left(trim({_HIDDEN}), {K.MAX_EVIDENCE}) AS evidence", _TURNS))
def d7(spark, sf_dir):
    """Turns of conversations as added lines of commits."""
    return detect.scan_secret_history(A.sql(spark, sf_dir, _TURNS)).select("project_id", "commit", "file", "line", "rule_id", "evidence")


_PY_SINKS = {"os.system(v)": "python-command-injection", "conn.execute(v)": "python-sql-injection", "pickle.loads(v)": "python-unsafe-deserialization", "open(v)": "python-path-traversal"}
_JAVA_SINKS = {"statement.executeQuery(q);": "java-sql-injection", "Runtime.getRuntime().exec(q);": "java-command-injection", "new FileInputStream(q);": "java-path-traversal"}


def _flow_sql(lines: str, dirty: str, sinks: dict[str, str], said: str, weak: tuple[str, str, str]) -> str:
    """Findings of programs with one name: ``dirty`` says from the lines of a file whether the name holds input at a line."""
    rule = " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in sinks.items())
    return f"""WITH l AS ({lines}), t AS (SELECT *, {dirty} AS dirty FROM l)
 SELECT project_id, rel_path AS file, line, CASE text {rule} END AS rule_id, 'HIGH' AS severity, {said} AS evidence FROM t WHERE dirty AND CASE text {rule} END IS NOT NULL
 UNION ALL SELECT project_id, rel_path, line, '{weak[1]}', 'MEDIUM', {weak[2]} FROM t WHERE text = '{weak[0]}'"""


@query("d7_secret_history_documents", f"""
WITH l AS (SELECT lang AS project_id, concat('c', CAST(doc_id AS VARCHAR)) AS commit, source AS file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS parts FROM documents),
v AS (SELECT project_id, commit, file, CAST(i AS INTEGER) AS line, parts[i] AS t, regexp_extract(parts[i], {_re(detect.ASSIGNMENT)}, 1) AS v FROM l),
k AS (SELECT *, ({' OR '.join(f'regexp_matches(t, {_re(p)})' for _, _, p in detect.SECRET_RULES)}) AS known,
      list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v)))) AS bits FROM v)
{' UNION ALL '.join(f"SELECT project_id, commit, file, line, '{n}' AS rule_id FROM v WHERE regexp_matches(t, {_re(p)})" for n, _, p in detect.SECRET_RULES)}
UNION ALL SELECT project_id, commit, file, line, 'secret' FROM k WHERE v <> '' AND NOT known AND bits >= {detect.MIN_ENTROPY} AND NOT regexp_matches(v, {_re(K.PLACEHOLDER)})""")
def d7_documents(spark, sf_dir):
    """Lines of documents as added lines of commits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    patches = docs.select(
        F.col("lang").alias("project_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("commit"), F.col("source").alias("path"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).withColumn("line", F.col("pos") + 1)
    return detect.scan_secret_history(patches.drop("pos")).select("project_id", "commit", "file", "line", "rule_id")


@query("d8_python_flows", _flow_sql(
    A.program_lines(".py"), "coalesce(bool_or(starts_with(text, 'v = request')) OVER (PARTITION BY rel_path), false)", _PY_SINKS,
    "concat('tainted input -> ', string_split(text, '(')[1], ' (line ', CAST(line AS VARCHAR), ')')",
    ("hashlib.md5(v)", "python-weak-hash", "concat('weak hash: hashlib.md5 (line ', CAST(line AS VARCHAR), ')')"),
))
def d8(spark, sf_dir):
    return flows.scan_python_flows(A.code_files(spark, sf_dir, A.program_lines(".py"))).select(*_OUT)


_HELD = "CASE WHEN starts_with(text, 'String q = request') THEN 1 WHEN starts_with(text, 'String q =') THEN 0 END"


@query("d9_java_flows", _flow_sql(
    A.program_lines(".java"),
    # what was assigned last counts; before that, whether input is assigned anywhere
    f"coalesce(last_value({_HELD} IGNORE NULLS) OVER (PARTITION BY rel_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), max({_HELD}) OVER (PARTITION BY rel_path), 0) = 1",
    _JAVA_SINKS, "concat('request input -> ', text)", ('MessageDigest.getInstance("MD5");', "java-weak-crypto", "text"),
))
def d9(spark, sf_dir):
    return flows.scan_java_flows(A.code_files(spark, sf_dir, A.program_lines(".java"))).select(*_OUT)


def _js_files(spark, sf_dir):
    """Pairs of files for each order: a library of functions and a caller that imports it."""
    text = """
    SELECT concat('p', CAST(o_custkey % 20 AS STRING)) AS project_id, concat('web/lib', CAST(o_orderkey AS STRING), '.js') AS rel_path,
      CASE o_orderkey % 3 WHEN 0 THEN 'export function run(c) { exec(c); }' WHEN 1 THEN 'export const run = (c) => { db.query(c); }' ELSE 'export function run(c) { log(c); }' END AS content FROM orders
    UNION ALL
    SELECT concat('p', CAST(o_custkey % 20 AS STRING)), concat('web/app', CAST(o_orderkey AS STRING), '.js'),
      concat('import { run } from "./lib', CAST(o_orderkey AS STRING), '"; ', CASE WHEN o_orderkey % 2 = 0 THEN 'run(req.body.command);' ELSE 'run("fixed");' END) FROM orders
    UNION ALL
    SELECT concat('p', CAST(o_custkey % 20 AS STRING)), concat('web/one', CAST(o_orderkey AS STRING), '.ts'),
      CASE WHEN o_orderkey % 2 = 0 THEN 'const v = req.query.q; eval(v);' ELSE 'el.innerHTML = DOMPurify.sanitize(req.body.text);' END FROM orders
    """
    return FS.with_path_parts(A.sql(spark, sf_dir, text).withColumn("size", F.octet_length("content").cast("long")))


@query("d10_js_flows", """SELECT concat('p', CAST(o_custkey % 20 AS VARCHAR)) AS project_id, concat('web/one', CAST(o_orderkey AS VARCHAR), '.ts') AS file, 1 AS line, 'js-code-injection' AS rule_id,
 'CRITICAL' AS severity, 'request input -> eval -> eval(v)' AS evidence FROM orders WHERE o_orderkey % 2 = 0""")
def d10(spark, sf_dir):
    return flows.scan_js_flows(_js_files(spark, sf_dir)).select(*_OUT)


@query("d11_js_import_flows", """SELECT concat('p', CAST(o_custkey % 20 AS VARCHAR)) AS project_id, concat('web/lib', CAST(o_orderkey AS VARCHAR), '.js') AS file, 1 AS line,
 CASE o_orderkey % 3 WHEN 0 THEN 'js-command-injection' ELSE 'js-sql-injection' END AS rule_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 < 2""")
def d11(spark, sf_dir):
    return flows.js_import_flows(_js_files(spark, sf_dir)).select("project_id", "file", "line", "rule_id")


@query("d12_missing_headers", """SELECT page_id, list_filter(['content-security-policy', 'strict-transport-security', 'x-content-type-options', 'referrer-policy'],
 lambda h: NOT (h = 'content-security-policy' AND page_id % 2 = 0) AND NOT (h = 'referrer-policy' AND page_id % 3 = 0)) AS missing FROM pages""")
def d12(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    headers = F.map_filter(
        F.create_map(F.lit("Content-Security-Policy"), (F.col("page_id") % 2).cast("string"), F.lit("REFERRER-POLICY"), (F.col("page_id") % 3).cast("string")),
        lambda k, v: v == "0",
    )
    return detect.missing_security_headers(pages.withColumn("headers", headers)).select("page_id", "missing")


# -- merging -----------------------------------------------------------------------------------------------------


@query("j8_deduplicate", _standing(A.FINDINGS) + "SELECT project_id, rule_id, file, line, confidence, evidence FROM standing")
def j8(spark, sf_dir):
    return deduplicate(findings(spark, sf_dir).select(*F_COLS), ORDER).select("project_id", "rule_id", "file", "line", "confidence", "evidence")


@query("u3_exact_duplicates", f"""SELECT DISTINCT project_id, rule_id, file, line, evidence FROM ({A.FINDINGS}) WHERE rule_id IN ('weak-crypto', 'debug', 'docker-user-root')""")
def u3(spark, sf_dir):
    f = findings(spark, sf_dir).select(*F_COLS).where(F.col("rule_id").isin("weak-crypto", "debug", "docker-user-root"))
    return deduplicate(f, ORDER).select("project_id", "rule_id", "file", "line", "evidence")


#: A folder for each rule; only the first rules say something of sources and sinks. Every fifth project has configuration
#: files, whose findings join all with evidence; the others have a group for each family that nothing joins.
_J9_INPUT = f"""SELECT project_id, engine_rank, rule_rank, rule_id, title, severity, confidence, cwe, cve, cvss,
 CASE WHEN n LIKE '%7' AND CAST(replace(project_id, 'p', '') AS INT) % 5 = 0 THEN concat('deploy/compose-', n, '.yml') ELSE concat('src/m', CAST(rule_rank AS VARCHAR(9)), '/f', n, '.py') END AS file, line,
 CASE WHEN rule_rank < 3 THEN evidence ELSE replace(replace(evidence, ' token = "abc" request', ''), ' exec', '') END AS evidence, remediation, status
 FROM (SELECT *, replace(replace(file, 'src/f', ''), '.py', '') AS n FROM ({A.FINDINGS}) x) y"""

#: Families that are linked, by pairs of what their findings say; components by reaching; reasons by such pairs again.
_J9 = f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT *, string_split(lower(rule_id), '-')[1] AS family, CAST(regexp_matches(evidence, {_re(K.SOURCE_TERMS)}) AS INT) AS s, CAST(regexp_matches(evidence, {_re(K.SINK_TERMS)}) AS INT) AS t,
      CAST(regexp_matches(file, {_re(K.CONFIG_FILES)}) AS INT) AS c, CAST(trim(evidence) <> '' AS INT) AS e, row_number() OVER (PARTITION BY project_id ORDER BY {', '.join(ORDER)}) AS ord,
      list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], upper(severity)) AS rank FROM ({_J9_INPUT})),
g AS MATERIALIZED (SELECT project_id, family, s, t, c, e, count(DISTINCT file) AS nf, min(file) AS mf FROM f GROUP BY 1, 2, 3, 4, 5, 6),
w AS (SELECT DISTINCT project_id, file, family FROM f),
l AS MATERIALIZED (SELECT DISTINCT a.project_id, a.family AS x, b.family AS y FROM w a JOIN w b ON a.project_id = b.project_id AND a.file = b.file
  UNION SELECT a.project_id, a.family, b.family FROM g a JOIN g b ON a.project_id = b.project_id
  WHERE (a.s = 1 AND b.t = 1) OR (b.s = 1 AND a.t = 1) OR ((a.c = 1 OR b.c = 1) AND a.e = 1 AND b.e = 1)),
reach(project_id, x, y) AS (SELECT project_id, family, family FROM g UNION SELECT r.project_id, r.x, l.y FROM reach r JOIN l ON l.project_id = r.project_id AND l.x = r.y),
comp AS (SELECT project_id, x AS family, min(y) AS comp FROM reach GROUP BY 1, 2),
pairs AS (SELECT c.project_id, c.comp, (a.s = 1 AND b.t = 1) OR (b.s = 1 AND a.t = 1) AS st, (a.c = 1 OR b.c = 1) AND a.e = 1 AND b.e = 1 AS cfg
  FROM g a JOIN g b ON a.project_id = b.project_id AND a.family <> b.family AND NOT (a.nf = 1 AND b.nf = 1 AND a.mf = b.mf)
  JOIN comp c ON c.project_id = a.project_id AND c.family = a.family JOIN comp d ON d.project_id = b.project_id AND d.family = b.family AND d.comp = c.comp),
kinds AS (SELECT project_id, comp, list_sort(list(DISTINCT kind)) AS kinds FROM (
  SELECT c.project_id, c.comp, '{correlate.SHARED_FILE}' AS kind FROM f JOIN comp c ON c.project_id = f.project_id AND c.family = f.family GROUP BY 1, 2, f.file HAVING count(*) > 1
  UNION ALL SELECT c.project_id, c.comp, '{correlate.SHARED_FAMILY}' FROM f JOIN comp c ON c.project_id = f.project_id AND c.family = f.family GROUP BY 1, 2, f.family HAVING count(DISTINCT file) > 1
  UNION ALL SELECT project_id, comp, '{correlate.SOURCE_SINK}' FROM pairs WHERE st
  UNION ALL SELECT project_id, comp, '{correlate.CONFIG_CODE}' FROM pairs WHERE cfg AND NOT st) GROUP BY 1, 2)
SELECT f.project_id, concat('risk-', substr(sha256(arg_min(concat(rule_id, '|', f.file, '|', CAST(line AS VARCHAR), '|', evidence), ord)), 1, 16)) AS group_id,
 arg_min(severity, (10 - rank) * 1000000 + ord) AS severity, CASE WHEN bool_and(lower(confidence) = 'high') THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n, array_to_string(any_value(kinds), '; ') AS rationale
FROM f JOIN comp ON comp.project_id = f.project_id AND comp.family = f.family JOIN kinds ON kinds.project_id = comp.project_id AND kinds.comp = comp.comp
GROUP BY f.project_id, comp.comp HAVING count(*) > 1
"""


@query("j9_correlate", _J9)
def j9(spark, sf_dir):
    groups, _ = correlate.correlate(A.sql(spark, sf_dir, _J9_INPUT).select(*F_COLS), ORDER)
    return groups.select("project_id", "group_id", "severity", "confidence", F.col("n_findings").alias("n"), "rationale")


#: Members by their fingerprint: how many groups there are in a project, and which members are in which.
@query("j9_members", _J9.split("kinds AS (")[0].rsplit("pairs AS (", 1)[0].rstrip().rstrip(",") + f"""
SELECT f.project_id, concat('risk-', first_value(fp) OVER (PARTITION BY f.project_id, comp.comp ORDER BY ord)) AS group_id, fp AS fingerprint, f.rule_id, f.file, f.line
FROM (SELECT *, substr(sha256(concat(rule_id, '|', file, '|', CAST(line AS VARCHAR), '|', evidence)), 1, 16) AS fp FROM f) f JOIN comp ON comp.project_id = f.project_id AND comp.family = f.family
QUALIFY count(*) OVER (PARTITION BY f.project_id, comp.comp) > 1""")
def j9_members(spark, sf_dir):
    _, members = correlate.correlate(A.sql(spark, sf_dir, _J9_INPUT).select(*F_COLS), ORDER)
    return members.select("project_id", "group_id", "fingerprint", "rule_id", "file", "line")


# -- lifecycle, workflow -----------------------------------------------------------------------------------------

_FP = "substr(sha256(concat(rule_id, chr(10), cwe, chr(10), file, chr(10), evidence)), 1, 20)"


@query("f1_fingerprints", f"""SELECT DISTINCT project_id, file, line, {_FP} AS fp_lifecycle, substr(sha256(concat(rule_id, '|', file, '|', CAST(line AS VARCHAR), '|', evidence)), 1, 16) AS fp_asset,
 sha256(concat(rule_id, '|', file, '|', CAST(line AS VARCHAR), '|', evidence)) AS fp_sarif FROM ({A.FINDINGS})""")
def f1(spark, sf_dir):
    a = [F.col(c) for c in ("rule_id", "file", "line", "evidence")]
    return findings(spark, sf_dir).select(
        "project_id", "file", "line", S.fp_lifecycle(a[0], F.col("cwe"), a[1], a[3]).alias("fp_lifecycle"), S.fp_asset(*a).alias("fp_asset"), S.fp_sarif(*a).alias("fp_sarif")
    ).distinct()


@query("f2_risk_score", f"""SELECT severity, confidence, count(*) AS n, any_value(s) AS score, CASE WHEN any_value(s) >= 8 THEN 'urgent' WHEN any_value(s) >= 5 THEN 'high' WHEN any_value(s) >= 2 THEN 'normal' ELSE 'informational' END AS priority
 FROM (SELECT severity, confidence, CASE upper(severity) WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 ELSE 4 END * CASE upper(confidence) WHEN 'HIGH' THEN 1.0 ELSE 0.75 END::DOUBLE AS s FROM ({A.FINDINGS})) GROUP BY 1, 2""")
def f2(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("r", S.risk_score(F.col("severity"), F.col("confidence")))
    return f.groupBy("severity", "confidence").agg(F.count("*").alias("n"), F.first("r.score").alias("score"), F.first("r.priority").alias("priority"))


@query("f3_redact", f"SELECT DISTINCT evidence, regexp_replace(evidence, {_re(K.REDACT)}, '\\1=<redacted>', 'g') AS redacted FROM ({A.FINDINGS})")
def f3(spark, sf_dir):
    return findings(spark, sf_dir).select("evidence", S.redact(F.col("evidence")).alias("redacted")).distinct()


@query("f4_f5_families", f"""SELECT DISTINCT rule_id, string_split(lower(rule_id), '-')[1] AS family,
 CAST((CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'command|exec') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'sql|query') THEN 2 ELSE 0 END)
 + (CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'xss|html') THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(lower(rule_id || ' ' || title), 'path|traversal') THEN 8 ELSE 0 END) AS INTEGER) AS mask FROM ({A.FINDINGS})""")
def f45(spark, sf_dir):
    return findings(spark, sf_dir).select("rule_id", S.rule_family(F.col("rule_id")).alias("family"), S.overlap_family(F.col("rule_id"), F.col("title")).alias("mask")).distinct()


@query("f6_evidence_flags", f"SELECT evidence, bool_or(regexp_matches(evidence, {_re(K.SOURCE_TERMS)})) AS s, bool_or(regexp_matches(evidence, {_re(K.SINK_TERMS)})) AS t, bool_or(regexp_matches(file, {_re(K.CONFIG_FILES)})) AS c FROM ({A.FINDINGS}) GROUP BY 1")
def f6(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("evidence").agg(
        F.bool_or(S.has_source(F.col("evidence"))).alias("s"), F.bool_or(S.has_sink(F.col("evidence"))).alias("t"), F.bool_or(S.is_config_file(F.col("file"))).alias("c")
    )


@query("f7_sarif_fields", f"""SELECT DISTINCT severity, cwe, CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END AS level, concat('https://cwe.mitre.org/data/definitions/', regexp_extract(cwe, '(\\d+)', 1), '.html') AS help FROM ({A.FINDINGS})""")
def f7(spark, sf_dir):
    return findings(spark, sf_dir).select("severity", "cwe", S.sarif_level(F.col("severity")).alias("level"), S.help_uri(F.col("cwe")).alias("help")).distinct()


@query("f8_workflow_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS due FROM orders")
def f8(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", S.parse_workflow_date(text, "due_date").alias("due"))


@query("f9_advisory_severity", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'LOW' WHEN p_partkey % 4 = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN p_partkey % 2 = 0 THEN 'advisory-provided' ELSE '5.0' END AS cvss FROM part""")
def f9(spark, sf_dir):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey",
        S.advisory_severity(
            F.when(k % 4 == 0, "low").when(k % 4 == 2, "unheard-of"), F.array(F.when(k % 4 == 1, "CVSS:medium"), F.lit("none"))
        ).alias("severity"),
        S.advisory_cvss(F.when(k % 2 == 1, "5.0")).alias("cvss"),
    )


@query("f11_advisory_ranges", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 3 END AS INTEGER) AS n_ranges FROM part")
def f11(spark, sf_dir):
    kind = "array<struct<ranges:array<struct<type:string,events:array<map<string,string>>>>>>"
    one = '{"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]}]}'
    doc = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(one), (F.col("p_partkey") % 3).cast("int")), ","), F.lit("]"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.size(S.advisory_ranges(F.from_json(doc, kind))).alias("n_ranges"))


@query("f13_service_indicator", "SELECT doc_id, regexp_matches(lower(text), 'listen|server|service|port|hostnetwork|loadbalancer|docker\\.sock|localhost|127\\.0\\.0\\.1') AS service FROM documents WHERE text IS NOT NULL")
def f13(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", S.service_indicator(F.lit(""), F.col("text")).alias("service"))


@query("f14_html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def f14(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(S.html_escape(F.col("html"))).alias("digest"))


_V5 = f"""
WITH s AS (SELECT DISTINCT project_id, scan_no, fingerprint FROM ({A.SCANS})),
f AS (SELECT project_id, fingerprint, min(scan_no) AS first_seen FROM s GROUP BY 1, 2),
g AS (SELECT f.project_id, q.scan_no, f.fingerprint, first_seen, CASE WHEN s.scan_no IS NULL THEN 0 ELSE 1 END AS present
      FROM f JOIN (SELECT DISTINCT project_id, scan_no FROM s) q ON f.project_id = q.project_id AND q.scan_no >= f.first_seen
      LEFT JOIN s ON s.project_id = f.project_id AND s.scan_no = q.scan_no AND s.fingerprint = f.fingerprint),
r AS (SELECT *, max(CASE WHEN present = 1 THEN scan_no END) OVER w AS last_seen, CAST(sum(present) OVER w AS BIGINT) AS times_seen,
      CASE WHEN present = 0 THEN 'fixed' WHEN lag(present) OVER (PARTITION BY project_id, fingerprint ORDER BY scan_no) = 0 THEN 'reappeared' ELSE 'open' END AS status
      FROM g WINDOW w AS (PARTITION BY project_id, fingerprint ORDER BY scan_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("v5_replay_lifecycle", _V5 + "SELECT project_id, scan_no, fingerprint, first_seen, last_seen, times_seen, status FROM r")
def v5(spark, sf_dir):
    return G.replay_lifecycle(A.sql(spark, sf_dir, A.SCANS))


@query("v5_lifecycle_changes", _V5 + """, n AS (SELECT *, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY scan_no) - row_number() OVER (PARTITION BY project_id, fingerprint, status ORDER BY scan_no) AS run FROM r)
 SELECT project_id, fingerprint, status, min(first_seen) AS first_seen, min(scan_no) AS from_scan, max(scan_no) AS to_scan, min(times_seen) AS times_seen, CASE WHEN status = 'fixed' THEN max(last_seen) END AS last_seen
 FROM n GROUP BY project_id, fingerprint, status, run""")
def v5_changes(spark, sf_dir):
    changes = G.lifecycle_changes(A.sql(spark, sf_dir, A.SCANS))
    return changes.select("project_id", "fingerprint", "status", "first_seen", "from_scan", "to_scan", F.col("times_seen").cast("long").alias("times_seen"), "last_seen")


def _lifecycle(spark, sf_dir):
    """History after two scans: findings before 1995-06 and those after."""
    f = findings(spark, sf_dir)
    old = f.where("seen_at < timestamp '1995-06-01 00:00:00'")
    new = f.where("seen_at >= timestamp '1995-06-01 00:00:00'")
    empty = spark.createDataFrame([], "project_id string, fingerprint string, rule_id string, file string, line int, title string, severity string, first_seen timestamp, last_seen timestamp, times_seen int, status string")
    t1 = F.lit("1995-06-01 00:00:00").cast("timestamp")
    first = G.update_lifecycle(old, empty, t1)
    first = first.withColumn("status", F.when(F.substring("fingerprint", 1, 1) == "a", "fixed").when(F.substring("fingerprint", 1, 1) == "b", "accepted-risk").otherwise(F.col("status")))
    return new, first, G.update_lifecycle(new, first, _now())


_J2 = f"""
WITH f AS (SELECT *, {_FP} AS fp FROM ({A.FINDINGS})),
h AS (SELECT project_id, fp, CASE substr(fp, 1, 1) WHEN 'a' THEN 'fixed' WHEN 'b' THEN 'accepted-risk' ELSE 'open' END AS status FROM f WHERE seen_at < TIMESTAMP '1995-06-01' GROUP BY 1, 2),
n AS (SELECT DISTINCT project_id, fp FROM f WHERE seen_at >= TIMESTAMP '1995-06-01'),
j AS (SELECT coalesce(h.project_id, n.project_id) AS project_id, coalesce(h.fp, n.fp) AS fingerprint, h.fp IS NOT NULL AS known, n.fp IS NOT NULL AS found, h.status AS old FROM h FULL JOIN n ON h.project_id = n.project_id AND h.fp = n.fp),
r AS (SELECT project_id, fingerprint, CASE WHEN NOT found THEN 'fixed' WHEN old = 'fixed' THEN 'reappeared' ELSE 'open' END AS status, CAST(CAST(known AS INT) + CAST(found AS INT) AS INTEGER) AS times_seen,
      CASE WHEN known THEN TIMESTAMP '1995-06-01' ELSE TIMESTAMP '2024-01-01' END AS first_seen, CASE WHEN found THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '1995-06-01' END AS last_seen
      FROM j WHERE found OR old <> 'accepted-risk')
"""


@query("j2_update_lifecycle", _J2 + "SELECT * FROM r")
def j2(spark, sf_dir):
    return _lifecycle(spark, sf_dir)[2].select("project_id", "fingerprint", "status", "times_seen", "first_seen", "last_seen")


@query("j2_update_lifecycle_all", _J2 + "SELECT * FROM r")
def j2_all(spark, sf_dir):
    return _lifecycle(spark, sf_dir)[2].select("project_id", "fingerprint", "status", "times_seen", "first_seen", "last_seen")


@query("t2_lifecycle_stream", f"""WITH f AS (SELECT *, {_FP} AS fp FROM ({A.SCANNED})),
s AS (SELECT project_id, scanned_at, row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC) AS k FROM (SELECT DISTINCT project_id, scanned_at FROM f)),
x AS (SELECT DISTINCT project_id, scanned_at, fp FROM f)
SELECT project_id, fp AS fingerprint, min(scanned_at) AS first_seen, max(scanned_at) AS last_seen, CAST(count(*) AS INTEGER) AS times_seen,
 CASE WHEN min(k) > 1 THEN 'fixed' WHEN count(*) > 1 AND NOT bool_or(k = 2) THEN 'reappeared' ELSE 'open' END AS status FROM x JOIN s USING (project_id, scanned_at) GROUP BY 1, 2""")
def t2(spark, sf_dir):
    """All findings as a stream of monthly scans, and the history that the stream keeps."""
    path = scratch_path(spark, "lifecycle")
    jobs.lifecycle_stream(A.sql(spark, sf_dir, A.SCANNED, stream=True), path, f"{path}-offsets").awaitTermination()
    return read_buckets(spark, path).select("project_id", "fingerprint", "first_seen", "last_seen", "times_seen", "status")


@query("a7_lifecycle_counts", _J2 + "SELECT project_id, status, count(*) AS n FROM r GROUP BY 1, 2")
def a7(spark, sf_dir):
    return G.lifecycle_counts(_lifecycle(spark, sf_dir)[2])


@query("a7_lifecycle_counts_all", _J2 + "SELECT project_id, status, count(*) AS n FROM r GROUP BY 1, 2")
def a7_all(spark, sf_dir):
    return G.lifecycle_counts(_lifecycle(spark, sf_dir)[2])


#: A record's place is that of the last finding of the last scan that had it; of records in one place the last seen counts.
_J4 = _J2 + """, place AS (SELECT project_id, fp, rule_id, file, line FROM f
  QUALIFY row_number() OVER (PARTITION BY project_id, fp ORDER BY seen_at >= TIMESTAMP '1995-06-01' DESC, engine_rank DESC, file DESC, line DESC, rule_rank DESC) = 1),
k AS (SELECT p.project_id, p.rule_id, p.file, p.line, arg_max(p.fp, concat(CAST(r.last_seen AS VARCHAR), p.fp)) AS fp
  FROM place p JOIN r ON r.project_id = p.project_id AND r.fingerprint = p.fp GROUP BY 1, 2, 3, 4)
SELECT f.project_id, f.rule_id, f.file, f.line, f.evidence, coalesce(k.fp, '') AS fingerprint
FROM f LEFT JOIN k ON k.project_id = f.project_id AND k.rule_id = f.rule_id AND k.file = f.file AND k.line = f.line WHERE f.seen_at >= TIMESTAMP '1995-06-01'
"""


@query("j4_attach_fingerprint", _J4)
def j4(spark, sf_dir):
    new, _, history = _lifecycle(spark, sf_dir)
    return G.attach_fingerprint(new, history).select("project_id", "rule_id", "file", "line", "evidence", "fingerprint")


_CHECKED = f"""SELECT *, CASE WHEN state NOT IN ('open','in-progress','accepted-risk','false-positive','resolved') THEN 'state must be one of: accepted-risk, false-positive, in-progress, open, resolved'
 WHEN state IN ('accepted-risk','false-positive') AND coalesce(rationale, '') = '' THEN 'rationale is required for accepted-risk or false-positive decisions'
 WHEN state = 'accepted-risk' AND expires_at IS NULL THEN 'expires_at is required for accepted-risk decisions' END AS problem FROM ({A.ACTIONS})"""
_WORKFLOW = f"""SELECT project_id, fingerprint, b.state AS state, b.owner AS owner, b.due_date AS due_date, b.expires_at AS expires_at, updated_at, created_at FROM (
 SELECT project_id, fingerprint, arg_max({{'state': state, 'owner': owner, 'due_date': due_date, 'expires_at': expires_at}}, ts) AS b, max(ts) AS updated_at, min(ts) AS created_at
 FROM ({_CHECKED}) WHERE problem IS NULL GROUP BY 1, 2)"""


def _workflow(spark, sf_dir):
    actions = A.sql(spark, sf_dir, A.ACTIONS)
    empty = spark.createDataFrame([], "project_id string, fingerprint string, state string, owner string, due_date date, decision string, rationale string, expires_at date, updated_at timestamp, created_at timestamp")
    return G.apply_finding_actions(empty, actions)


@query("t1_apply_actions", f"SELECT project_id, fingerprint, state, owner, updated_at, created_at FROM ({_WORKFLOW})")
def t1(spark, sf_dir):
    return _workflow(spark, sf_dir)[0].select("project_id", "fingerprint", "state", "owner", "updated_at", "created_at")


@query("t1_rejected_actions", f"SELECT event_id, problem FROM ({_CHECKED}) WHERE problem IS NOT NULL")
def t1b(spark, sf_dir):
    return _workflow(spark, sf_dir)[1].select("event_id", "problem")


_SEEN = f"SELECT DISTINCT project_id, fingerprint, CASE WHEN fingerprint LIKE '%1' THEN 'HIGH' ELSE 'LOW' END AS severity, 'MEDIUM' AS confidence FROM ({A.ACTIONS})"
_ENRICHED = f"""SELECT s.*, coalesce(w.state, 'open') AS state, CASE WHEN w.state IN ('resolved', 'false-positive') THEN 'reopened' ELSE coalesce(w.state, 'open') END AS effective_state,
 coalesce(w.due_date < DATE '{TODAY}' AND w.state NOT IN ('resolved', 'false-positive'), false) AS overdue, coalesce(w.expires_at < DATE '{TODAY}' AND w.state = 'accepted-risk', false) AS expired,
 CASE WHEN severity = 'HIGH' THEN 5.25 ELSE 1.5 END AS score
 FROM ({_SEEN}) s LEFT JOIN ({_WORKFLOW}) w ON s.project_id = w.project_id AND s.fingerprint = w.fingerprint"""


def _enriched(spark, sf_dir):
    seen = A.sql(spark, sf_dir, _SEEN)
    return seen, G.enrich_workflow(seen, _workflow(spark, sf_dir)[0], _today())


@query("j3_enrich_workflow", f"SELECT project_id, fingerprint, state, effective_state, overdue, expired, overdue OR expired OR effective_state = 'reopened' AS attention_required FROM ({_ENRICHED})")
def j3(spark, sf_dir):
    return _enriched(spark, sf_dir)[1].select("project_id", "fingerprint", *[f"workflow.{c}" for c in ("state", "effective_state", "overdue", "expired", "attention_required")])


@query("a3_risk_summary", f"""SELECT project_id, round(sum(score), 2)::DOUBLE AS total_score, CAST(count_if(score >= 5) AS BIGINT) AS n_high, CAST(count_if(score < 2) AS BIGINT) AS n_informational,
 CAST(count_if(overdue OR expired OR effective_state = 'reopened') AS BIGINT) AS attention_required FROM ({_ENRICHED}) GROUP BY 1""")
def a3(spark, sf_dir):
    r = G.risk_summary(_enriched(spark, sf_dir)[1])
    pick = lambda k: F.coalesce(F.try_element_at("priority_counts", F.lit(k)), F.lit(0)).cast("long")
    return r.select("project_id", "total_score", pick("high").alias("n_high"), pick("informational").alias("n_informational"), "attention_required")


@query("a4_governance_summary", f"""SELECT project_id, CAST(count_if(due_date < DATE '{TODAY}' AND state NOT IN ('resolved', 'false-positive')) AS BIGINT) AS overdue,
 CAST(count_if(expires_at < DATE '{TODAY}' AND state = 'accepted-risk') AS BIGINT) AS expired_accepted_risks, CAST(count_if(coalesce(owner, '') = '' AND state NOT IN ('resolved', 'false-positive')) AS BIGINT) AS unowned_open,
 count(*) AS tracked, any_value(n) AS observed_findings FROM ({_WORKFLOW}) JOIN (SELECT project_id, count(*) AS n FROM ({_SEEN}) GROUP BY 1) USING (project_id) GROUP BY 1""")
def a4(spark, sf_dir):
    seen = A.sql(spark, sf_dir, _SEEN)
    return G.governance_summary(_workflow(spark, sf_dir)[0], seen, _today()).drop("state_counts")


@query("a4_state_counts", f"SELECT project_id, state, count(*) AS n FROM ({_WORKFLOW}) GROUP BY 1, 2")
def a4_states(spark, sf_dir):
    """The records of each state, as the summary's map has them."""
    summary = G.governance_summary(_workflow(spark, sf_dir)[0], A.sql(spark, sf_dir, _SEEN), _today())
    return summary.select("project_id", F.explode("state_counts").alias("state", "n"))


# -- dependencies ------------------------------------------------------------------------------------------------


@query("j1_dependency_findings", f"""SELECT project_id, cve, file, severity, title, evidence FROM (
 SELECT d.project_id, a.id AS cve, d.source AS file, coalesce(a.severity, 'HIGH') AS severity, CASE WHEN a.summary = '' THEN 'Known vulnerability in ' || d.package ELSE a.summary END AS title,
 concat('npm package ', d.package, ' ', d.version, ' matches advisory ', a.id) AS evidence
 FROM (SELECT project_id, package, version, min(source) AS source FROM ({A.PACKAGES}) GROUP BY 1, 2, 3) d JOIN ({A.ADVISORIES}) a ON d.package = a.package AND d.version = a.version WHERE a.id IS NOT NULL)""")
def j1(spark, sf_dir):
    f = dependencies.dependency_findings(A.sql(spark, sf_dir, A.DIFFERENT_PACKAGES), A.sql(spark, sf_dir, A.ADVISORIES))
    return f.select("project_id", "cve", "file", "severity", "title", "evidence")


def _manifests(spark, sf_dir):
    """Manifests of seven kinds, one for each supplier and kind, with the supplier's parts as packages."""
    parts = A.sql(spark, sf_dir, A.DIFFERENT_PACKAGES).withColumn("package", F.replace("package", F.lit(" "), F.lit("-")))
    by = parts.groupBy("project_id").agg(F.array_sort(F.collect_set(F.struct("package", "version"))).alias("x"))
    each = lambda form: F.transform("x", lambda p: F.format_string(form, p["package"], p["version"]))
    doc = lambda head, form, sep, tail: F.concat(F.lit(head), F.array_join(each(form), sep), F.lit(tail))
    kinds = {
        "package.json": doc('{"dependencies":{', '"%s":"%s"', ",", "}}"),
        "package-lock.json": doc('{"packages":{', '"n/%1$s":{"name":"%1$s","version":"%2$s"}', ",", "}}"),
        "requirements.txt": doc("", "%s==%s; x", "\n", "\n"),
        "Pipfile.lock": doc('{"default":{', '"%s":{"version":"==%s"}', ",", "}}"),
        "poetry.lock": doc("", '[[package]]\nname = "%s"\nversion = "%s"\n', "\n", ""),
        "pom.xml": doc('<project xmlns="urn:m">', "<dependency><groupId>g</groupId><artifactId>%s</artifactId><version>%s</version></dependency>", "", "</project>"),
        "build.gradle": doc("dependencies {\n", "implementation 'g:%s:%s'", "\n", "\n}"),
    }
    files = by.select("project_id", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds.values()))).alias("rel_path", "content"))
    return FS.with_path_parts(files.withColumn("size", F.octet_length("content").cast("long")))


@query("m8_dependencies", f"""SELECT DISTINCT project_id, CASE WHEN f IN ('pom.xml', 'build.gradle') THEN 'g:' ELSE '' END || replace(package, ' ', '-') AS package, version, f AS source,
 CASE WHEN f IN ('package.json', 'package-lock.json') THEN 'npm' WHEN f IN ('pom.xml', 'build.gradle') THEN 'Maven' ELSE 'PyPI' END AS ecosystem, f IN ('package-lock.json', 'Pipfile.lock', 'poetry.lock') AS lockfile
 FROM ({A.PACKAGES}) CROSS JOIN (SELECT unnest(['package.json', 'package-lock.json', 'requirements.txt', 'Pipfile.lock', 'poetry.lock', 'pom.xml', 'build.gradle']) AS f)""")
def m8(spark, sf_dir):
    return dependencies.dependencies(_manifests(spark, sf_dir)).select("project_id", "package", "version", "source", "ecosystem", "lockfile")


# -- remediation -------------------------------------------------------------------------------------------------


@query("f12_remediation_records", f"""SELECT DISTINCT project_id, substr(sha256(concat(rule_id, '|', file, '|', CAST(line AS VARCHAR), '|', evidence)), 1, 16) AS fingerprint, 'Fix it, then rotate token=<redacted>' AS recommendation,
 concat('Manual review at ', file, ':', CAST(line AS VARCHAR), '; proposed change: Fix it, then rotate token=<redacted>') AS patch_preview, 'proposed' AS status FROM ({A.FINDINGS})""")
def f12(spark, sf_dir):
    return G.remediation_records(findings(spark, sf_dir), _now()).select("project_id", "fingerprint", "recommendation", "patch_preview", "status").distinct()


def _plan(spark, sf_dir, known="line <= 4"):
    f = findings(spark, sf_dir)
    old, new = f.where(known), f.where("line >= 3")
    t0 = F.lit("2023-01-01 00:00:00").cast("timestamp")
    every = G.remediation_records(old, t0)
    first = every.dropDuplicates(["project_id", "fingerprint"])
    chosen = every.where(F.substring("fingerprint", 1, 1) == "c").select("project_id", "fingerprint")
    return G.approve_remediation(first, chosen, t0), G.remediation_records(new, _now()), new


_AFP = f"SELECT DISTINCT project_id, line, substr(sha256(concat(rule_id, '|', file, '|', CAST(line AS VARCHAR), '|', evidence)), 1, 16) AS fp FROM ({A.FINDINGS})"


@query("j5_merge_remediation", f"""SELECT project_id, fp AS fingerprint, CASE WHEN line <= 4 AND substr(fp, 1, 1) = 'c' THEN 'approved' ELSE 'proposed' END AS status,
 CAST(CASE WHEN line <= 4 AND substr(fp, 1, 1) = 'c' THEN 2 ELSE 1 END AS INTEGER) AS n_history, CASE WHEN line <= 4 THEN 2023 ELSE 2024 END AS created, CASE WHEN line <= 2 THEN 2023 ELSE 2024 END AS updated FROM ({_AFP})""")
def j5(spark, sf_dir):
    old, fresh, _ = _plan(spark, sf_dir)
    return G.merge_remediation(old, fresh, _now()).select("project_id", "fingerprint", "status", F.size("history").alias("n_history"), F.year("created_at").alias("created"), F.year("updated_at").alias("updated"))


@query("j6_verify_remediation", f"""SELECT project_id, fp AS fingerprint, CASE WHEN line >= 3 THEN 'reappeared' ELSE 'verified' END AS status, line >= 3 AS finding_present FROM ({_AFP}) WHERE line <= 4""")
def j6(spark, sf_dir):
    old, _, now = _plan(spark, sf_dir)
    return G.verify_remediation(old, now, _now()).select("project_id", "fingerprint", "status", "verification.finding_present")


@query("j10_approve_remediation", f"SELECT project_id, fp AS fingerprint, CASE WHEN substr(fp, 1, 1) = 'c' THEN 'approved' ELSE 'proposed' END AS status FROM ({_AFP})")
def j10(spark, sf_dir):
    return _plan(spark, sf_dir, "true")[0].select("project_id", "fingerprint", "status")


@query("j10_approve_remediation_all", f"SELECT project_id, fp AS fingerprint, CASE WHEN substr(fp, 1, 1) = 'c' THEN 'approved' ELSE 'proposed' END AS status FROM ({_AFP})")
def j10_all(spark, sf_dir):
    return _plan(spark, sf_dir, "true")[0].select("project_id", "fingerprint", "status")


@query("a6_remediation_summary", f"SELECT project_id, CASE WHEN substr(fp, 1, 1) = 'c' THEN 'approved' ELSE 'proposed' END AS status, count(*) AS n FROM ({_AFP}) GROUP BY 1, 2")
def a6(spark, sf_dir):
    return G.remediation_summary(_plan(spark, sf_dir, "true")[0])


@query("a6_remediation_summary_all", f"SELECT project_id, CASE WHEN substr(fp, 1, 1) = 'c' THEN 'approved' ELSE 'proposed' END AS status, count(*) AS n FROM ({_AFP}) GROUP BY 1, 2")
def a6_all(spark, sf_dir):
    return G.remediation_summary(_plan(spark, sf_dir, "true")[0])


# -- roll-ups ----------------------------------------------------------------------------------------------------

_CLASSED = f"""SELECT *, CASE WHEN len(list_filter(parts, lambda x: x IN {_IGNORED})) > 0 THEN 'ignored' WHEN size IS NULL OR size > {K.MAX_BYTES} THEN 'skipped'
 WHEN suffix IN {_SUFFIXES} OR lower(name) = 'dockerfile' OR starts_with(lower(name), 'dockerfile.') THEN 'analyzed' ELSE 'skipped' END AS outcome FROM ({_PARTS})"""


@query("a1_coverage", f"""SELECT project_id, CAST(count_if(outcome = 'analyzed') AS BIGINT) AS files_analyzed, CAST(count_if(outcome = 'skipped') AS BIGINT) AS files_skipped, CAST(count_if(outcome = 'ignored') AS BIGINT) AS files_ignored FROM ({_CLASSED}) GROUP BY 1""")
def a1(spark, sf_dir):
    return G.scan_coverage(A.files_table(spark, sf_dir))[0].select("project_id", "files_analyzed", "files_skipped", "files_ignored")


_RULE_IDS = [*(r[0] for r in (*K.LINE_RULES, *K.CONFIG_RULES, *detect.SECRET_RULES)), "secret", *flows.FLOW_RULES]


@query("a1_engines", f"""SELECT project_id, bool_or(outcome = 'analyzed' AND suffix IN {(*K.FLOW_SUFFIXES, '.java')}) AS flow_engines, CAST(len({_RULE_IDS}) AS INTEGER) AS rules_executed FROM ({_CLASSED}) GROUP BY 1""")
def a1_engines(spark, sf_dir):
    return G.scan_coverage(A.files_table(spark, sf_dir))[0].select("project_id", "flow_engines", "rules_executed")


@query("a1_languages", f"SELECT project_id, CASE WHEN suffix = '' THEN '<no extension>' ELSE suffix END AS language, count(*) AS n_files FROM ({_CLASSED}) WHERE outcome = 'analyzed' GROUP BY 1, 2")
def a1b(spark, sf_dir):
    return G.scan_coverage(A.files_table(spark, sf_dir))[1]


@query("a1_skipped", f"SELECT project_id, rel_path, CASE WHEN size > {K.MAX_BYTES} THEN 'file exceeds 2 MB limit' ELSE 'unsupported file type' END AS reason FROM ({_CLASSED}) WHERE outcome = 'skipped'")
def a1c(spark, sf_dir):
    return G.scan_coverage(A.files_table(spark, sf_dir))[2]


@query("a2_quality", f"""SELECT project_id, CAST(count_if(confidence = 'high') AS BIGINT) AS high, CAST(count_if(confidence = 'medium') AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low, CAST(count_if(confidence = 'medium') AS BIGINT) AS review_required FROM ({A.FINDINGS}) GROUP BY 1""")
def a2(spark, sf_dir):
    return G.finding_quality(findings(spark, sf_dir)).drop("interpretation")


@query("a2_interpretation", f"""SELECT project_id, file, CASE WHEN bool_or(lower(confidence) = 'high') THEN 'Some findings have a modeled path from source to sink.' ELSE 'No finding has a modeled path from source to sink.' END AS interpretation
 FROM ({A.FINDINGS}) GROUP BY 1, 2""")
def a2_text(spark, sf_dir):
    """Each file of a project as a project, so that both readings occur."""
    by_file = findings(spark, sf_dir).withColumn("project_id", F.to_json(F.struct("project_id", "file")))
    both = F.from_json("project_id", "project_id string, file string")
    return G.finding_quality(by_file).select(both.alias("p"), "interpretation").select("p.*", "interpretation")


@query("a5_severity_counts", f"SELECT project_id, upper(severity) AS severity, count(*) AS n FROM ({A.FINDINGS}) GROUP BY 1, 2")
def a5(spark, sf_dir):
    return G.severity_counts(findings(spark, sf_dir))


def _summaries(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.array().cast("array<string>")
    return o.select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string")).alias("project_id"), F.concat(F.lit("scan-"), F.col("o_orderkey").cast("string")).alias("scan_id"),
        F.col("o_orderdate").cast("timestamp").alias("scanned_at"), (F.col("o_orderkey") % 9).cast("int").alias("findings_count"),
        (F.col("o_orderstatus") == "F").alias("policy_pass"), F.array(F.lit("a")).alias("new_fingerprints"), none.alias("fixed_fingerprints"),
        F.array_repeat(F.lit("b"), (F.col("o_orderkey") % 3).cast("int")).alias("reappeared_fingerprints"),
    )


_SUMS = "SELECT concat('p', CAST(o_custkey % 40 AS VARCHAR)) AS project_id, concat('scan-', CAST(o_orderkey AS VARCHAR)) AS scan_id, CAST(o_orderdate AS TIMESTAMP) AS scanned_at, o_orderkey, o_orderstatus FROM orders"


@query("v3_bounded_history", f"SELECT project_id, scan_id, rn = 1 AS last_scan FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM ({_SUMS})) WHERE rn <= 50")
def v3(spark, sf_dir):
    return G.bounded_history(_summaries(spark, sf_dir)).select("project_id", "scan_id", "last_scan")


@query("v4_project_trend", f"SELECT project_id, scanned_at, CAST(o_orderkey % 9 AS INTEGER) AS findings, o_orderstatus = 'F' AS policy_pass, 1 AS new, 0 AS fixed, CAST(o_orderkey % 3 AS INTEGER) AS reappeared, count(*) OVER (PARTITION BY project_id) AS scan_count FROM ({_SUMS})")
def v4(spark, sf_dir):
    return G.project_trend(_summaries(spark, sf_dir))


@query("t4_register_scans", f"SELECT project_id, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM ({_SUMS})) WHERE rn <= 20")
def t4(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    half = F.year("scanned_at") < 1995
    return G.register_scans(s.where(half), s.where(~half), 20).select("project_id", "scan_id")


@query("v6_first_finding", f"""SELECT project_id, rule_id, file, line, evidence FROM (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id ORDER BY engine_rank, file, line, rule_rank, evidence) AS rn FROM ({A.FINDINGS})) WHERE rn = 1""")
def v6(spark, sf_dir):
    f = findings(spark, sf_dir)
    by = F.struct("engine_rank", "file", "line", "rule_rank", "evidence")
    return f.groupBy("project_id", "rule_id").agg(F.min(by).alias("x")).select("project_id", "rule_id", "x.file", "x.line", "x.evidence")


@query("a8_scan_summary", _J2 + f""", now AS (SELECT project_id, CAST(count(*) AS INTEGER) AS findings_count FROM f WHERE seen_at >= TIMESTAMP '1995-06-01' GROUP BY 1),
 blocked AS (SELECT project_id, count(*) AS n FROM ({_BLOCKED}) WHERE seen_at >= TIMESTAMP '1995-06-01' GROUP BY 1),
 lists AS (SELECT project_id, count(DISTINCT fingerprint) AS a, count_if(status = 'open' AND first_seen = last_seen) AS b, count_if(status = 'fixed') AS c, count_if(status = 'reappeared') AS d FROM r GROUP BY 1)
 SELECT now.project_id, 'scan-1' AS scan_id, findings_count, CAST(a AS INTEGER) AS n_fp, CAST(b AS INTEGER) AS n_new, CAST(c AS INTEGER) AS n_fixed, CAST(d AS INTEGER) AS n_reappeared, coalesce(n, 0) = 0 AS policy_pass
 FROM now LEFT JOIN blocked ON now.project_id = blocked.project_id LEFT JOIN lists ON lists.project_id = now.project_id""")
def a8(spark, sf_dir):
    new, _, history = _lifecycle(spark, sf_dir)
    verdicts = G.evaluate_policy(new, _policies(new))[1]
    s = G.scan_summary(new, history, verdicts, F.lit("scan-1"), _now())
    return s.select("project_id", "scan_id", "findings_count", F.size("fingerprints").alias("n_fp"), F.size("new_fingerprints").alias("n_new"), F.size("fixed_fingerprints").alias("n_fixed"), F.size("reappeared_fingerprints").alias("n_reappeared"), "policy_pass")


_A9 = f"""SELECT project_id, class, rel_path FROM (
 SELECT project_id, rel_path, 'source' AS class FROM f WHERE suffix IN ({', '.join(repr(s) for s in K.SOURCE_SUFFIXES)})
 UNION ALL SELECT project_id, rel_path, 'configuration' FROM f WHERE lower(name) IN ({', '.join(repr(s) for s in K.CONFIG_NAMES)}) OR starts_with(lower(name), '.env.') OR suffix IN ({', '.join(repr(s) for s in K.CONFIG_SUFFIXES)})
 UNION ALL SELECT project_id, rel_path, 'docker' FROM f WHERE lower(name) = 'dockerfile' OR starts_with(lower(name), 'dockerfile.')
 UNION ALL SELECT project_id, rel_path, 'kubernetes' FROM f WHERE suffix IN ('.yml', '.yaml') AND (list_contains(parts, 'k8s') OR contains(lower(content), 'kind:'))
 UNION ALL SELECT project_id, rel_path, 'actions' FROM f WHERE list_contains(parts, '.github') AND list_contains(parts, 'workflows'))""".replace("SELECT project_id, class, rel_path FROM (", f"WITH f AS (SELECT * FROM ({_PARTS}) WHERE len(list_filter(parts, lambda x: x IN {_IGNORED})) = 0) SELECT project_id, class, rel_path FROM (", 1)


@query("a9_inventory", _A9)
def a9(spark, sf_dir):
    return G.inventory_assets(A.files_table(spark, sf_dir))


@query("o2_inventory_lists", f"SELECT project_id, class, list_sort(list(rel_path)) AS paths FROM ({_A9}) GROUP BY 1, 2")
def o2(spark, sf_dir):
    return G.inventory_lists(G.inventory_assets(A.files_table(spark, sf_dir)))


def _paged(rows: str, keys: str, value: str, values: str, n: int) -> str:
    """Rows of groups as sorted pages of ``n`` values."""
    return f"""SELECT {keys}, page, list({value} ORDER BY {value}) AS {values}, page * {n} AS n_before
 FROM (SELECT {keys}, {value}, (row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1) // {n} AS page FROM ({rows})) GROUP BY {keys}, page"""


@query("a8_summary_pages", _J2 + ", x AS (" + " UNION ALL ".join(
    f"SELECT project_id, '{name}' AS list, fingerprint FROM r WHERE {test}"
    for name, test in [("all", "fingerprint <> ''"), ("new", "status = 'open' AND first_seen = last_seen"), ("fixed", "status = 'fixed'"), ("reappeared", "status = 'reappeared'")]
) + ") " + _paged("SELECT * FROM x", "project_id, list", "fingerprint", "fingerprints", 100))
def a8_pages(spark, sf_dir):
    """All fingerprint lists of the scan summaries, whole."""
    return G.summary_lists(_lifecycle(spark, sf_dir)[2], 100)


@query("o2_inventory_pages", _paged(_A9, "project_id, class", "rel_path", "paths", 100))
def o2_pages(spark, sf_dir):
    return G.inventory_pages(G.inventory_assets(A.files_table(spark, sf_dir)), 100)


_EXPECTED = "SELECT lang AS case_id, 'quality' AS rule_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"
_OBSERVED = "SELECT lang AS case_id, source AS rule_id FROM documents WHERE n_chars > 8000 UNION SELECT lang, 'quality' FROM documents"


@query("a10_evaluate_rules", f"""SELECT case_id, CAST(count_if(e AND o) AS INTEGER) AS n_matched, CAST(count_if(e AND NOT o) AS INTEGER) AS n_missing, CAST(count_if(NOT e AND o) AS INTEGER) AS n_unexpected,
 CASE WHEN count_if(e) = 0 THEN 1.0 ELSE round(count_if(e AND o) / count_if(e), 3) END AS recall FROM (
 SELECT coalesce(x.case_id, y.case_id) AS case_id, x.rule_id IS NOT NULL AS e, y.rule_id IS NOT NULL AS o FROM ({_EXPECTED}) x FULL JOIN ({_OBSERVED}) y ON x.case_id = y.case_id AND x.rule_id = y.rule_id) GROUP BY 1""")
def a10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id")
    pick = lambda df, rule: df.select(F.col("lang").alias("case_id"), rule.alias("rule_id"))
    expected = pick(labels.where("quality = 1"), F.lit("quality")).union(pick(labels.where("toxic = 1"), F.col("source")))
    observed = pick(docs.where("n_chars > 8000"), F.col("source")).union(pick(docs, F.lit("quality")))
    r = G.evaluate_rules(expected, observed)
    return r.select("case_id", *[F.size(c).alias(f"n_{c}") for c in ("matched", "missing", "unexpected")], "recall")


@query("a11_duration_stats", "SELECT event_type AS case_id, round(avg(value), 6) AS mean_seconds, round(median(value), 6) AS median_seconds FROM events GROUP BY 1")
def a11(spark, sf_dir):
    return G.duration_stats(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("case_id"), F.col("value").alias("seconds")))


# -- sinks -------------------------------------------------------------------------------------------------------


@query("w3_sarif")
def w3(spark, sf_dir):
    """Documents counted part by part: their rules in the heads, results in the parts between."""
    parts = state.sarif_parts(findings(spark, sf_dir).select(*F_COLS), ORDER)
    head = F.concat("text", F.lit("]}]}"))
    rules = F.from_json(head, "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>>>")["runs"][0]["tool"]["driver"]["rules"]
    results = F.from_json(F.concat(F.lit("["), F.ltrim("text", F.lit(",")), F.lit("]")), "array<struct<ruleId:string,level:string>>")
    return parts.groupBy("project_id").agg(
        F.sum(F.length("text")).alias("n_chars"),
        F.sum(F.when(F.col("part") == state.HEAD, F.size(rules))).cast("int").alias("n_rules"),
        F.coalesce(F.sum(F.when(~F.col("part").isin(state.HEAD, state.TAIL), F.size(results))), F.lit(0)).cast("int").alias("n_results"),
    )


@query("w4_html", f"""SELECT project_id, CAST(sum(length(concat('<tr><td>', severity, '</td><td>', title, '</td><td>', file, ':', CAST(line AS VARCHAR), '</td><td>', replace(evidence, '"', '&quot;'), '</td></tr>'))) AS BIGINT) AS n_chars, count(*) AS n_rows FROM ({A.FINDINGS}) GROUP BY 1""")
def w4(spark, sf_dir):
    """Rows of the documents, counted part by part."""
    parts = state.html_parts(findings(spark, sf_dir).select(*F_COLS), ORDER).where(~F.col("part").isin(state.HEAD, state.TAIL))
    n_rows = F.size(F.regexp_extract_all("text", F.lit("(<tr>)"), F.lit(1)))
    return parts.groupBy("project_id").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(n_rows).alias("n_rows"))


_W_END = "SELECT project_id, CAST(strlen(d) AS BIGINT) AS n_bytes, sha256(d) AS sha256 FROM d"
_SHA = "sha256(concat(rule_id, '|', file, '|', CAST(line AS VARCHAR), '|', evidence))"
_NAMED = f"""concat('{{"lintlake/v1":"', {_SHA}, '"}}')"""
_RESULT = f"""concat('{{"ruleId":"', rule_id, '","level":"', CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END, '","message":{{"text":"', title,
 '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', file, '"}},"region":{{"startLine":', CAST(line AS VARCHAR), '}}}}}}],"fingerprints":', {_NAMED}, ',"partialFingerprints":', {_NAMED}, '}}')"""
_RULE = """concat('{"id":"', rule_id, '","shortDescription":{"text":"', title, '"},"help":{"text":"', remediation, '"},"properties":{"cwe":"', cwe, '"},"helpUri":"https://cwe.mitre.org/data/definitions/', replace(cwe, 'CWE-', ''), '.html"}')"""


#: Findings that agree in all of ORDER are taken by what is written of them.
@query("w3_sarif_parts", f"""WITH f AS (SELECT *, {_RESULT} AS r, {_RULE} AS u FROM ({A.FINDINGS})),
 u AS (SELECT project_id, string_agg(u, ',' ORDER BY {', '.join(ORDER)}, u) AS rules FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY project_id, rule_id ORDER BY {', '.join(ORDER)}, u) = 1) GROUP BY 1),
 r AS (SELECT project_id, string_agg(r, ',' ORDER BY {', '.join(ORDER)}, r) AS results FROM f GROUP BY 1),
 d AS (SELECT project_id, concat('{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"lintlake","rules":[', rules, ']}}}},"results":[', results, ']}}]}}') AS d FROM u JOIN r USING (project_id))
 {_W_END}""")
def w3_parts(spark, sf_dir):
    return state.part_digests(state.sarif_parts(findings(spark, sf_dir).select(*F_COLS), ORDER))


@query("w4_html_parts", f"""WITH f AS (SELECT *, concat('<tr><td>', severity, '</td><td>', title, '</td><td>', file, ':', CAST(line AS VARCHAR), '</td><td>', replace(evidence, '"', '&quot;'), '</td></tr>') AS r FROM ({A.FINDINGS})),
 d AS (SELECT project_id, concat({_re(state._html_head('Findings report'))}, string_agg(r, '' ORDER BY {', '.join(ORDER)}, r), '</table>') AS d FROM f GROUP BY 1) {_W_END}""")
def w4_parts(spark, sf_dir):
    return state.part_digests(state.html_parts(findings(spark, sf_dir).select(*F_COLS), ORDER))


@query("u1_run_detectors", f"SELECT 'java' AS engine_id, * FROM ({ORACLES['d9_java_flows']}) UNION ALL SELECT 'python', * FROM ({ORACLES['d8_python_flows']})")
def u1(spark, sf_dir):
    """Two of the detectors of a scan over files of both kinds."""
    programs = [A.code_files(spark, sf_dir, A.program_lines(s)) for s in (".py", ".java")]
    return run_detectors(programs[0].unionByName(programs[1]), ["python", "java"]).select("engine_id", *_OUT)


@query("w6_audit_events", "SELECT event_id, event_type AS event, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_details FROM events")
def w6(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.when(F.col("event_id") % 2 == 0, F.lit("Token")).otherwise(F.lit("job"))
    rows = e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"), F.create_map(key, F.col("props"), F.lit("id"), F.col("event_id").cast("string")).alias("details"))
    return state.audit_events(rows).select(F.col("details")["id"].cast("long").alias("event_id"), "event", F.size("details").alias("n_details"))

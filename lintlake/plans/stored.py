"""Queries that write files or state and give what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions.scalars import project_id
from lintlake.operators import governance as G
from lintlake.operators.findings import FIELDS, as_findings, rule_struct, with_order
from lintlake.operators.scan import register_detector, run_detectors, unregister_detector
from lintlake.plans import adapters as A
from lintlake.plans import queries as Q
from lintlake.plans.lineage import scratch_path
from lintlake.plans.queries import query
from lintlake.sources import state
from lintlake.sources.files import eligible_files, explode_lines, read_project_files, with_path_parts
from lintlake.streaming import jobs

_TYPES = ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in FIELDS)


@query("w1_findings_json", f"SELECT {', '.join(FIELDS)} FROM ({A.FINDINGS})")
def w1(spark, sf_dir):
    path = scratch_path(spark, "findings-json")
    state.write_findings_json(Q.findings(spark, sf_dir), path)
    return spark.read.schema(_TYPES).json(path)


@query("w2_findings_csv", f"SELECT {', '.join(FIELDS)} FROM ({A.FINDINGS})")
def w2(spark, sf_dir):
    path = scratch_path(spark, "findings-csv")
    state.write_findings_csv(Q.findings(spark, sf_dir), path)
    return spark.read.schema(_TYPES).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)


@query("w5_write_state", Q._J2 + "SELECT * FROM r")
def w5(spark, sf_dir):
    """A first version of the history, then an update by the later scan, each read from the table."""
    new, first, _ = Q._lifecycle(spark, sf_dir)
    path = scratch_path(spark, "state")
    state.write_state(first, path, 0)
    state.update_state(new, path, 1, lambda history, scan: G.update_lifecycle(scan, history, Q._now()), first.limit(0))
    return state.current_state(spark, path).select("project_id", "fingerprint", "status", "times_seen", "first_seen", "last_seen")


#: Orders written as lines of a file hold at most so many; the rest of a folder goes to further files.
FILE_LINES = 5_000


@query("s1_read_project_files", """SELECT CAST(o_orderkey % 2 AS INTEGER) AS root, concat('status=', o_orderstatus, '/year=', CAST(year(o_orderdate) AS VARCHAR)) AS folder,
 '.txt' AS suffix, concat(CAST(o_orderkey AS VARCHAR), ' ', o_orderpriority) AS text, count(*) AS n FROM orders GROUP BY ALL""")
def s1(spark, sf_dir):
    """Orders as text files below two roots, read as projects and cut into lines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"),
        (F.col("o_orderkey") % 2).cast("int").alias("root"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"),
    )
    roots = [scratch_path(spark, f"project{k}") for k in (0, 1)]
    for k, root in enumerate(roots):
        orders.where(F.col("root") == k).drop("root").write.partitionBy("status", "year").option("maxRecordsPerFile", FILE_LINES).text(root)
    files = read_project_files(spark, roots).where(F.col("suffix") == ".txt")
    lines = explode_lines(files, "project_id", "rel_path", "suffix")
    known = [F.when(F.col("project_id") == project_id(F.lit(root)), k) for k, root in enumerate(roots)]
    folder = F.regexp_replace("rel_path", "/[^/]*$", "")
    return lines.groupBy(F.coalesce(*known).alias("root"), folder.alias("folder"), "suffix", "text").agg(F.count("*").alias("n"))


@query("s3_load_policies", Q.ORACLES["p6_normalize_policy"])
def s3(spark, sf_dir):
    """A policy document for each project, written, read and checked."""
    path = scratch_path(spark, "policies")
    chosen = Q._policies(Q.findings(spark, sf_dir))
    record = F.to_json(F.struct(*chosen.columns))
    chosen.select(record.alias("value"), F.md5("project_id").alias("document")).write.partitionBy("document").text(path)
    return G.normalize_policy(state.load_policies(spark, path))


@query("x1_register_detector", """SELECT 'turn-commas' AS engine_id, role AS project_id, concat('c', CAST(conv_id AS VARCHAR), '.txt') AS file, CAST(i AS INTEGER) AS line, 'commas' AS rule_id, 'LOW' AS severity, left(trim(parts[i], chr(32) || chr(9)), 300) AS evidence
 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT role, conv_id, string_split(text, chr(10)) AS parts FROM conversations WHERE octet_length(encode(text)) <= 2000000)) WHERE contains(parts[i], ',')""")
def x1(spark, sf_dir):
    """A detector of our own, run by name beside the built-in ones: lines of turns with a comma."""
    name = "turn-commas"

    def commas(files):
        lines = explode_lines(eligible_files(files, [".txt"])).where(F.col("text").contains(","))
        return as_findings(lines.select("*", rule_struct("commas", "A line has a comma", "LOW", "CWE-0", "low", 0).alias("rule")).select("*", "rule.*").withColumn("evidence", F.col("text")), name)

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null").select(
        F.col("role").alias("project_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("rel_path"),
        F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"),
    )
    register_detector(name, commas)
    try:
        found = run_detectors(with_path_parts(turns), [name])
    finally:
        unregister_detector(name)
    return found.select("engine_id", "project_id", "file", "line", "rule_id", "severity", "evidence")


@query("s2_read_state", Q._J2 + "SELECT fingerprint, status, times_seen, first_seen, last_seen FROM r")
def s2(spark, sf_dir):
    """History as documents of each project, written and read."""
    path = scratch_path(spark, "documents")
    state.write_history(Q._lifecycle(spark, sf_dir)[2], path, compression="gzip")
    return state.read_state(spark, path, "history").select("fingerprint", "status", "times_seen", "first_seen", "last_seen")


@query("s4_read_advisories", """SELECT p_partkey AS n, p_name AS package, CAST(p_size AS VARCHAR) AS version, concat('OSV-', CAST(p_partkey AS VARCHAR)) AS id,
 CASE p_partkey % 4 WHEN 0 THEN 'LOW' WHEN 3 THEN 'CRITICAL' ELSE CASE p_size % 3 WHEN 0 THEN 'MEDIUM' ELSE 'HIGH' END END AS severity,
 CASE WHEN p_partkey % 2 = 0 THEN 'advisory-provided' ELSE '7.5' END AS cvss, CAST(p_size % 3 AS INTEGER) AS n_ranges FROM part""")
def s4(spark, sf_dir):
    """Parts as lines of an advisory dump, some without a level, a score or ranges."""
    k, size = F.col("p_partkey"), F.col("p_size")
    record = F.struct(
        F.col("p_name").alias("package"), size.cast("string").alias("version"), F.concat(F.lit("OSV-"), k.cast("string")).alias("id"), k.cast("string").alias("summary"),
        F.struct(F.when(k % 4 == 0, "low").when(k % 4 == 2, "odd").when(k % 4 == 3, "Critical").alias("severity"), F.when(k % 2 == 1, "7.5").alias("cvss")).alias("database_specific"),
        F.array(F.struct(F.lit("CVSS").alias("type"), F.when(size % 3 == 0, "x/medium").when(size % 3 == 1, "none").alias("score"))).alias("severity"),
        F.expr("""array_repeat(named_struct('ranges', array(named_struct('type', 'SEMVER', 'events', array(map('introduced', '0'))))), cast(p_size % 3 as int))""").alias("affected"),
    )
    path = scratch_path(spark, "advisories")
    spark.read.parquet(f"{sf_dir}/part.parquet").select(F.to_json(record).alias("value")).write.text(path)
    return state.read_advisories(spark, path).select(
        F.col("summary").cast("long").alias("n"), "package", "version", "id", "severity", "cvss", F.size("affected").alias("n_ranges")
    )


@query("o1_first_findings", f"""SELECT project_id, rule_id, file, line, evidence FROM (SELECT *, row_number() OVER (PARTITION BY project_id, rule_id ORDER BY engine_rank, file, line, rule_rank, rule_id, evidence) AS k FROM ({A.FINDINGS})) WHERE k = 1""")
def o1(spark, sf_dir):
    """The first finding of each rule of a project, by the order of arrival."""
    first = with_order(Q.findings(spark, sf_dir)).groupBy("project_id", "rule_id").agg(F.min("ord").alias("o"))
    return first.select("project_id", "rule_id", "o.file", "o.line", "o.evidence")


@query("w6_audit_details", """SELECT event_id, event_type AS event, CASE WHEN event_id % 2 = 0 THEN NULL ELSE props END AS job, CASE event_id % 3 WHEN 0 THEN user_id END AS user_id FROM events""")
def w6(spark, sf_dir):
    """Audit lines as written: what is kept of the details, by key; private ones are spelled in several ways."""
    private = F.element_at(F.array(*[F.lit(k) for k in ("Token", "SECRET", "passWord", "source", "Content")]), (F.col("event_id") % 5 + 1).cast("int"))
    pair = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    pairs = F.map_from_entries(F.array_compact(F.array(
        pair(F.lit("id"), F.col("event_id").cast("string")), pair(private, F.lit("hidden")),
        F.when(F.col("event_id") % 2 == 1, pair(F.lit("job"), F.col("props"))), F.when(F.col("event_id") % 3 == 0, pair(F.lit("user"), F.col("user_id").cast("string"))),
    )))
    path = scratch_path(spark, "audit")
    state.write_audit(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"), pairs.alias("details")), path)
    kept = spark.read.schema("event string, details map<string,string>").json(path)
    ok = F.when(F.size("details") == F.size(F.array_intersect(F.map_keys("details"), F.array(F.lit("id"), F.lit("job"), F.lit("user")))), F.col("event"))
    value = lambda key: F.try_element_at("details", F.lit(key))
    return kept.select(value("id").cast("long").alias("event_id"), ok.alias("event"), value("job").alias("job"), value("user").cast("long").alias("user_id"))


_ROW_SNIPPETS = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(A.SNIPPETS))
ROW_FILES = f"""
SELECT concat('p', CAST(l_suppkey % 20 AS STRING)) AS project_id,
       concat(CASE l_partkey % 7 WHEN 0 THEN 'node_modules/' ELSE 'src/' END, 'f', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING),
              CASE l_suppkey % 4 WHEN 0 THEN '.rb' WHEN 1 THEN '.txt' WHEN 2 THEN '.js' ELSE '.png' END) AS rel_path,
       CAST(CASE WHEN l_partkey % 11 = 0 THEN {K.MAX_BYTES} + l_partkey % 2 ELSE 100 END AS BIGINT) AS size,
       concat('first', chr(10), CASE l_partkey % {len(A.SNIPPETS)} {_ROW_SNIPPETS} END) AS content
FROM lineitem
"""
_ROW_LINES = f"""SELECT project_id, rel_path, CAST(2 AS INTEGER) AS line, string_split(content, chr(10))[2] AS text FROM ({ROW_FILES})
 WHERE NOT contains(rel_path, 'node_modules/') AND size <= {K.MAX_BYTES} AND regexp_matches(rel_path, '\\.(rb|txt)$')"""


@query("t3_scan_stream", Q._D1.replace(A.CODE_LINES, _ROW_LINES))
def t3(spark, sf_dir):
    """Line rules over a stream of files, one for each row; ignored folders, large files and other suffixes among them."""
    path = scratch_path(spark, "stream-findings")
    jobs.scan_stream(with_path_parts(A.sql(spark, sf_dir, ROW_FILES, stream=True)), path, f"{path}-offsets", ["heuristics"]).awaitTermination()
    return spark.read.parquet(path).select(*Q._OUT)

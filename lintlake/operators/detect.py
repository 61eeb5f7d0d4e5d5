"""Detectors made of DataFrame functions: line rules, configuration checks, secrets, response headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions.scalars import is_placeholder, shannon_entropy
from lintlake.operators.findings import as_findings, rule_struct, strip
from lintlake.sources.files import explode_lines

_CONFIG = {r[0]: r for r in K.CONFIG_RULES}
_RANK = {r[0]: i for i, r in enumerate(K.CONFIG_RULES)}
FILE = ("project_id", "rel_path")


def _rule(rule_id: str) -> Column:
    name, title, severity, cwe, confidence = _CONFIG[rule_id]
    return rule_struct(name, title, severity, cwe, confidence, _RANK[rule_id])


def _matched(lines: DataFrame, tests: list[tuple[Column, Column]]) -> DataFrame:
    """A row for each line and rule whose test holds; one pass, no shuffle."""
    hits = F.array_compact(F.array(*[F.when(test, rule) for test, rule in tests]))
    return lines.select(*lines.columns, F.explode(hits).alias("rule")).select(*lines.columns, "rule.*")


def scan_heuristics(lines: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Findings of the line rules."""
    tests = [
        (F.col("text").rlike("(?U)" + pattern), rule_struct(name, title, severity, cwe, "medium", i))
        for i, (name, title, severity, cwe, pattern) in enumerate(K.LINE_RULES)
    ]
    return as_findings(_matched(lines, tests).withColumn("evidence", F.col("text")), "heuristics", *keys)


def scan_dockerfile(lines: DataFrame) -> DataFrame:
    """Line rules of Dockerfiles."""
    rows = lines.withColumn("s", strip(F.col("text"))).where("s <> '' and not startswith(s, '#')")
    rows = rows.withColumn("instruction", F.upper(F.substring_index("s", " ", 1)))
    rows = rows.withColumn("argument", F.when(F.instr("s", " ") > 0, F.expr("substring(s, instr(s, ' ') + 1)")).otherwise(""))
    arg = F.col("argument")
    value = F.when(arg.contains("="), strip(F.expr("substring(argument, instr(argument, '=') + 1)"))).otherwise(
        strip(F.regexp_extract(arg, r"(?s)^\s*\S+\s+(.*)$", 1))
    )
    what = F.col("instruction")
    tests = [
        ((what == "USER") & F.lower(strip(arg)).isin("root", "0"), _rule("docker-user-root")),
        ((what == "ADD") & arg.rlike(r"(?iU)\bhttps?://"), _rule("docker-add-remote")),
        (what.isin("RUN", "CMD", "ENTRYPOINT") & arg.rlike(r"(?iU)\b(?:curl|wget)\b[^\n|]*\|\s*(?:sh|bash|zsh|ash)\b"),
         _rule("docker-pipe-to-shell")),
        (what.isin("ENV", "ARG") & arg.rlike(K.SECRET_NAME) & (value != "") & ~is_placeholder(value), _rule("docker-secret-in-build")),
    ]
    return as_findings(_matched(rows, tests).withColumn("evidence", F.col("text")), "configuration")


def dockerfile_missing_user(lines: DataFrame) -> DataFrame:
    """One finding for each Dockerfile in which no USER instruction occurs."""
    user = F.upper(F.substring_index(strip(F.col("text")), " ", 1)) == "USER"
    lacking = lines.groupBy(*FILE).agg(F.bool_or(user).alias("has")).where("not has")
    rows = lacking.withColumn("line", F.lit(1)).withColumn("evidence", F.lit("No USER instruction found"))
    return as_findings(rows.select("*", _rule("docker-user-missing").alias("r")).select("*", "r.*"), "configuration")


def scan_compose(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("s", strip(F.col("text")))
    s = F.col("s")
    value = F.trim(strip(F.expr("substring(s, instr(s, ':') + 1)")), F.lit("\"'"))
    tests = [
        (s.rlike(r"(?iU)^privileged\s*:\s*true\b"), _rule("compose-privileged")),
        (s.rlike(r"(?i)^network_mode\s*:\s*(?:host|['\"]host['\"])\s*$"), _rule("compose-host-network")),
        (F.lower(s).contains("docker.sock"), _rule("compose-docker-socket")),
        (s.rlike(r"(?i)^\s*-?\s*[\"']?[^:]+:\s*[\"']?[^$]") & s.rlike(K.SECRET_NAME) & (value != "") & ~value.rlike(K.PLACEHOLDER),
         _rule("compose-plaintext-secret")),
    ]
    return as_findings(_matched(rows, tests).withColumn("evidence", F.col("text")), "configuration")


def _indented(lines: DataFrame) -> DataFrame:
    s = strip(F.col("text"))
    lead = F.length("text") - F.length(F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+", ""))
    return lines.withColumn("s", s).withColumn("indent", lead)


def k8s_segments(lines: DataFrame) -> DataFrame:
    """Container state of each manifest line: ``segment`` (opened containers so far), ``inside``.

    ``containers:`` or ``initContainers:`` sets the expected indent (its own plus two) and closes what is open;
    ``- name:`` at that indent opens a container. On one line a name counts before a containers key.
    """
    order = Window.partitionBy(*FILE).orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = _indented(lines)
    rows = rows.withColumn("head", F.col("s").rlike(r"(?i)^(?:initC|c)ontainers\s*:"))
    rows = rows.withColumn("expected", F.last(F.when(F.col("head"), F.col("indent") + 2), ignorenulls=True).over(before))
    rows = rows.withColumn("opens", F.col("s").rlike(r"^-\s+name\s*:") & F.coalesce(F.col("indent") == F.col("expected"), F.lit(False)))
    rows = rows.withColumn("segment", F.sum(F.col("opens").cast("int")).over(so_far))
    event = F.when(F.col("head"), "head").when(F.col("opens"), "open")
    rows = rows.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(so_far) == "open", F.lit(False)))
    return rows


def scan_kubernetes(lines: DataFrame) -> DataFrame:
    rows = k8s_segments(lines)
    s = F.col("s")
    tests = [
        (F.col("inside") & s.rlike(r"(?iU)^privileged\s*:\s*true\b"), _rule("k8s-privileged-container")),
        (s.rlike(r"(?iU)^hostNetwork\s*:\s*true\b"), _rule("k8s-host-network")),
        (s.rlike(r"(?iU)^hostPID\s*:\s*true\b"), _rule("k8s-host-pid")),
        (s.rlike(r"(?i)^-?\s*hostPath\s*:"), _rule("k8s-hostpath")),
        (s.rlike(r"(?i)^type\s*:\s*LoadBalancer\s*$"), _rule("k8s-loadbalancer")),
    ]
    return as_findings(_matched(rows, tests).withColumn("evidence", F.col("text")), "configuration")


def k8s_missing_limits(lines: DataFrame) -> DataFrame:
    """Containers without ``limits:`` before the next container or the end; one that a containers key closes is not judged.

    ``limits:`` outside a container counts for the container opened last, as long as none is opened after it.
    """
    rows = k8s_segments(lines)
    by_segment = rows.where("segment > 0").groupBy(*FILE, "segment").agg(
        F.min("line").alias("line"),
        F.bool_or(F.col("s").rlike(r"(?i)^limits\s*:")).alias("limits"),
        F.bool_or("head").alias("closed"),
    )
    rows = by_segment.where("not limits and not closed").withColumn("evidence", F.lit("No resources.limits found for container"))
    return as_findings(rows.select("*", _rule("k8s-resource-limits-missing").alias("r")).select("*", "r.*"), "configuration")


def run_block_flag(lines: DataFrame) -> DataFrame:
    """Add ``in_run``: the line belongs to a ``run:`` block (the key's own line too).

    A block ends at the first later line, neither blank nor a comment, that is indented no more than its key. So a line is
    in a block if the last line so far that opened or ended one opened it: one order of a file's lines tells all, and
    lines are sorted once, without what can be made from their text again.
    """
    so_far = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s, run = F.col("s"), F.col("run")
    rows = _indented(lines).withColumns({"run": s.rlike(r"(?i)^run\s*:"), "solid": (s != "") & ~s.startswith("#")}).drop("s")
    rows = rows.withColumns({
        "block": F.sum(run.cast("int")).over(so_far),
        "key_indent": F.last(F.when(run, F.col("indent")), ignorenulls=True).over(so_far),
    })
    ends = ~run & F.col("solid") & (F.col("indent") <= F.col("key_indent"))
    rows = rows.withColumn("open", F.last(F.when(run, True).when(ends, False), ignorenulls=True).over(so_far))
    in_run = (F.col("block") > 0) & F.coalesce("open", F.lit(True))
    return rows.select(*lines.columns, strip(F.col("text")).alias("s"), "indent", in_run.alias("in_run"))


def scan_actions(lines: DataFrame) -> DataFrame:
    rows = run_block_flag(lines)
    target = F.col("text").rlike(r"(?i)pull_request_target\s*:")
    rows = rows.withColumn("targeted", F.max(target.cast("int")).over(Window.partitionBy(*FILE)) == 1)
    s = F.col("s")
    uses = F.regexp_extract("text", r"(?i)^\s*-\s*uses\s*:\s*([^\s#]+)", 1)
    tests = [
        (uses.contains("@") & ~uses.rlike(r"@[0-9a-fA-F]{40}$"), _rule("github-action-unpinned")),
        (s.rlike(r"(?i)pull_request_target\s*:"), _rule("github-pull-request-target")),
        (F.col("targeted") & s.rlike(r"(?iU)\buses\s*:\s*actions/checkout@"), _rule("github-target-checkout")),
        ((s.rlike(r"(?iU)\brun\s*:") | F.col("in_run")) & s.rlike(r"\$\{\{\s*secrets\."), _rule("github-secrets-in-run")),
    ]
    return as_findings(_matched(rows, tests).withColumn("evidence", F.col("text")), "configuration")


def scan_configuration(files: DataFrame) -> DataFrame:
    """All configuration checks over files with ``config_kind``."""
    lines = lambda kind: explode_lines(files.where(F.col("config_kind") == kind))
    docker, compose, k8s, actions = (lines(k) for k in ("dockerfile", "compose", "kubernetes", "actions"))
    # a Dockerfile without any line has no USER either
    bare = files.where("config_kind = 'dockerfile' and coalesce(content, '') = ''").select(*FILE, F.lit(1).alias("line"), F.lit("").alias("text"))
    parts = [
        scan_dockerfile(docker), dockerfile_missing_user(docker.select(*FILE, "line", "text").unionByName(bare)),
        scan_compose(compose), scan_kubernetes(k8s), k8s_missing_limits(k8s), scan_actions(actions),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Public token formats; ours, as the checks they stand for are known only by their behaviour.
SECRET_RULES = [
    ("github-token", "GitHub token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("aws-access-key", "AWS access key id", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("slack-token", "Slack token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google-api-key", "Google API key", r"\bAIza[A-Za-z0-9_-]{35}"),
    ("stripe-key", "Stripe secret key", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
    ("private-key", "Private key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("jwt", "JSON web token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
_NAMES = "password|passwd|secret|token|api[_-]?key|private[_-]?key|credential"
#: A quoted value given to a secret's name, and the bits a character that it must have at least.
ASSIGNMENT = r"(?i)(?:" + _NAMES + r")[A-Za-z0-9_]*[\"']?\s*[:=]\s*[\"']([^\"']{6,})[\"']"
MIN_ENTROPY = 2.5
#: Texts of which every match of a rule's pattern holds one, found without trying the pattern at each place.
SIGNS = {
    "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "aws-access-key": ("AKIA", "ASIA"), "slack-token": ("xox",), "google-api-key": ("AIza",),
    "stripe-key": ("k_live_",), "private-key": ("PRIVATE KEY-----",), "jwt": ("eyJ",),
}


def _may_hold(text: Column, name: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(sign) for sign in SIGNS[name]])


def _may_assign(text: Column) -> Column:
    """The text has a quote and a sign of assignment, without which no value is given to a name."""
    return (text.contains("=") | text.contains(":")) & (text.contains('"') | text.contains("'"))


def scan_secrets(lines: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Provider tokens (high), and quoted values of secret names (medium) that are no placeholders.

    A pattern is only tried on lines with a sign of it, and what is found is a column of its own: tokens are bits, and a
    value is taken once, where there is no token. The evidence is the line with the values replaced; a line with a
    provider's token has no generic finding. Null lines have none either.
    """
    text, tokens, value, evidence = F.col("text"), F.col("__tokens"), F.col("__value"), F.col("evidence")
    rules = [rule_struct(name, title, "CRITICAL" if name == "private-key" else "HIGH", "CWE-798", "high", i) for i, (name, title, _) in enumerate(SECRET_RULES)]
    generic = rule_struct("secret", "Possible hard-coded secret", "HIGH", "CWE-798", "medium", len(SECRET_RULES))
    bits = [F.when(_may_hold(text, name) & text.rlike(pattern), 1 << i).otherwise(0) for i, (name, _, pattern) in enumerate(SECRET_RULES)]
    rows = lines.withColumn("__tokens", reduce(lambda a, b: a + b, bits))
    rows = rows.withColumn("__value", F.when((tokens == 0) & _may_assign(text), F.regexp_extract(text, ASSIGNMENT, 1)))
    several = F.array_compact(F.array(*[F.when(tokens.bitwiseAND(1 << i) != 0, rule) for i, rule in enumerate(rules)]))
    known = F.coalesce(*[F.when(tokens == 1 << i, F.array(rule)) for i, rule in enumerate(rules)], several)
    assigned = (value != "") & ~is_placeholder(value) & (shannon_entropy(value) >= MIN_ENTROPY)
    hits = rows.select(*lines.columns, F.explode(F.when(tokens > 0, known).when(assigned, F.array(generic))).alias("rule"))
    hits = hits.select(*lines.columns, "rule.*").withColumn("evidence", text)
    for name, _, pattern in SECRET_RULES:
        hits = hits.withColumn("evidence", F.when(_may_hold(evidence, name), F.regexp_replace(evidence, pattern, "[REDACTED]")).otherwise(evidence))
    hidden = F.regexp_replace(evidence, r"(?i)((?:" + _NAMES + r")[A-Za-z0-9_]*[\"']?\s*[:=]\s*[\"'])[^\"']{6,}([\"'])", "$1[REDACTED]$2")
    return as_findings(hits.withColumn("evidence", F.when(_may_assign(evidence), hidden).otherwise(evidence)), "secrets", *keys)


def scan_secret_history(patches: DataFrame) -> DataFrame:
    """Secrets in added lines of ``patches(project_id, commit, path, line, text)``; findings carry the commit."""
    return scan_secrets(patches.withColumnRenamed("path", "rel_path"), ("project_id", "commit"))


#: Headers a response must have.
REQUIRED_HEADERS = ["content-security-policy", "strict-transport-security", "x-content-type-options", "referrer-policy"]


def missing_security_headers(responses: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Add ``missing``: required headers that a response lacks, whatever the case of its names."""
    have = F.transform(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))), F.lower)
    return responses.withColumn("missing", F.array_except(F.array(*[F.lit(h) for h in required or REQUIRED_HEADERS]), have))

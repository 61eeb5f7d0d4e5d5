"""Lifecycle, workflow, policy, remediation and roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions.scalars import fp_asset, fp_lifecycle, redact, risk_score, service_indicator
from lintlake.operators import detect, flows
from lintlake.operators.pages import PAGE_VALUES, in_pages
from lintlake.sources.files import is_ignored

CLOSED = ("resolved", "false-positive")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """Add the lifecycle ``fingerprint``."""
    return findings.withColumn("fingerprint", fp_lifecycle(F.col("rule_id"), F.col("cwe"), F.col("file"), F.col("evidence")))


# -- lifecycle ---------------------------------------------------------------------------------------------------


def update_lifecycle(findings: DataFrame, history: DataFrame, now: Column, order: list[str] | None = None) -> DataFrame:
    """History after a scan: full outer join on (project_id, fingerprint).

    Of a scan's findings with one fingerprint the last in ``order`` gives the record. A fixed record found again
    is reappeared, one not found is fixed, and an accepted risk not found is dropped.
    """
    order = order or ["engine_rank", "file", "line", "rule_rank"]
    fields = ["rule_id", "file", "line", "title", "severity"]
    seen = with_fingerprint(findings).groupBy("project_id", "fingerprint").agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("new"), F.max(F.lit(True)).alias("found")
    )
    old = history.withColumn("old", F.struct(*[c for c in history.columns if c not in ("project_id", "fingerprint")])).select("project_id", "fingerprint", "old")
    both = seen.join(old, ["project_id", "fingerprint"], "full_outer")
    # told by a flag, so that the records need not be sought where nothing of them is asked for
    found, known = F.col("found").isNotNull(), F.col("old").isNotNull()
    kept = both.where(found | (F.coalesce(F.col("old.status"), F.lit("")) != "accepted-risk"))
    return kept.select(
        "project_id", "fingerprint",
        *[F.when(found, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fields],
        F.when(known, F.coalesce("old.first_seen", now)).otherwise(now).alias("first_seen"),
        F.when(found, now).otherwise(F.col("old.last_seen")).alias("last_seen"),
        (F.coalesce("old.times_seen", F.lit(0)) + F.when(found, 1).otherwise(0)).cast("int").alias("times_seen"),
        F.when(~found, "fixed").when(F.col("old.status") == "fixed", "reappeared").otherwise("open").alias("status"),
    )


def apply_scans(findings: DataFrame, history: DataFrame, order: list[str] | None = None) -> DataFrame:
    """History after all scans in ``findings``, told by ``scanned_at``: what ``update_lifecycle`` gives scan after scan.

    No scan is gone through by itself: where a record ends up follows from how often, when first and last, and in
    which of the project's first, last and last but one scan it was found. Projects without a finding here stay as they are.
    """
    order = order or ["engine_rank", "file", "line", "rule_rank"]
    fields = ["rule_id", "file", "line", "title", "severity"]
    found = with_fingerprint(findings).groupBy("project_id", "scanned_at", "fingerprint").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("new"))
    rank = Window.partitionBy("project_id").orderBy(F.col("scanned_at").desc())
    scans = findings.select("project_id", "scanned_at").distinct().withColumn("k", F.row_number().over(rank))
    ends = scans.groupBy("project_id").agg(
        F.min("scanned_at").alias("first_scan"), F.max("scanned_at").alias("last_scan"), F.max(F.when(F.col("k") == 2, F.col("scanned_at"))).alias("before_scan")
    )
    at = F.col("scanned_at")
    each = found.join(ends, "project_id").groupBy("project_id", "fingerprint").agg(
        F.max_by("new", at).alias("new"), F.count("*").alias("n"), F.min(at).alias("found_first"), F.max(at).alias("found_last"),
        F.bool_or(F.coalesce(at == F.col("before_scan"), F.lit(False))).alias("in_before"),
    )
    old = history.withColumn("old", F.struct(*[c for c in history.columns if c not in ("project_id", "fingerprint")])).select("project_id", "fingerprint", "old")
    both = each.join(old, ["project_id", "fingerprint"], "full_outer").join(ends, "project_id", "left")
    untouched, here = F.col("last_scan").isNull(), F.col("new").isNotNull()
    # an accepted risk that the first scan does not find is dropped, and is new if a later one does
    dropped = ~untouched & (F.coalesce(F.col("old.status"), F.lit("")) == "accepted-risk") & ~F.coalesce(F.col("found_first") == F.col("first_scan"), F.lit(False))
    both = both.where(here | ~dropped).withColumn("old", F.when(~dropped, F.col("old")))
    known = F.col("old").isNotNull()
    in_last = F.coalesce(F.col("found_last") == F.col("last_scan"), F.lit(False))
    one_scan = F.col("before_scan").isNull()
    in_before = F.when(one_scan, known & (F.coalesce(F.col("old.status"), F.lit("")) != "fixed")).otherwise(F.col("in_before"))
    earlier = known | (F.col("found_first") < F.col("last_scan"))
    status = F.when(untouched, F.col("old.status")).when(~in_last, "fixed").when(~F.coalesce(in_before, F.lit(False)) & earlier, "reappeared").otherwise("open")
    return both.select(
        "project_id", "fingerprint",
        *[F.when(here, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fields],
        F.coalesce("old.first_seen", "found_first").alias("first_seen"), F.coalesce("found_last", "old.last_seen").alias("last_seen"),
        (F.coalesce("old.times_seen", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("times_seen"), status.alias("status"),
    )


def _numbered_scans(scans: DataFrame) -> DataFrame:
    """``project_id, scan_no, k``: the scans of each project, from 1."""
    return scans.select("project_id", "scan_no").distinct().withColumn("k", F.row_number().over(Window.partitionBy("project_id").orderBy("scan_no")))


def lifecycle_changes(scans: DataFrame) -> DataFrame:
    """Each fingerprint's states as runs of scans, from ``(project_id, scan_no, fingerprint)``: rows grow with changes, not scans.

    ``project_id, fingerprint, first_seen, status, from_k, to_k, from_scan, to_scan, times_seen, last_seen``: the state holds
    from one scan of the project to another (by number from 1, and by ``scan_no``); ``times_seen`` is that at its first
    scan and rises by one a scan while found; ``last_seen`` is null while found. Scan numbers need not be dense, repeated
    rows count once, and a null fingerprint is one like others.
    """
    every = _numbered_scans(scans)
    seen = scans.select("project_id", "scan_no", "fingerprint").distinct().join(every, ["project_id", "scan_no"])
    one = Window.partitionBy("project_id", "fingerprint").orderBy("k")
    starts = F.coalesce((F.col("k") - F.lag("k").over(one) > 1).cast("int"), F.lit(0))
    runs = seen.withColumn("start", starts).withColumn("run", F.sum("start").over(one)).groupBy("project_id", "fingerprint", "run").agg(
        F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"), F.min("scan_no").alias("scan_a"), F.max("scan_no").alias("scan_b")
    )
    by_run = Window.partitionBy("project_id", "fingerprint").orderBy("run")
    ends = every.groupBy("project_id").agg(F.max("k").alias("end"))
    runs = runs.withColumns({
        "before": F.sum("n").over(by_run) - F.col("n"), "next": F.lead("a").over(by_run),
        "first_seen": F.min("scan_a").over(by_run),
    }).join(ends, "project_id")
    row = lambda status, a, b, times, last: F.struct(F.lit(status).alias("status"), a.cast("int").alias("from_k"), b.cast("int").alias("to_k"), times.alias("times_seen"), last.alias("last_seen"))
    c, none = F.col, F.lit(None).cast(scans.schema["scan_no"].dataType)
    first, gone = c("run") == 0, F.coalesce(c("next") - 1, c("end"))
    states = F.array_compact(F.array(
        F.when(~first, row("reappeared", c("a"), c("a"), c("before") + 1, none)),
        F.when(first | (c("b") > c("a")), row("open", F.when(first, c("a")).otherwise(c("a") + 1), c("b"), F.when(first, F.lit(1)).otherwise(c("before") + 2), none)),
        F.when(gone > c("b"), row("fixed", c("b") + 1, gone, c("before") + c("n"), c("scan_b"))),
    ))
    told = runs.select("project_id", "fingerprint", "first_seen", F.explode(states).alias("s")).select("project_id", "fingerprint", "first_seen", "s.*")
    for name in ("from", "to"):
        told = told.join(every.select("project_id", F.col("k").alias(f"{name}_k"), F.col("scan_no").alias(f"{name}_scan")), ["project_id", f"{name}_k"])
    return told.select("project_id", "fingerprint", "first_seen", "status", "from_k", "to_k", "from_scan", "to_scan", "times_seen", "last_seen")


def replay_lifecycle(scans: DataFrame) -> DataFrame:
    """State of every fingerprint after each of its project's scans, from its first on: ``lifecycle_changes`` written out."""
    each = lifecycle_changes(scans).withColumn("k", F.explode(F.sequence("from_k", "to_k"))).join(_numbered_scans(scans), ["project_id", "k"])
    found = F.col("last_seen").isNull()
    return each.select(
        "project_id", "scan_no", "fingerprint", "first_seen", F.when(found, F.col("scan_no")).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.col("times_seen") + F.when(found, F.col("k") - F.col("from_k")).otherwise(0)).cast("long").alias("times_seen"), "status",
    )


def lifecycle_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("project_id", "status").agg(F.count("*").alias("n"))


def attach_fingerprint(findings: DataFrame, history: DataFrame, order: str = "last_seen") -> DataFrame:
    """Add ``fingerprint`` by (rule_id, file, line) from the history's last such record, '' if there is none."""
    keys = ["project_id", "rule_id", "file", "line"]
    last = history.groupBy(*keys).agg(F.max_by("fingerprint", F.struct(order, "fingerprint")).alias("fingerprint"))
    return findings.join(last, keys, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))


# -- workflow ----------------------------------------------------------------------------------------------------


def enrich_workflow(findings: DataFrame, workflow: DataFrame, today: Column) -> DataFrame:
    """Add ``risk`` and ``workflow`` to findings that have a ``fingerprint``."""
    record = workflow.select(
        "project_id", "fingerprint",
        F.struct("state", "owner", "due_date", "expires_at", "decision", "updated_at").alias("record"),
    )
    joined = findings.join(record, ["project_id", "fingerprint"], "left")
    state = F.coalesce("record.state", F.lit("open"))
    overdue = F.coalesce((F.col("record.due_date") < today) & ~state.isin(*CLOSED), F.lit(False))
    expired = F.coalesce((F.col("record.expires_at") < today) & (state == "accepted-risk"), F.lit(False))
    reopened = state.isin(*CLOSED)
    return joined.select(
        *findings.columns,
        risk_score(F.col("severity"), F.col("confidence")).alias("risk"),
        F.struct(
            state.alias("state"), F.when(reopened, "reopened").otherwise(state).alias("effective_state"),
            *[F.col(f"record.{c}").alias(c) for c in ("owner", "due_date", "expires_at", "decision", "updated_at")],
            overdue.alias("overdue"), expired.alias("expired"), (overdue | expired | reopened).alias("attention_required"),
        ).alias("workflow"),
    )


def risk_summary(enriched: DataFrame) -> DataFrame:
    """Per project: total score, findings of each priority, findings that need attention."""
    by = enriched.groupBy("project_id", F.col("risk.priority").alias("priority")).agg(
        F.count("*").alias("n"), F.sum("risk.score").alias("score"), F.sum(F.col("workflow.attention_required").cast("long")).alias("attention")
    )
    return by.groupBy("project_id").agg(
        F.round(F.sum("score"), 2).alias("total_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "n")))).alias("priority_counts"),
        F.sum("attention").alias("attention_required"),
    )


def governance_summary(workflow: DataFrame, findings: DataFrame, today: Column) -> DataFrame:
    """Per project: records of each state, overdue, expired and unowned ones, tracked records, observed findings."""
    state = F.coalesce("state", F.lit("open"))
    rows = workflow.withColumn("state", state)
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    by = rows.groupBy("project_id", "state").agg(
        F.count("*").alias("n"),
        flag((F.col("due_date") < today) & ~F.col("state").isin(*CLOSED)).alias("overdue"),
        flag((F.col("expires_at") < today) & (F.col("state") == "accepted-risk")).alias("expired"),
        flag((F.coalesce("owner", F.lit("")) == "") & ~F.col("state").isin(*CLOSED)).alias("unowned"),
    )
    sums = by.groupBy("project_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("state_counts"),
        F.sum("overdue").alias("overdue"), F.sum("expired").alias("expired_accepted_risks"),
        F.sum("unowned").alias("unowned_open"), F.sum("n").alias("tracked"),
    )
    seen = findings.groupBy("project_id").agg(F.count("*").alias("observed_findings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.create_map().cast("map<string,bigint>")
    return sums.join(seen, "project_id", "full_outer").select(
        "project_id", F.coalesce("state_counts", none).alias("state_counts"),
        *[zero(c) for c in ("overdue", "expired_accepted_risks", "unowned_open", "tracked", "observed_findings")],
    )


def check_actions(actions: DataFrame) -> DataFrame:
    """Add ``problem`` (null if valid) to ``actions(project_id, fingerprint, state, rationale, expires_at, ...)``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    state = F.coalesce("state", F.lit("open"))
    return actions.withColumn("state", state).withColumn(
        "problem",
        F.when(blank("fingerprint"), "fingerprint is required")
        .when(~F.col("state").isin(*K.WORKFLOW_STATES), "state must be one of: " + ", ".join(sorted(K.WORKFLOW_STATES)))
        .when(F.col("state").isin("accepted-risk", "false-positive") & blank("rationale"), "rationale is required for accepted-risk or false-positive decisions")
        .when((F.col("state") == "accepted-risk") & blank("expires_at"), "expires_at is required for accepted-risk decisions"),
    )


def apply_finding_actions(workflow: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The workflow after valid actions (the last by ``ts`` wins, created_at stays), and the invalid actions."""
    checked = check_actions(actions)
    fields = ["state", "owner", "due_date", "decision", "rationale", "expires_at"]
    new = checked.where("problem is null").select("project_id", "fingerprint", *fields, F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))
    every = workflow.select("project_id", "fingerprint", *fields, "updated_at", "created_at").unionByName(new)
    done = every.groupBy("project_id", "fingerprint").agg(
        F.max_by(F.struct(*fields, "updated_at"), F.struct("updated_at", *fields)).alias("last"), F.min("created_at").alias("created_at")
    )
    return done.select("project_id", "fingerprint", "last.*", "created_at"), checked.where("problem is not null")


# -- policy ------------------------------------------------------------------------------------------------------


def normalize_policy(policies: DataFrame) -> DataFrame:
    """Upper-case levels, defaults for nulls, ignored ids once each in order; an unknown level is an error."""

    def level(name: str, allowed: list[str], default: str) -> Column:
        value = F.upper(F.coalesce(name, F.lit(default)))
        return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.lit(f"{name} must be one of {', '.join(allowed)}"))).alias(name)

    return policies.select(
        "project_id",
        level("max_severity", K.SEVERITIES, "CRITICAL"),
        level("minimum_confidence", K.CONFIDENCES, "LOW"),
        F.array_distinct(F.coalesce("ignored_rule_ids", F.array().cast("array<string>"))).alias("ignored_rule_ids"),
    )


def blocked_findings(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings that their project's policy blocks, with ``reason``; a project without a policy has the default one."""
    named = normalize_policy(policies)
    sev, conf = F.array(*[F.lit(x) for x in K.SEVERITIES]), F.array(*[F.lit(x) for x in K.CONFIDENCES])
    joined = findings.join(named, "project_id", "left").select(
        *[findings[c] for c in findings.columns],
        F.coalesce("max_severity", F.lit("CRITICAL")).alias("max_severity"),
        F.coalesce("minimum_confidence", F.lit("LOW")).alias("minimum_confidence"),
        F.coalesce("ignored_rule_ids", F.array().cast("array<string>")).alias("ignored_rule_ids"),
        F.upper(F.coalesce("severity", F.lit("INFO"))).alias("__s"), F.upper(F.coalesce("confidence", F.lit("LOW"))).alias("__c"),
    )
    at = lambda levels, c: F.array_position(levels, F.col(c))
    hit = joined.where(
        ~F.array_contains("ignored_rule_ids", F.coalesce("rule_id", F.lit("")))
        & (at(sev, "__s") > 0) & (at(conf, "__c") > 0)
        & (at(sev, "__s") <= at(sev, "max_severity")) & (at(conf, "__c") <= at(conf, "minimum_confidence"))
    )
    return hit.withColumn(
        "reason",
        F.format_string("%s (%s, %s confidence) meets the %s severity and %s confidence gate", "rule_id", "__s", "__c", "max_severity", "minimum_confidence"),
    ).drop("__s", "__c", "max_severity", "minimum_confidence", "ignored_rule_ids")


def policy_verdicts(blocked: DataFrame, projects: DataFrame) -> DataFrame:
    """``project_id, passed, n_blocked`` for every project."""
    n = blocked.groupBy("project_id").agg(F.count("*").alias("n_blocked"))
    return projects.select("project_id").distinct().join(n, "project_id", "left").select(
        "project_id", F.col("n_blocked").isNull().alias("passed"), F.coalesce("n_blocked", F.lit(0)).cast("long").alias("n_blocked")
    )


def evaluate_policy(findings: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocked findings and the verdict of each project that has findings or a policy."""
    blocked = blocked_findings(findings, policies)
    projects = findings.select("project_id").union(policies.select("project_id"))
    return blocked, policy_verdicts(blocked, projects)


# -- remediation -------------------------------------------------------------------------------------------------


def remediation_records(findings: DataFrame, now: Column) -> DataFrame:
    advice = redact(F.when(F.coalesce("remediation", F.lit("")) == "", F.lit(K.DEFAULT_ADVICE)).otherwise(F.col("remediation")))
    return findings.select(
        "project_id",
        fp_asset(F.col("rule_id"), F.col("file"), F.col("line"), F.col("evidence")).alias("fingerprint"),
        F.struct("rule_id", "title", "severity", "file", "line").alias("finding"),
        advice.alias("recommendation"),
        redact(F.concat(F.lit("Manual review at "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("; proposed change: "), advice)).alias("patch_preview"),
        F.lit(True).alias("approval_required"),
        F.lit("proposed").alias("status"),
        now.alias("created_at"), now.alias("updated_at"),
        F.lit(None).cast("struct<status:string,verified_at:timestamp,finding_present:boolean>").alias("verification"),
        F.array(F.struct(F.lit("proposed").alias("status"), now.alias("at"))).alias("history"),
    )


def merge_remediation(old: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Old records keep what was decided; finding, recommendation and preview come from the fresh plan.

    Records meet as plain columns, not as whole structs, so that only those that are asked for are made and dealt.
    """
    key = ["project_id", "fingerprint"]
    cols = [c for c in fresh.columns if c not in key]
    a = old.select(*key, F.lit(True).alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    # findings that share a fingerprint are one record
    least = Window.partitionBy(*key).orderBy(F.to_json(F.struct("finding")))
    one = fresh.withColumn("__n", F.row_number().over(least)).where("__n = 1")
    b = one.select(*key, F.lit(True).alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = a.join(b, key, "full_outer")
    renewed = ("finding", "recommendation", "patch_preview")
    out = []
    for c in cols:
        if c in renewed:
            out.append(F.coalesce(f"b_{c}", f"a_{c}").alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), now).when(F.col("a").isNotNull(), F.col("a_updated_at")).otherwise(F.col("b_updated_at")).alias(c))
        else:
            out.append(F.when(F.col("a").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c))
    return both.select(*key, *out)


def _stamped(status: Column, now: Column) -> Column:
    return F.array_append("history", F.struct(status.alias("status"), now.alias("at")))


def verify_remediation(plan: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """Records whose finding is gone are verified, the others reappeared."""
    here = findings.select(
        "project_id", fp_asset(F.col("rule_id"), F.col("file"), F.col("line"), F.col("evidence")).alias("fingerprint")
    ).distinct().withColumn("__here", F.lit(True))
    joined = plan.join(here, ["project_id", "fingerprint"], "left").withColumn("__here", F.coalesce("__here", F.lit(False)))
    status = F.when(F.col("__here"), "reappeared").otherwise("verified")
    return joined.withColumns(
        {
            "history": _stamped(status, now), "status": status, "updated_at": now,
            "verification": F.struct(status.alias("status"), now.alias("verified_at"), F.col("__here").alias("finding_present")),
        }
    ).select(*plan.columns)


def approve_remediation(plan: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """Approve the records named in ``approvals(project_id, fingerprint)``; an unknown one is an error."""
    named = approvals.select("project_id", "fingerprint").distinct().withColumn("__ok", F.lit(True))
    joined = plan.withColumn("__plan", F.lit(True)).join(named, ["project_id", "fingerprint"], "full_outer")
    known = F.when(F.col("__plan").isNull(), F.raise_error(F.concat(F.lit("no such finding in the plan: "), "fingerprint")).cast("string")).otherwise(F.col("fingerprint"))
    ok = F.coalesce("__ok", F.lit(False))
    return joined.withColumn("fingerprint", known).withColumns(
        {
            "history": F.when(ok, _stamped(F.lit("approved"), now)).otherwise(F.col("history")),
            "status": F.when(ok, "approved").otherwise(F.col("status")),
            "updated_at": F.when(ok, now).otherwise(F.col("updated_at")),
        }
    ).select(*plan.columns)


def remediation_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("project_id", "status").agg(F.count("*").alias("n"))


# -- roll-ups ----------------------------------------------------------------------------------------------------


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``outcome`` (ignored, skipped, analyzed), ``reason`` and ``language``."""
    name = F.lower("name")
    known = F.col("suffix").isin(*K.SCAN_SUFFIXES) | (name == "dockerfile") | name.startswith("dockerfile.")
    reason = F.when(F.col("size").isNull(), "unreadable metadata").when(F.col("size") > K.MAX_BYTES, "file exceeds 2 MB limit").when(~known, "unsupported file type")
    out = files.withColumn("reason", F.when(~is_ignored(F.col("parts")), reason))
    out = out.withColumn("outcome", F.when(is_ignored(F.col("parts")), "ignored").when(F.col("reason").isNotNull(), "skipped").otherwise("analyzed"))
    return out.withColumn("language", F.when(F.col("outcome") == "analyzed", F.when(F.col("suffix") == "", "<no extension>").otherwise(F.col("suffix"))))


def known_rules() -> list[str]:
    """Ids of all rules that a scan of files runs: line, configuration, secret and flow rules."""
    return [r[0] for r in (*K.LINE_RULES, *K.CONFIG_RULES, *detect.SECRET_RULES)] + ["secret", *flows.FLOW_RULES]


def scan_coverage(files: DataFrame, rules_executed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts per project, files per project and language, skipped files with their reason."""
    rows = classify_files(files)
    flow = F.col("suffix").isin(*K.FLOW_SUFFIXES, ".java") & (F.col("outcome") == "analyzed")
    n = len(known_rules()) if rules_executed is None else rules_executed
    counts = rows.groupBy("project_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"files_{o}") for o in ("analyzed", "skipped", "ignored")],
        F.bool_or(flow).alias("flow_engines"), F.lit(n).alias("rules_executed"),
    )
    languages = rows.where("outcome = 'analyzed'").groupBy("project_id", "language").agg(F.count("*").alias("n_files"))
    return counts, languages, rows.where("outcome = 'skipped'").select("project_id", "rel_path", "reason")


def finding_quality(findings: DataFrame) -> DataFrame:
    level = F.lower("confidence")
    n = lambda name: F.count_if(level == name)
    return findings.groupBy("project_id").agg(
        n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"),
        (n("medium") + n("low")).alias("review_required"),
        F.when(n("high") > 0, "Some findings have a modeled path from source to sink.").otherwise("No finding has a modeled path from source to sink.").alias("interpretation"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", F.upper(F.coalesce("severity", F.lit("INFO"))).alias("severity")).agg(F.count("*").alias("n"))


def inventory_assets(files: DataFrame) -> DataFrame:
    """Long form ``project_id, class, rel_path``; a file may be in several classes."""
    name = F.lower("name")
    yaml = name.endswith(".yaml") | name.endswith(".yml")
    lower_parts = F.transform("parts", F.lower)
    k8s = yaml & (F.array_contains(lower_parts, "k8s") | F.array_contains(lower_parts, "kubernetes") | F.lower("content").contains("kind:"))
    config = name.isin(*K.CONFIG_NAMES) | name.startswith(".env.") | F.col("suffix").isin(*K.CONFIG_SUFFIXES)
    tests = {
        "source": F.col("suffix").isin(*K.SOURCE_SUFFIXES), "configuration": config,
        "docker": (name == "dockerfile") | name.startswith("dockerfile."), "kubernetes": k8s,
        "actions": F.array_contains("parts", ".github") & F.array_contains("parts", "workflows"),
    }
    classes = F.array_compact(F.array(*[F.when(test, F.lit(c)) for c, test in tests.items()]))
    return files.where(~is_ignored(F.col("parts"))).select("project_id", F.explode(classes).alias("class"), "rel_path")


def inventory_lists(assets: DataFrame) -> DataFrame:
    """Sorted path lists by project and class, for a report."""
    return assets.groupBy("project_id", "class").agg(F.array_sort(F.collect_list("rel_path")).alias("paths"))


def inventory_pages(assets: DataFrame, page_values: int = PAGE_VALUES) -> DataFrame:
    """The lists of ``inventory_lists`` in pages: ``project_id, class, page, paths, n_before``."""
    return in_pages(assets, ["project_id", "class"], "rel_path", page_values).withColumnRenamed("values", "paths")


def service_indicators(findings: DataFrame) -> DataFrame:
    return findings.where(service_indicator(F.col("title"), F.col("evidence"))).select(
        "project_id", fp_asset(F.col("rule_id"), F.col("file"), F.col("line"), F.col("evidence")).alias("fingerprint"), "file", "rule_id", "evidence"
    )


def scan_summary(findings: DataFrame, history: DataFrame, verdicts: DataFrame, scan_id: Column, scanned_at: Column) -> DataFrame:
    """One row for each project: counts, fingerprints, new, fixed and reappeared ones, verdict."""
    counts = severity_counts(findings).groupBy("project_id").agg(
        F.sum("n").cast("int").alias("findings_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", F.col("n").cast("int"))))).alias("findings_counts")
    )
    # no list holds a null, and sort_array compares texts without a function of two values
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("fingerprint"))))
    status = F.col("status")
    lists = history.groupBy("project_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("fingerprint") != "", F.col("fingerprint")))).alias("fingerprints"),
        pick((status == "open") & (F.col("first_seen") == F.col("last_seen"))).alias("new_fingerprints"),
        pick(status == "fixed").alias("fixed_fingerprints"), pick(status == "reappeared").alias("reappeared_fingerprints"),
    )
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,int>")
    return verdicts.select("project_id", "passed").join(counts, "project_id", "left").join(lists, "project_id", "left").select(
        "project_id", scan_id.alias("scan_id"), scanned_at.alias("scanned_at"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"), F.coalesce("findings_counts", empty).alias("findings_counts"),
        *[F.coalesce(c, none).alias(c) for c in ("fingerprints", "new_fingerprints", "fixed_fingerprints", "reappeared_fingerprints")],
        F.col("passed").alias("policy_pass"),
    )


def summary_lists(history: DataFrame, page_values: int = PAGE_VALUES) -> DataFrame:
    """The fingerprint lists of ``scan_summary`` in pages: ``project_id, list, page, fingerprints, n_before``.

    ``list`` is all (without the empty one), new, fixed or reappeared; each holds a fingerprint once.
    """
    status = F.col("status")
    names = F.array_compact(F.array(
        F.when(F.col("fingerprint") != "", F.lit("all")),
        F.when((status == "open") & (F.col("first_seen") == F.col("last_seen")), F.lit("new")),
        F.when(status.isin("fixed", "reappeared"), status),
    ))
    rows = history.select("project_id", F.explode(names).alias("list"), "fingerprint").distinct()
    return in_pages(rows, ["project_id", "list"], "fingerprint", page_values).withColumnRenamed("values", "fingerprints")


def bounded_history(summaries: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` scans of each project, with ``last_scan`` marking the newest."""
    w = Window.partitionBy("project_id").orderBy(F.col("scanned_at").desc(), F.col("scan_id").desc())
    return summaries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).withColumn("last_scan", F.col("__n") == 1).drop("__n")


def project_trend(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "project_id", "scanned_at", F.col("findings_count").alias("findings"), "policy_pass",
        *[F.size(F.coalesce(f"{k}_fingerprints", F.array().cast("array<string>"))).alias(k) for k in ("new", "fixed", "reappeared")],
        F.count("*").over(Window.partitionBy("project_id")).alias("scan_count"),
    )


def register_scans(registry: DataFrame, summaries: DataFrame, n: int = 50) -> DataFrame:
    """The registry with new summaries appended, bounded to ``n`` scans a project."""
    return bounded_history(registry.select(*summaries.columns).unionByName(summaries), n)


def evaluate_rules(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per case: matched, missing and unexpected rules, recall to three places (1.0 if nothing is expected)."""
    e = expected.select("case_id", "rule_id").distinct().withColumn("e", F.lit(1))
    o = observed.select("case_id", "rule_id").distinct().withColumn("o", F.lit(1))
    both = e.join(o, ["case_id", "rule_id"], "full_outer")
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("rule_id"))))
    out = both.groupBy("case_id").agg(
        pick(F.col("e").isNotNull() & F.col("o").isNotNull()).alias("matched"), pick(F.col("o").isNull()).alias("missing"),
        pick(F.col("e").isNull()).alias("unexpected"), F.count("e").alias("n_expected"),
    )
    return out.withColumn("recall", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.round(F.size("matched") / F.col("n_expected"), 3)))


def duration_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("case_id").agg(F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.median("seconds"), 6).alias("median_seconds"))

"""Column functions of the findings library: fingerprints, scores, flags, redaction, dates, advisories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions import catalog as K


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def fp_lifecycle(rule_id: Column, cwe: Column, rel_path: Column, evidence: Column) -> Column:
    """20 hex digits over rule, CWE, file within the project and evidence; the line is not part of it."""
    blank = [F.coalesce(c, F.lit("")) for c in (rule_id, cwe, rel_path, evidence)]
    return F.substring(F.sha2(F.concat_ws("\n", *blank), 256), 1, 20)


def fp_sarif(rule_id: Column, file: Column, line: Column, evidence: Column) -> Column:
    blank = [F.coalesce(c.cast("string"), F.lit("")) for c in (rule_id, file, line, evidence)]
    return F.sha2(F.concat_ws("|", *blank), 256)


def fp_asset(rule_id: Column, file: Column, line: Column, evidence: Column) -> Column:
    return F.substring(fp_sarif(rule_id, file, line, evidence), 1, 16)


def project_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 20)


def scan_id(root: Column, at: Column) -> Column:
    return F.concat(F.lit("scan-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha2(root, 256), 1, 8))


def risk_score(severity: Column, confidence: Column) -> Column:
    """struct(score, priority, severity_points, confidence_multiplier)."""
    points = F.coalesce(F.try_element_at(literal_map(K.SEVERITY_POINTS), F.upper(F.coalesce(severity, F.lit("INFO")))), F.lit(0))
    weight = F.coalesce(F.try_element_at(literal_map(K.CONFIDENCE_WEIGHTS), F.upper(F.coalesce(confidence, F.lit("LOW")))), F.lit(0.5))
    score = F.round(points * weight, 2)
    priority = (
        F.when(score >= 8, "urgent").when(score >= 5, "high").when(score >= 2, "normal").otherwise("informational")
    )
    return F.struct(
        score.alias("score"), priority.alias("priority"), points.alias("severity_points"), weight.alias("confidence_multiplier")
    )


def redact(text: Column) -> Column:
    return F.regexp_replace(text, K.REDACT, "$1=<redacted>")


def is_placeholder(value: Column) -> Column:
    return F.trim(value, F.lit("\"'")).rlike(K.PLACEHOLDER)


def rule_family(rule_id: Column) -> Column:
    return F.substring_index(F.lower(rule_id), "-", 1)


def overlap_family(rule_id: Column, title: Column) -> Column:
    """Bit mask of the term families that occur in rule id or title; the text is put together once, not for each term."""

    def mask(text: Column) -> Column:
        bits = [
            F.when(reduce(lambda a, b: a | b, [text.contains(t) for t in terms]), 1 << i).otherwise(0)
            for i, terms in enumerate(K.OVERLAP_FAMILIES)
        ]
        return reduce(lambda a, b: a + b, bits)

    return F.transform(F.array(F.lower(F.concat_ws(" ", rule_id, title))), mask)[0]


def has_source(evidence: Column) -> Column:
    return evidence.rlike("(?U)" + K.SOURCE_TERMS)


def has_sink(evidence: Column) -> Column:
    return evidence.rlike("(?U)" + K.SINK_TERMS)


def is_config_file(file: Column) -> Column:
    return file.rlike(K.CONFIG_FILES)


def confidence_rank(confidence: Column) -> Column:
    """high 3, medium 2, low 1, else 0; case matters."""
    return F.coalesce(F.try_element_at(literal_map({"high": 3, "medium": 2, "low": 1}), confidence), F.lit(0))


def sarif_level(severity: Column) -> Column:
    s = F.upper(severity)
    return F.when(s.isin("CRITICAL", "HIGH"), "error").when(s == "LOW", "note").when(s == "INFO", "none").otherwise("warning")


def cwe_number(cwe: Column) -> Column:
    found = F.regexp_extract(F.coalesce(cwe, F.lit("")), r"(\d+)", 1)
    return F.when(found != "", found)


def help_uri(cwe: Column) -> Column:
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), cwe_number(cwe), F.lit(".html"))


def parse_workflow_date(value: Column, name: str) -> Column:
    """YYYY-MM-DD; null or empty is null, anything else an error that names the field."""
    parsed = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    bad = (F.coalesce(value, F.lit("")) != "") & parsed.isNull()
    return F.when(bad, F.raise_error(F.lit(f"{name} must use YYYY-MM-DD")).cast("date")).otherwise(parsed)


def html_escape(text: Column) -> Column:
    """& < > double and single quotes, in that order."""
    # HTML character references.
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text


def shannon_entropy(text: Column) -> Column:
    """Bits for each character; an empty text has none. Letters are counted by what is left without them."""
    letters = F.split(text, "")
    n = F.length(text)
    each = F.transform(F.array_distinct(letters), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def service_indicator(title: Column, evidence: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, evidence))
    return reduce(lambda a, b: a | b, [text.contains(t) for t in K.SERVICE_TERMS])


def advisory_severity(database_severity: Column, scores: Column) -> Column:
    """The database's level if it is a known one, else the first level word in the scores, else HIGH."""
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    stated = F.upper(database_severity)
    found = F.filter(
        F.transform(scores, lambda s: F.regexp_extract(F.upper(F.coalesce(s, F.lit(""))), "(CRITICAL|HIGH|MEDIUM|LOW)", 1)),
        lambda x: x != "",
    )
    return F.coalesce(F.when(stated.isin(*levels), stated), F.try_element_at(found, F.lit(1)), F.lit("HIGH"))


def advisory_cvss(database_cvss: Column) -> Column:
    return F.coalesce(database_cvss, F.lit("advisory-provided"))


def advisory_ranges(affected: Column) -> Column:
    """affected[].ranges[] as one list of struct(type, events)."""
    return F.flatten(
        F.transform(
            F.coalesce(affected, F.array().cast("array<struct<ranges:array<struct<type:string,events:array<map<string,string>>>>>>")),
            lambda a: F.coalesce(a["ranges"], F.array().cast("array<struct<type:string,events:array<map<string,string>>>>")),
        )
    )

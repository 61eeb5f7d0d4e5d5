"""Dependencies from manifests and lock files, and their known vulnerabilities."""

from __future__ import annotations

import tomllib
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.findings import ENGINE_ORDER
from lintlake.sources.files import explode_lines

FIELDS = ("project_id", "package", "version", "source", "ecosystem", "lockfile")


def _named(files: DataFrame, *names: str) -> DataFrame:
    """Files of these names in the project's root folder."""
    return files.where(F.col("rel_path").isin(*names))


def _rows(df: DataFrame, package: Column, version: Column, ecosystem: str, lockfile: bool, ord: Column) -> DataFrame:
    return df.select(
        "project_id", package.alias("package"), version.cast("string").alias("version"), F.col("rel_path").alias("source"),
        F.lit(ecosystem).alias("ecosystem"), F.lit(lockfile).alias("lockfile"), ord.cast("long").alias("ord"),
    )


def deps_package_json(files: DataFrame) -> DataFrame:
    """Both dependency maps; unreadable JSON gives no rows."""
    doc = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    base = _named(files, "package.json").withColumn("doc", doc)
    parts = [
        _rows(base.select("project_id", "rel_path", F.posexplode(f"doc.{group}").alias("pos", "key", "value")), F.col("key"), F.col("value"), "npm", False, F.col("pos") + 1_000_000 * i)
        for i, group in enumerate(("dependencies", "devDependencies"))
    ]
    return parts[0].unionByName(parts[1])


def deps_npm_lock(files: DataFrame) -> DataFrame:
    """Entries of ``packages`` that have a name and a version; of ``dependencies`` where packages is empty."""
    kind = "map<string,struct<name:string,version:string>>"
    doc = F.from_json("content", f"packages {kind}, dependencies {kind}")
    base = _named(files, "package-lock.json", "npm-shrinkwrap.json").withColumn("doc", doc)
    packed = base.select("project_id", "rel_path", F.posexplode("doc.packages").alias("pos", "key", "value"))
    old = base.where("coalesce(size(doc.packages), 0) <= 0").select("project_id", "rel_path", F.posexplode("doc.dependencies").alias("pos", "key", "value"))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    one = packed.where(full(F.col("value.name")) & full(F.col("value.version")))
    two = old.where(full(F.col("value.version")))
    return _rows(one, F.col("value.name"), F.col("value.version"), "npm", True, F.col("pos")).unionByName(
        _rows(two, F.col("key"), F.col("value.version"), "npm", True, F.col("pos"))
    )


def deps_requirements(files: DataFrame) -> DataFrame:
    """Lines ``name==version`` (or >=, ~=), up to a space or semicolon."""
    lines = explode_lines(_named(files, "requirements.txt"), "project_id", "rel_path")
    pattern = r"^\s*([A-Za-z0-9_.-]+)\s*(?:==|>=|~=)\s*([^\s;]+)"
    hit = lines.where(F.col("text").rlike(pattern))
    return _rows(hit, F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2), "PyPI", False, F.col("line"))


def deps_pipfile_lock(files: DataFrame) -> DataFrame:
    kind = "map<string,struct<version:string>>"
    base = _named(files, "Pipfile.lock").withColumn("doc", F.from_json("content", f"default {kind}, develop {kind}"))
    parts = []
    for i, section in enumerate(("default", "develop")):
        each = base.select("project_id", "rel_path", F.posexplode(f"doc.{section}").alias("pos", "key", "value"))
        each = each.withColumn("v", F.regexp_replace(F.coalesce("value.version", F.lit("")), "^=+", "")).where("v <> ''")
        parts.append(_rows(each, F.col("key"), F.col("v"), "PyPI", True, F.col("pos") + 1_000_000 * i))
    return parts[0].unionByName(parts[1])


def _parsed(files: DataFrame, read, ecosystem: str, lockfile: bool) -> DataFrame:
    """Rows of ``read(text) -> [(package, version)]``, a helper for formats that have no DataFrame reader."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [
                (p, s, name, version, ecosystem, lockfile, k)
                for p, s, text in zip(frame["project_id"], frame["rel_path"], frame["content"])
                for k, (name, version) in enumerate(read(text or ""))
            ]
            yield pd.DataFrame(found, columns=[*FIELDS[:1], "source", "package", "version", "ecosystem", "lockfile", "ord"])

    schema = "project_id string, source string, package string, version string, ecosystem string, lockfile boolean, ord long"
    return files.select("project_id", "rel_path", "content").mapInPandas(run, schema)


def _toml_packages(text: str) -> list[tuple[str, str]]:
    try:
        listed = tomllib.loads(text).get("package", [])
    except tomllib.TOMLDecodeError:
        return []
    return [(p["name"], str(p["version"])) for p in listed if isinstance(p, dict) and p.get("name") and p.get("version")]


def _xml_dependencies(text: str) -> list[tuple[str, str]]:
    try:
        root = ElementTree.fromstring(text.encode())
    except ElementTree.ParseError:
        return []
    found = []
    for node in root.iter():
        if node is not root and isinstance(node.tag, str) and node.tag.rpartition("}")[2] == "dependency":
            got = {c.tag.rpartition("}")[2]: c.text for c in reversed(node) if isinstance(c.tag, str)}
            group, name, version = (got.get(k) for k in ("groupId", "artifactId", "version"))
            if group and name and version and "${" not in version:
                found.append((f"{group}:{name}", version.strip()))
    return found


def deps_poetry_lock(files: DataFrame) -> DataFrame:
    return _parsed(_named(files, "poetry.lock"), _toml_packages, "PyPI", True)


def deps_pom(files: DataFrame) -> DataFrame:
    """``dependency`` elements at any depth and in any namespace; versions given by a property are left out."""
    return _parsed(_named(files, "pom.xml"), _xml_dependencies, "Maven", False)


def deps_gradle(files: DataFrame) -> DataFrame:
    """Literals ``group:name:version`` of five configurations."""
    pattern = r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*[\s(]?\s*[\"']([^:\"']+):([^:\"']+):([^\"']+)[\"']"
    base = _named(files, "build.gradle", "build.gradle.kts")
    groups = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "g"), (2, "n"), (3, "v"))])
    each = base.select("project_id", "rel_path", F.posexplode(groups).alias("pos", "x"))
    return _rows(each, F.concat_ws(":", "x.g", "x.n"), F.col("x.v"), "Maven", False, F.col("pos"))


READERS = [deps_package_json, deps_npm_lock, deps_requirements, deps_pipfile_lock, deps_poetry_lock, deps_pom, deps_gradle]


def dependencies(files: DataFrame) -> DataFrame:
    """All manifests, unique by (project, package, version, source); the last of equals stays."""
    parts = [f(files).withColumn("reader", F.lit(i)) for i, f in enumerate(READERS)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("project_id", "package", "version", "source").agg(
        F.max_by(F.struct("ecosystem", "lockfile", "reader", "ord"), F.struct("reader", "ord")).alias("last")
    ).select("project_id", "package", "version", "source", "last.*")


def dependency_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings for advisories on exactly a project's package and version; the first source of a package counts.

    ``advisories(package, version, id, summary, severity, cvss)``; those without an id are left out.
    """
    first = deps.groupBy("project_id", "package", "version").agg(
        F.min_by(F.struct("source", "ecosystem"), F.struct("reader", "ord", "source")).alias("at")
        if "reader" in deps.columns
        else F.min(F.struct("source", "ecosystem")).alias("at")
    )
    usable = advisories.where("coalesce(id, '') <> ''").select(
        F.col("package").alias("a_package"), F.col("version").alias("a_version"), "id", "summary", "severity", "cvss"
    )
    hit = first.join(usable, (F.col("package") == F.col("a_package")) & (F.col("version") == F.col("a_version")))
    fill = lambda c, d: F.when(F.coalesce(c, F.lit("")) == "", d).otherwise(c)
    return hit.select(
        "project_id",
        F.lit("dependencies").alias("engine_id"),
        F.lit(ENGINE_ORDER.index("dependencies")).alias("engine_rank"),
        F.lit(0).alias("rule_rank"),
        F.lit("dependency-vulnerability").alias("rule_id"),
        fill(F.col("summary"), F.concat(F.lit("Known vulnerability in "), "package")).alias("title"),
        F.coalesce("severity", F.lit("HIGH")).alias("severity"),
        F.lit("high").alias("confidence"),
        F.lit("CWE-1395").alias("cwe"),
        F.col("id").alias("cve"),
        F.coalesce("cvss", F.lit("advisory-provided")).alias("cvss"),
        F.col("at.source").alias("file"),
        F.lit(1).alias("line"),
        F.format_string("%s package %s %s matches advisory %s", F.coalesce("at.ecosystem", F.lit("unknown")), "package", "version", "id").alias("evidence"),
        F.format_string("Move %s to a version that %s does not affect.", "package", "id").alias("remediation"),
        F.lit("open").alias("status"),
    )

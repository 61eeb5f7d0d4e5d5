"""Project files and their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions.scalars import project_id

#: What ends a line besides \r\n.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\u0085  ]"


def read_project_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``project_id, path, rel_path, name, suffix, size, content`` of all files below the roots, bytes as UTF-8."""
    parts = []
    for root in roots:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
        base = root.rstrip("/")
        parts.append(
            raw.select(
                project_id(F.lit(base)).alias("project_id"),
                plain.alias("path"),
                F.when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain).alias("rel_path"),
                F.col("length").alias("size"),
                F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
            )
        )
    return with_path_parts(reduce(DataFrame.unionByName, parts))


def with_path_parts(files: DataFrame) -> DataFrame:
    """Add ``name, suffix`` (lower case; none for names like .env or a.) and ``parts`` of ``rel_path``."""
    name = F.substring_index("rel_path", "/", -1)
    return (
        files.withColumn("name", name)
        .withColumn("suffix", F.lower(F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)))
        .withColumn("parts", F.split("rel_path", "/"))
    )


def is_ignored(parts: Column) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in K.IGNORED_DIRECTORIES]))


def eligible_files(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files outside ignored directories, within the size limit and with one of the suffixes."""
    return files.where(~is_ignored(F.col("parts")) & (F.col("size") <= K.MAX_BYTES) & F.col("suffix").isin(*suffixes))


def split_lines(content: Column) -> Column:
    """Lines without their ends; an end at the very end starts no line, an empty text has none."""
    body = F.regexp_replace(content, f"(?:{LINE_END})\\z", "")
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def explode_lines(files: DataFrame, *keys: str) -> DataFrame:
    """One row for each line: the key columns, ``line`` from 1, ``text``."""
    keys = keys or ("project_id", "rel_path", "name", "suffix")
    lines = files.select(*keys, F.posexplode(split_lines(F.col("content"))).alias("pos", "text"))
    return lines.select(*keys, (F.col("pos") + 1).alias("line"), "text")


def config_kind(files: DataFrame) -> DataFrame:
    """Add ``config_kind``: dockerfile, compose, actions, kubernetes or null; the first that fits."""
    name = F.lower("name")
    return files.withColumn(
        "config_kind",
        F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile")
        .when(name.startswith("docker-compose") | name.startswith("compose"), "compose")
        .when(F.array_contains("parts", ".github") & F.array_contains("parts", "workflows"), "actions")
        .when(F.col("content").rlike(K.KUBERNETES_KIND), "kubernetes"),
    )

"""Versioned state tables in buckets of projects, of which an update writes only those that it touches.

``path/data/version=n/bucket=b`` holds the rows of bucket b as of version n, ``path/manifest/n`` says for each bucket which
version is in force, and is written last: readers go on with the version before until it is there, and an update that
failed is written over by its replay. A manifest has one row a bucket, so its size does not grow with the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.plans.lineage import remove

#: Buckets of a new table; a table keeps the number that it was made with.
BUCKETS = 64
_MANIFEST = "buckets int, columns string, bucket int, version long"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _fs(spark, path)
    return system.exists(target)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions that have not been dropped, ascending."""
    system, base = _fs(spark, f"{path}/manifest")
    if not system.exists(base):
        return []
    names = [s.getPath().getName() for s in system.listStatus(base)]
    return sorted(int(n) for n in names if n.isdigit() and _exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[int, T.StructType, dict[int, int]]:
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest/{version}").collect()
    schema = T.StructType.fromJson(json.loads(rows[0].columns))
    return rows[0].buckets, schema, {r.bucket: r.version for r in rows if r.bucket is not None}


def bucket_of(buckets: int) -> Column:
    """The bucket of a row; all rows of a project are in one, in as many files as they need."""
    return F.pmod(F.hash("project_id"), F.lit(buckets))


def _read(spark: SparkSession, path: str, schema: T.StructType, places: dict[int, int]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.schema(schema).parquet(*paths)


def read_buckets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table at a version, the newest complete one if none is named; None if there is no version yet."""
    there = versions(spark, path)
    if not there:
        return None
    _, schema, places = _manifest(spark, path, there[-1] if version is None else version)
    return _read(spark, path, schema, places)


def _commit(rows: DataFrame, path: str, version: int, buckets: int, kept: dict[int, int], touched: list[int]) -> None:
    spark = rows.sparkSession
    target = f"{path}/data/version={version}"
    # a bucket is one partition, which adaptive execution splits where a project is large
    rows.withColumn("bucket", bucket_of(buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    places = kept | {b: version for b in touched if _exists(spark, f"{target}/bucket={b}")}
    columns = rows.schema.json()
    listed = [(buckets, columns, b, v) for b, v in sorted(places.items())] or [(buckets, columns, None, None)]
    spark.createDataFrame(listed, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version}")


def write_buckets(rows: DataFrame, path: str, version: int, buckets: int = BUCKETS) -> None:
    """A version that replaces all rows."""
    _commit(rows, path, version, buckets, {}, list(range(buckets)))


def update_buckets(
    changes: DataFrame, path: str, version: int, step: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame, buckets: int = BUCKETS
) -> list[int]:
    """A version in which ``step(rows, changes)`` replaces the rows of the buckets that ``changes`` falls in; these are returned.

    ``step`` may change, add and drop rows of projects that occur in ``changes``, and must leave the others as they are.
    ``empty`` gives the columns of a table that does not exist yet. Only bucket numbers come to the driver. A version
    that exists is left as it is. Changes without rows make a version that shares all buckets with the one before.
    """
    spark = changes.sparkSession
    there = versions(spark, path)
    if version in there:
        return []
    if there:
        buckets, schema, places = _manifest(spark, path, there[-1])
    else:
        schema, places = empty.schema, {}
    touched = sorted(r.bucket for r in changes.select(bucket_of(buckets).alias("bucket")).distinct().collect())
    before = _read(spark, path, schema, {b: v for b, v in places.items() if b in touched})
    after = step(before, changes).select(*schema.names)
    _commit(after, path, version, buckets, {b: v for b, v in places.items() if b not in touched}, touched)
    return touched


def drop_before(spark: SparkSession, path: str, version: int) -> None:
    """Forget versions older than ``version``, with the bucket folders that no version from it on refers to."""
    there = versions(spark, path)
    old, kept = [v for v in there if v < version], [v for v in there if v >= version]
    if not old or not kept:
        return
    used = {place for v in kept for place in _manifest(spark, path, v)[2].items()}
    gone = {place for v in old for place in _manifest(spark, path, v)[2].items()} - used
    # manifests first: no reader is then led to a folder that is going
    for v in old:
        remove(spark, f"{path}/manifest/{v}")
    for b, v in gone:
        remove(spark, f"{path}/data/version={v}/bucket={b}")

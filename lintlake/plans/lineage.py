"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a folder of our own only where none is set on a single machine, as in tests.

    On a cluster a folder of one machine would lose what other machines write, so there the setting must be given.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lintlake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable checkpoint files and go on from them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lintlake-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: compact, and columns can be pruned.

    ``lean``, for tables near the size of the input: by zstd, and the shuffle files that made the table go once it stands.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if lean:
        with _shuffles_removed(spark):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of what runs within at its end, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of ours."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows and bytes, so that long texts do not fill a worker; a smaller setting stays."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        named = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key).lower())
        now = int(named[1]) << 10 * " kmgt".index(named[2] or " ") if named else 0
        if not 0 < now <= most:
            spark.conf.set(key, most)

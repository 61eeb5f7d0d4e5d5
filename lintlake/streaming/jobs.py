"""Structured Streaming forms of the batch transforms, by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lintlake.operators import governance
from lintlake.operators.scan import run_detectors
from lintlake.sources.buckets import drop_before, update_buckets
from lintlake.sources.state import audit_events


def scan_stream(files: DataFrame, out: str, checkpoint: str, which: list[str] | None = None) -> StreamingQuery:
    """Detectors over a stream of whole files; each batch's findings go to ``out/batch=n``, so a replay overwrites."""

    def each(batch: DataFrame, n: int) -> None:
        run_detectors(batch, which).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state_stream(rows: DataFrame, path: str, checkpoint: str, step, empty: DataFrame) -> StreamingQuery:
    """``step(state, batch) -> state`` for each batch, over the buckets of the batch's projects only.

    Batch n writes version n, so a replay does not apply twice, and a batch that failed half way leaves the version before.
    """

    def each(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            update_buckets(held, path, n, step, empty)
        finally:
            held.unpersist()
        drop_before(batch.sparkSession, path, n - 1)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HISTORY = (
    "project_id string, fingerprint string, rule_id string, file string, line int, title string, severity string,"
    " first_seen timestamp, last_seen timestamp, times_seen int, status string"
)
WORKFLOW = (
    "project_id string, fingerprint string, state string, owner string, due_date date, decision string, rationale string,"
    " expires_at date, updated_at timestamp, created_at timestamp"
)


def lifecycle_stream(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Lifecycle history kept from findings with ``scanned_at``; a batch may hold several scans, applied in their order.

    The scans of a batch are applied together, by ``apply_scans``. Batches count as they arrive: a scan that comes in a later
    batch counts as later, whatever its time. A batch costs what the buckets of its projects hold, not the whole history.
    """
    spark = findings.sparkSession

    def step(history: DataFrame, batch: DataFrame) -> DataFrame:
        return governance.apply_scans(batch, history).select(*history.columns)

    return _state_stream(findings, path, checkpoint, step, spark.createDataFrame([], HISTORY))


def actions_stream(actions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The workflow of findings kept from a stream of actions; invalid actions change nothing."""
    spark = actions.sparkSession

    def step(workflow: DataFrame, batch: DataFrame) -> DataFrame:
        return governance.apply_finding_actions(workflow, batch)[0].select(*workflow.columns)

    return _state_stream(actions, path, checkpoint, step, spark.createDataFrame([], WORKFLOW))


def registry_stream(summaries: DataFrame, path: str, checkpoint: str, n: int = 50) -> StreamingQuery:
    """The last ``n`` scans of each project, kept from a stream of scan summaries."""
    spark = summaries.sparkSession

    def step(registry: DataFrame, batch: DataFrame) -> DataFrame:
        return governance.register_scans(registry.drop("last_scan"), batch, n)

    empty = governance.bounded_history(spark.createDataFrame([], summaries.schema), n)
    return _state_stream(summaries, path, checkpoint, step, empty)


def audit_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append audit records as JSON lines."""
    return audit_events(events).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Writing results: append tables, exports and the audit/alert split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT_ACTIONS = ("block", "alert")


def append(events: DataFrame, path: str, *partition: str) -> None:
    """Append-only audit table; files of earlier writes are never touched."""
    writer = events.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def export(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Export as JSON lines or as CSV with a header."""
    if fmt not in ("json", "csv"):
        raise ValueError("fmt must be 'json' or 'csv'")
    writer = events.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("action").isin(*ALERT_ACTIONS))


def split_topics(audit_path: str, alert_path: str):
    """A ``foreachBatch`` writer: every event to the audit sink, blocking ones to the alert sink too.

    Batches are written to their own directory by batch id, so a batch that is
    replayed after a failure replaces itself instead of being appended twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")
        alerts(batch).write.mode("overwrite").parquet(f"{alert_path}/batch={batch_id}")

    return write

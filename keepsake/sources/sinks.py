"""Sinks: the tag CSV for the metadata writer and append-only audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timestamps import TAG_COLUMNS
from .manifest_csv import CSV_OPTIONS

AUDIT_COLUMNS = ["stage", "event", "path", "detail", "logged_at"]


def write_times_csv(tag_rows: DataFrame, path: str) -> None:
    """The six-column tag CSV (header, '' for empty cells) under ``path``."""
    (tag_rows.select(*TAG_COLUMNS).write.mode("errorifexists").options(**CSV_OPTIONS)
     .option("emptyValue", "").option("nullValue", "").csv(path))


def append_audit(events: DataFrame, path: str, stage: str) -> None:
    """Append one row per event (``event, path, detail``) to a parquet audit
    table; re-runs add rows, never rewrite earlier ones."""
    (events.select(F.lit(stage).alias("stage"), F.col("event").cast("string"),
                   F.col("path").cast("string"), F.col("detail").cast("string"),
                   F.current_timestamp().alias("logged_at"))
     .write.mode("append").parquet(path))


EVENT_COLUMNS = ["event", "row_id", "column_name", "path", "detail"]


def row_events(report: DataFrame, event: str, path: str | None = None, column: str | None = None,
               detail: str | None = None) -> DataFrame:
    """Events of an editor's change report (one per row, with ``row_id``):
    ``path`` and ``detail`` name its columns, ``column`` the edited column, or
    is the report's ``column_name``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")      # noqa: E731
    name = F.lit(column) if column else text("column_name" if "column_name" in report.columns else None)
    return report.select(F.lit(event).alias("event"), F.col("row_id").cast("long").alias("row_id"), name.alias("column_name"),
                         text(path).alias("path"), text(detail).alias("detail"))


def record_events(events: DataFrame, path: str, run: str, stage: str) -> None:
    """Write a stage's events of one run into the audit table: an event is keyed
    by (run, stage, row, column), and a run that is replayed replaces its own
    events, so a retry or a second call adds no row."""
    (events.select(*EVENT_COLUMNS).dropDuplicates(["event", "row_id", "column_name"])
     .write.mode("overwrite").parquet(f"{path}/run={run}/stage={stage}"))

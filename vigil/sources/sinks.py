"""Batch sinks: logs, alerts, alert log lines, CSV tables, report JSON/text.

Writes are idempotent: a target folder is overwritten, and appending sinks
write below a ``run_id=`` folder that a repeated run overwrites, so a retried
job never duplicates output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_logs(df: DataFrame, path: str, run_id: str) -> None:
    """S13 (batch form): logs partitioned by event date so time filters prune
    files; a repeated run replaces its own part of each date."""
    (df.withColumns({"date": F.to_date("timestamp"), "run_id": F.lit(run_id)})
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "run_id").parquet(path))


def alerts_as_json(df: DataFrame) -> DataFrame:
    """S14 value: one JSON document per alert (non-JSON values as text)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sink_alerts(df: DataFrame, path: str, run_id: str, fmt: str = "json", options: dict | None = None) -> None:
    """S14 (batch form): alert rows as JSON values to a topic or folder.  A
    broker gives at-least-once; a folder gets each run's rows once."""
    out = alerts_as_json(df)
    if fmt == "kafka":
        out.write.format("kafka").options(**(options or {})).save()
    else:
        out.write.mode("overwrite").text(f"{path}/run_id={run_id}")


def sink_alert_log(lines: DataFrame, path: str, run_id: str) -> None:
    """Add a run's ``time | user | score | channels`` lines."""
    lines.select("value").write.mode("overwrite").text(f"{path}/run_id={run_id}")


def write_table_csv(df: DataFrame, path: str) -> None:
    """CSV with header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_report_json(stats: DataFrame, path: str) -> None:
    """Report statistics as JSON."""
    stats.write.mode("overwrite").json(path)


def write_report_text(lines: DataFrame, path: str, key: str | None = None) -> None:
    """Report lines as text in reading order.  One report (bounded, ~100
    lines) is written as a single ordered file; per-user reports are range-
    partitioned by user so each file holds whole, ordered reports."""
    if key is None:
        ordered = lines.orderBy("section", "pos").coalesce(1)
    else:
        ordered = lines.repartitionByRange(key).sortWithinPartitions(key, "line_no")
    ordered.select("line").write.mode("overwrite").text(path)

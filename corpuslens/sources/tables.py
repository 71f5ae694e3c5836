"""Feeds, event logs and report sinks: declared schemas, appends, merges, resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FEED_SCHEMAS = {
    "issues": "project string, number int, title string, updated_at timestamp, labels array<string>",
    "pull_requests": "project string, number int, title string, updated_at timestamp, is_draft boolean, state string, head_ref string",
    "branches": "project string, name string",
    "workflow_runs": "project string, workflow string, status string, conclusion string, created_at timestamp, run_no bigint",
    "releases": "project string, tag string, published_at timestamp",
    "alerts": "project string, kind string, n int",
    "repos": "project string, license string, default_branch string, protected boolean, pushed_at timestamp",
}


def read_feed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """An exported repository feed as JSON lines with its declared schema."""
    return spark.read.schema(FEED_SCHEMAS[name]).json(path)


def append_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends a log in one folder per day: telemetry events, validation results, usage rows."""
    events.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def reset_events(spark: SparkSession, path: str, schema: str) -> None:
    """Empties a log and keeps its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    rows.write.mode("overwrite").json(path)

"""Usage events: counts, first and last, active days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def name_counts(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type by name, most frequent first."""
    return (
        events.filter(F.col("event_type") == event_type).groupBy("name")
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    )


def totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("n_events"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"))


def daily_activity(events: DataFrame, last_days: int = 7) -> DataFrame:
    """The newest ``last_days`` days that have events."""
    counts = events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("day")).limit(last_days)

"""Scores, bands and grades as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuslens.functions import fixed


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def severity_weight(severity: Column | str) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(1)
    for name, points in fixed.SEVERITY_WEIGHT.items():
        out = F.when(severity == name, F.lit(points)).otherwise(out)
    return out


def grade(score: Column, *cuts: int) -> Column:
    """Letter A-D for the four cuts (default 90/80/70/60), else F."""
    a, b, c, d = cuts or (90, 80, 70, 60)
    return (
        F.when(score >= a, "A").when(score >= b, "B").when(score >= c, "C").when(score >= d, "D")
        .otherwise("F")
    )


def vote(first: Column, second: Column, name1: str, name2: str, factor: float = 1.0) -> Column:
    """Name of the side that has more than ``factor`` times the other, else ``mixed``."""
    return (
        F.when(first > second * factor, name1).when(second > first * factor, name2)
        .otherwise("mixed")
    )


def day_age(as_of: Column, when: Column) -> Column:
    """Whole elapsed days, floored."""
    return F.floor(
        (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(when.cast("timestamp")))
        / F.lit(86_400_000_000)
    ).cast("bigint")


def drift_severity(delta: Column) -> Column:
    return (
        F.when(delta <= fixed.DRIFT_CRITICAL, "critical")
        .when(delta <= fixed.DRIFT_WARNING, "warning")
        .when(delta >= fixed.DRIFT_IMPROVED, "improved")
        .otherwise("stable")
    )


def share_score(passed: Column, total: Column) -> Column:
    """``100 * passed / total`` rounded half-even; 0 when there is nothing to check."""
    return F.when(total > 0, F.bround(100 * passed / total).cast("int")).otherwise(F.lit(0))

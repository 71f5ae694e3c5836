"""Rule packs compiled to columns: narrow, no join, one regex pass on clean lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

FINDING_TYPE = "struct<line:int,category:string,severity:string,message:string>"
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


@dataclass(frozen=True)
class Rule:
    """One ordered rule: the first rule of a pack that matches a line wins."""

    pattern: str
    category: str
    severity: str
    message: Column | str


def finding(line_no: Column | None, category: str, severity: str, message: Column | str) -> Column:
    return F.struct(
        (F.lit(None).cast("int") if line_no is None else line_no.cast("int")).alias("line"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def any_of(patterns: Sequence[str]) -> str:
    """One regex that matches where any of the patterns matches."""
    return "|".join(f"(?:{p})" for p in patterns)


def first_match(line: Column, line_no: Column, rules: Sequence[Rule]) -> Column:
    """Finding of the first matching rule, or null.

    A clean line costs one pass of the joined pattern; the ordered rules run on hits only.
    """
    picked = F.coalesce(
        *[
            F.when(line.rlike(r.pattern), finding(line_no, r.category, r.severity, r.message))
            for r in rules
        ]
    )
    if len(rules) == 1:
        return picked
    return F.when(line.rlike(any_of([r.pattern for r in rules])), picked)


def rules_from_rows(rows: Sequence[tuple[str, str, str, str]]) -> list[Rule]:
    """Rule pack from (pattern, category, severity, message) rows, e.g. a user's own pack."""
    return [Rule(*row) for row in rows]


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def when_found(condition: Column, *args) -> Column:
    return F.when(condition, finding(*args))


def kept(*items: Column) -> Column:
    """Findings that are not null, as an array."""
    return F.array_compact(F.array(*items))

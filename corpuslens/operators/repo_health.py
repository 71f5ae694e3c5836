"""Repository feeds: staleness, workflow and release state, health score, clean-up plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.scores import clamp, day_age


def stale_issues(issues: DataFrame, as_of: Column) -> DataFrame:
    """Open issues and exclusive age bands: over 90 days, over 30 up to 90."""
    age = day_age(as_of, F.col("updated_at"))
    return issues.groupBy("project").agg(
        F.count("*").alias("open_issues"), F.count_if(age > 90).alias("stale_90d"),
        F.count_if((age > 30) & (age <= 90)).alias("stale_30d"))


def stale_pulls(pulls: DataFrame, as_of: Column) -> DataFrame:
    age = day_age(as_of, F.col("updated_at"))
    return pulls.filter(F.col("state") == "open").groupBy("project").agg(
        F.count("*").alias("open_prs"), F.count_if("is_draft").alias("draft_prs"),
        F.count_if(age > 30).alias("stale_prs"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per workflow; its conclusion, or its status while it has none."""
    return runs.groupBy("project", "workflow").agg(
        F.max_by(F.coalesce("conclusion", "status"), F.struct("created_at", "run_no")).alias("outcome"))


def workflow_state(runs: DataFrame) -> DataFrame:
    latest = latest_runs(runs)
    return latest.groupBy("project").agg(
        F.count("*").alias("workflows"), F.count_if(F.col("outcome") == "failure").alias("failing_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("outcome") == "failure", F.col("workflow")))), ",").alias("failing"))


def release_state(releases: DataFrame) -> DataFrame:
    at = F.struct("published_at", "tag")
    return releases.groupBy("project").agg(
        F.count("*").alias("releases"), F.max_by("tag", at).alias("latest"), F.max("published_at").alias("latest_date"))


def health_report(
    repos: DataFrame, issues: DataFrame, pulls: DataFrame, runs: DataFrame, alerts: DataFrame, as_of: Column
) -> DataFrame:
    """Health score per repository: 100 minus capped deductions. Every feed is reduced to one
    row per project before the joins."""
    alert_counts = alerts.groupBy("project").agg(
        F.sum(F.when(F.col("kind") == "dependency", F.col("n")).otherwise(0)).alias("dependency_alerts"),
        F.sum(F.when(F.col("kind") == "code", F.col("n")).otherwise(0)).alias("code_alerts"))
    rows = repos.select("project", "license", "protected")
    for part in (stale_issues(issues, as_of), stale_pulls(pulls, as_of), workflow_state(runs).drop("failing"), alert_counts):
        rows = rows.join(part, "project", "left")
    numbers = [c for c in rows.columns if c not in ("project", "license", "protected")]
    c = F.col
    lost = (
        F.least(F.lit(30), c("dependency_alerts") * 5) + F.least(F.lit(30), c("code_alerts") * 10)
        + F.least(F.lit(10), c("stale_90d") * 2) + F.least(F.lit(5), c("stale_30d"))
        + F.least(F.lit(10), c("stale_prs") * 3) + F.when(F.coalesce("protected", F.lit(False)), 0).otherwise(10)
        + F.least(F.lit(15), c("failing_count") * 5) + F.when(c("license").isNull(), 5).otherwise(0)
    )
    return rows.fillna(0, numbers).withColumn("health", clamp(100 - lost).cast("int"))


# ---- clean-up plan ------------------------------------------------------------------
ACTION = ["project", "action", "target", "reason"]


def _plan(rows: DataFrame, action: str, target: Column, reason: Column) -> DataFrame:
    return rows.select("project", F.lit(action).alias("action"), target.alias("target"), reason.alias("reason"))


TITLE_CHARS = 80  #: of a title in a plan


def _number(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("number").cast("string"), F.lit(": "), F.substring("title", 1, TITLE_CHARS))


def stale_issue_plan(issues: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    rows = issues.withColumn("_age", day_age(as_of, F.col("updated_at"))).filter(F.col("_age") >= days)
    return _plan(rows, "close_issue", _number("#"),
                 F.concat(F.lit("No activity for "), F.col("_age").cast("string"), F.lit(" days")))


def stale_pull_plan(pulls: DataFrame, as_of: Column, days: int = 30, drafts: bool = False) -> DataFrame:
    """Stale open pull requests: drafts only when ``drafts``, else all others."""
    pick = F.col("is_draft") if drafts else ~F.col("is_draft")
    rows = pulls.filter((F.col("state") == "open") & pick).withColumn(
        "_age", day_age(as_of, F.col("updated_at"))).filter(F.col("_age") >= days)
    label, said = ("Draft PR #", "Draft with no activity for ") if drafts else ("PR #", "No activity for ")
    return _plan(rows, "close_pr", _number(label), F.concat(F.lit(said), F.col("_age").cast("string"), F.lit(" days")))


def merged_branch_plan(pulls: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches of merged pull requests that still exist and are not protected."""
    merged = pulls.filter((F.col("state") == "merged") & ~F.col("head_ref").isin(*fixed.PROTECTED_BRANCHES) & (F.col("head_ref") != ""))
    alive = branches.select("project", F.col("name").alias("head_ref"))
    rows = merged.join(alive, ["project", "head_ref"], "left_semi")
    return _plan(rows, "delete_branch",
                 F.concat(F.lit("branch `"), "head_ref", F.lit("` (merged in PR #"), F.col("number").cast("string"), F.lit(")")),
                 F.lit("Already merged"))


def cleanup_plan(
    issues: DataFrame, pulls: DataFrame, branches: DataFrame, as_of: Column, issue_days: int = 90,
    pull_days: int = 30, close_drafts: bool = False, delete_branches: bool = True,
) -> DataFrame:
    out = stale_issue_plan(issues, as_of, issue_days).unionByName(stale_pull_plan(pulls, as_of, pull_days))
    if close_drafts:
        out = out.unionByName(stale_pull_plan(pulls, as_of, pull_days, drafts=True))
    if delete_branches:
        out = out.unionByName(merged_branch_plan(pulls, branches))
    return out

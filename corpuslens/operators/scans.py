"""Scan service tables: caching, re-scan planning, metrics, batches, stored reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.json_text import strict_json
from corpuslens.operators.ranking import bucketed_rank, carried


def hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def answered_from_cache(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Requests with the newest complete free scan of the repository that had finished by then.

    As-of join as a running maximum over both tables in time order, per hour bucket, so a
    repository with most of the requests is not one task.
    """
    done = scans.filter((F.col("scan_type") == "free") & (F.col("status") == "complete") & F.col("completed_at").isNotNull())
    left = done.select(
        "repo_url", F.col("completed_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("request_id"),
        F.struct(F.col("created_at").alias("c"), F.col("scan_id").alias("s")).alias("scan"))
    right = requests.select(
        "repo_url", F.col("created_at").alias("at"), F.lit(1).alias("side"), "request_id",
        F.lit(None).cast("struct<c:timestamp,s:string>").alias("scan"))
    both = carried(
        left.unionByName(right), ["repo_url"], hour(F.col("at")), ["at", "side", "request_id"],
        {"best": F.col("scan")}, how="max")
    return both.filter(F.col("side") == 1).select(
        "request_id", "repo_url", F.col("best.s").alias("cached_scan"), F.col("best").isNotNull().alias("cached"))


def latest_perfect_scans(scans: DataFrame) -> DataFrame:
    """Newest complete scan with score 100 per repository."""
    good = scans.filter((F.col("status") == "complete") & (F.col("score") == 100) & F.col("completed_at").isNotNull())
    return good.groupBy("repo_url").agg(
        F.max("completed_at").alias("completed_at"), F.max_by("scan_id", F.struct("completed_at", "scan_id")).alias("scan_id"))


def rescan_plan(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """``skip`` for repositories without a push after their newest perfect scan, else ``scan``."""
    joined = repos.join(latest_perfect_scans(scans), "repo_url", "left")
    keep = F.col("pushed_at").isNotNull() & (F.col("pushed_at") <= F.col("completed_at"))
    return joined.select(
        *repos.columns, F.col("scan_id").alias("cached_scan"),
        F.when(F.coalesce(keep, F.lit(False)), "skip").otherwise("scan").alias("action"))


def previous_deep_scans(scans: DataFrame) -> DataFrame:
    """Completed deep scans with the previous one of the repository and the score change.

    The lag is a join of rank r with rank r - 1, so no repository is one window task.
    """
    deep = scans.filter((F.col("scan_type") == "deep") & (F.col("status") == "complete") & F.col("completed_at").isNotNull())
    ranked = bucketed_rank(
        deep.select("repo_url", "scan_id", "score", "completed_at"), ["repo_url"], hour(F.col("completed_at")),
        [F.col("completed_at"), F.col("scan_id")], "r")
    before = ranked.select(
        "repo_url", (F.col("r") + 1).alias("r"), F.col("scan_id").alias("previous_scan"),
        F.col("score").alias("previous_score"), F.col("completed_at").alias("previous_at"))
    return ranked.join(before, ["repo_url", "r"], "left").drop("r").withColumn(
        "change", F.col("score") - F.col("previous_score"))


def recent_scans(scans: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest scans with user names; the limit comes before the join."""
    top = scans.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n)
    names = users.select(F.col("id").alias("user_id"), "username")
    return top.join(names, "user_id", "left").select("scan_id", "repo_url", "status", "score", "created_at", "username")


def scan_totals(scans: DataFrame) -> DataFrame:
    """Totals, distinct users, mean score (1 decimal) and error rate in one pass."""
    errors = F.count_if(F.col("status") == "error")
    return scans.agg(
        F.count("*").alias("total_scans"), F.count_distinct("user_id").alias("unique_users"),
        F.coalesce(F.bround(F.avg("score"), 1), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.bround(F.try_divide(errors, F.count("*")) * 100, 1), F.lit(0.0)).alias("error_rate"),
    )


def active_users(users: DataFrame, as_of: Column) -> DataFrame:
    """All users and those seen in the last day and week before ``as_of``."""
    seen = F.col("last_seen_at")
    return users.agg(
        F.count("*").alias("total_users"),
        F.count_if(seen >= as_of - F.expr("INTERVAL 1 DAY")).alias("dau"),
        F.count_if(seen >= as_of - F.expr("INTERVAL 7 DAYS")).alias("wau"),
    )


def per_day(rows: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Counts of the newest ``days`` active days."""
    day = F.to_date(ts).cast("string")
    counts = rows.filter(F.col(ts).isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("day")).limit(days)


def most_scanned(scans: DataFrame, n: int = 10) -> DataFrame:
    counts = scans.groupBy("repo_url").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "repo_url").limit(n)


def batch_progress(scans: DataFrame, batches: DataFrame) -> DataFrame:
    done = scans.groupBy("batch_id").agg(F.count_if(F.col("status").isin("complete", "error")).alias("done"))
    return batches.join(done, "batch_id", "left").fillna(0, ["done"]).withColumn(
        "share", F.col("done") / F.col("repo_count"))


def upserted_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users after a log of logins: the newest name wins, the first sight is kept.

    Logins are reduced to one row per account before they meet the user table.
    """
    latest = logins.groupBy("github_id").agg(
        F.max_by("username", F.struct("ts", "login_id")).alias("_name"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    return users.join(latest, "github_id", "full_outer").select(
        "github_id", F.coalesce("_name", "username").alias("username"),
        F.coalesce("created_at", "_first").alias("created_at"), F.col("id").isNull().alias("is_new"))


def scan_rows(results: DataFrame, categories: DataFrame) -> DataFrame:
    """Scan rows from results: status, error, and the category scores as JSON."""
    names = [c for c in categories.columns if c not in ("project", "path")]
    packed = categories.select("project", "path", F.to_json(F.struct(*names)).alias("_json"))
    joined = results.join(packed, ["project", "path"], "left")
    failed = F.col("error").isNotNull()
    return joined.select(
        "project", "path", F.when(failed, "error").otherwise("complete").alias("status"), "error",
        F.when(~failed, F.col("score")).alias("score"), F.when(~failed, F.col("_json")).alias("category_json"))


REPORT_PARTS = ("llm_analysis", "dependency_audit", "category_scores", "tech_debt", "compliance", "hygiene", "history")


def normalized_reports(rows: DataFrame, column: str = "recommendations") -> DataFrame:
    """Stored reports in the old list form or the new object form, missing parts as null."""
    text = F.col(column)
    v = F.when(strict_json(text), F.try_parse_json(text))
    kind = F.schema_of_variant(v)
    is_list, is_object = F.startswith(kind, F.lit("ARRAY")), F.startswith(kind, F.lit("OBJECT"))
    items = F.when(is_list, F.try_variant_get(v, "$", "array<string>")).when(
        is_object, F.try_variant_get(v, "$.recommendations", "array<string>"))
    parts = [
        F.when(is_object, F.try_variant_get(v, f"$.{p}", "variant")).alias(p) for p in REPORT_PARTS
    ]
    rest = [c for c in rows.columns if c != column]
    form = F.when(is_list, "list").when(is_object, "object").otherwise("unreadable")
    return rows.select(*rest, form.alias("form"), F.coalesce(items, F.array().cast("array<string>")).alias("recommendations"), *parts)

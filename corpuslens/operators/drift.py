"""Scoring of model outputs against benchmark checks, runs against a baseline, trends."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.json_text import holds_json, json_block
from corpuslens.functions.scores import drift_severity
from corpuslens.session import ship_with_tasks

ship_with_tasks(__name__)

CHECK = (
    "struct<check_no:int,type:string,pattern:string,message:string,min_words:int,max_words:int,"
    "sections:string,threshold:double>"
)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _sections_found(output: Column, sections: Column) -> Column:
    low = F.lower(output)

    def heading(s: Column) -> Column:
        s = F.lower(s)
        return F.contains(low, F.concat(F.lit("# "), s)) | F.contains(low, F.concat(F.lit("**"), s, F.lit("**")))

    return F.forall(F.filter(F.split(F.coalesce(sections, F.lit("")), r"\|"), lambda s: s != ""), heading)


def check_passed(check: Column, output: Column, judge_score: Column | None = None) -> Column:
    """Result of one check by its type; an unknown type fails."""
    kind = check["type"]
    matches = F.regexp_like(output, F.concat(F.lit("(?is)"), F.coalesce(check["pattern"], F.lit(""))))
    n = words(output)
    in_range = (
        F.coalesce(n >= check["min_words"], F.lit(True)) & F.coalesce(n <= check["max_words"], F.lit(True))
    )
    judged = F.lit(False)
    if judge_score is not None:
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge_score))
        judged = judge_score.isNotNull() & (clamped >= F.coalesce(check["threshold"], F.lit(0.8)))
    return (
        F.when(kind == "pattern_present", matches).when(kind == "pattern_absent", ~matches)
        .when(kind == "length_range", in_range).when(kind == "json_valid", holds_json(output))
        .when(kind == "contains_sections", _sections_found(output, check["sections"]))
        .when(kind == "llm_judge", judged).otherwise(F.lit(False))
    )


def check_message(check: Column, output: Column, passed: Column) -> Column:
    word = lambda yes, no: F.when(passed, yes).otherwise(no)
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    kind = check["type"]
    text = (
        F.when(kind == "pattern_present", F.concat(F.lit("Pattern "), word("found", "not found"), F.lit(": "), said(check["pattern"])))
        .when(kind == "pattern_absent", F.concat(F.lit("Pattern "), word("absent", "present"), F.lit(": "), said(check["pattern"])))
        .when(kind == "length_range", F.concat(
            F.lit("Word count "), words(output).cast("string"), F.lit(" (range: "), said(check["min_words"]), F.lit("-"), said(check["max_words"]), F.lit(")")))
        .when(kind == "json_valid", F.concat(F.lit("JSON "), word("valid", "invalid")))
        .when(kind == "contains_sections", F.concat(F.lit("Sections "), word("all present", "missing"), F.lit(": "), said(check["sections"])))
        .when(kind == "llm_judge", F.lit("Judged by score"))
        .otherwise(F.concat(F.lit("Unknown check type: "), kind))
    )
    return F.coalesce(check["message"], text)


def suites(checks: DataFrame) -> DataFrame:
    """One row per benchmark: its weight and its checks as an array (a suite lists a handful)."""
    cols = {c: (F.col(c) if c in checks.columns else F.lit(None)) for c in
            ("check_no", "type", "pattern", "message", "min_words", "max_words", "sections", "threshold")}
    one = F.struct(*[v.alias(k) for k, v in cols.items()]).cast(CHECK)
    weight = F.max("weight") if "weight" in checks.columns else F.lit(1.0)
    return checks.groupBy("benchmark_id").agg(
        weight.alias("weight"), F.array_sort(F.collect_list(one)).alias("checks"))


def benchmark_results(outputs: DataFrame, suite_rows: DataFrame) -> DataFrame:
    """Every check of every output, evaluated inside the row: (run_id, model, benchmark_id,
    weight, score, n_checks, n_passed, results).

    Outputs meet their benchmark once, whatever its number of checks, so the text is shuffled
    at most once. No output scores 0; no checks score 1; an unknown benchmark weighs 1.
    """
    judge = F.col("judge_score") if "judge_score" in outputs.columns else None
    joined = outputs.join(suite_rows, "benchmark_id", "left")
    failed = F.col("output").isNull()
    empty = F.array().cast(f"array<{CHECK}>")
    checks = F.when(failed, empty).otherwise(F.coalesce("checks", empty))
    results = F.transform(
        F.transform(checks, lambda c: F.struct(c.alias("c"), check_passed(c, F.col("output"), judge).alias("p"))),
        lambda r: F.struct(
            r["c"]["check_no"].alias("check_no"), r["c"]["type"].alias("type"), r["p"].alias("passed"),
            check_message(r["c"], F.col("output"), r["p"]).alias("message"),
        ),
    )
    rows = joined.withColumn("results", results).withColumn("_failed", failed)
    passed = F.size(F.filter("results", lambda r: r["passed"]))
    score = F.when(F.col("_failed"), 0.0).when(F.size("results") == 0, 1.0).otherwise(passed / F.size("results"))
    keep = [c for c in ("run_id", "ts", "model", "benchmark_id") if c in outputs.columns]
    return rows.select(
        *keep, F.coalesce("weight", F.lit(1.0)).alias("weight"), score.alias("score"),
        F.size("results").alias("n_checks"), passed.alias("n_passed"), "results",
    )


def check_results(results: DataFrame) -> DataFrame:
    return results.select("run_id", "benchmark_id", F.inline("results"))


def failing_checks(results: DataFrame) -> DataFrame:
    """Benchmarks with failing checks: status by score, the failed check types in order."""
    status = F.when(F.col("score") >= 0.8, "PASS").when(F.col("score") >= 0.5, "WARN").otherwise("FAIL")
    failed = F.filter("results", lambda r: ~r["passed"])
    return results.select(
        "run_id", "benchmark_id", "score", status.alias("status"), "n_passed", "n_checks",
        F.array_join(F.transform(failed, lambda r: r["type"]), ",").alias("failing"),
    )


def run_scores(results: DataFrame) -> DataFrame:
    """Weighted mean per run, 0 when the weights sum to 0."""
    keys = [c for c in ("run_id", "model", "ts") if c in results.columns]
    total = F.sum("weight")
    return results.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), total), F.lit(0.0)).alias("score"),
        F.count("*").alias("n_benchmarks"),
    )


def against_baseline(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Delta to the baseline of the model (0 without one) and its severity."""
    base = baseline.select("model", F.col("score").alias("baseline_score"))
    delta = F.when(F.col("baseline_score").isNull(), 0.0).otherwise(F.col("score") - F.col("baseline_score"))
    return runs.join(base, "model", "left").withColumn("delta", delta).withColumn("severity", drift_severity(F.col("delta")))


def trend_points(runs: DataFrame, width: int = 60) -> DataFrame:
    """Scores scaled between the lowest and highest of the model, bar length, severity mark and
    signed delta. Extremes come from an aggregate, so a model with most runs is no hot window."""
    ends = runs.groupBy("model").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    scaled = (F.col("score") - F.col("_lo")) / span
    mark = (
        F.when(F.col("severity") == "critical", "!").when(F.col("severity") == "warning", "~")
        .when(F.col("severity") == "improved", "+").otherwise(" ")
    )
    delta = F.when(F.col("delta") == 0, " 0.00").otherwise(F.format_string("%+.2f", "delta"))
    return runs.join(ends, "model").select(
        "run_id", "model", F.to_date("ts").cast("string").alias("day"), scaled.alias("normalized"),
        F.greatest(F.lit(1), F.floor(scaled * width).cast("int")).alias("bar"), mark.alias("mark"), delta.alias("delta_text"),
    )


def trend_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(
        F.count("*").alias("runs"), F.max_by("score", F.struct("ts", "run_id")).alias("latest"),
        F.max("score").alias("best"), F.min("score").alias("worst"),
    )


def first_runs(runs: DataFrame) -> DataFrame:
    """The earliest run of every model, as a baseline table."""
    return runs.groupBy("model").agg(F.min_by("score", F.struct("ts", "run_id")).alias("score"))


# ---- suites from free text ----------------------------------------------------------
_SUITE = (
    "struct<version:int,benchmarks:array<struct<id:string,prompt:string,weight:double,checks:array<struct<"
    "type:string,pattern:string,message:string,criteria:string,threshold:double,min_words:int,"
    "max_words:int,sections:array<string>>>>>>"
)


def normalized_suites(raw: DataFrame, column: str = "response") -> DataFrame:
    """Checks of suites written by a model: unknown types are dropped, defaults filled in."""
    block = json_block(F.col(column))
    parsed = F.from_json(F.to_json(block), _SUITE.replace("struct<version", "struct<version", 1))
    rows = raw.withColumn("_s", parsed).filter(F.col("_s").isNotNull())
    bench = rows.select(
        *[c for c in raw.columns if c != column], F.coalesce("_s.version", F.lit(1)).alias("version"),
        F.explode("_s.benchmarks").alias("b"),
    ).filter(F.col("b.id").isNotNull() & F.col("b.prompt").isNotNull())
    known = F.filter("b.checks", lambda c: c["type"].isin(*fixed.CHECK_TYPES))
    return bench.select(
        *[c for c in raw.columns if c != column], "version", F.col("b.id").alias("benchmark_id"),
        F.coalesce("b.weight", F.lit(1.0)).alias("weight"), F.posexplode(known).alias("check_no", "c"),
    ).select("*", "c.type", "c.pattern", "c.min_words", "c.max_words",
             F.coalesce("c.threshold", F.lit(0.8)).alias("threshold"),
             F.array_join("c.sections", "|").alias("sections")).drop("c")


def fix_candidates(replies: DataFrame, column: str = "response") -> DataFrame:
    """Suggestions out of a model's reply: items without all four fields are dropped."""
    schema = "array<struct<benchmark_id:string,description:string,addition:string,confidence:double>>"
    items = F.from_json(F.to_json(json_block(F.col(column), "array")), schema)
    keep = [c for c in replies.columns if c != column]
    good = F.col("s.benchmark_id").isNotNull() & F.col("s.description").isNotNull() & F.col("s.addition").isNotNull() & F.col("s.confidence").isNotNull()
    return replies.select(*keep, F.explode(items).alias("s")).filter(good).select(*keep, "s.*")


# ---- judge adapter ------------------------------------------------------------------
def judge_outputs(outputs: DataFrame, complete: Callable[[str], str], criteria: str, threshold: float = 0.8) -> DataFrame:
    """Scores every output with the user's ``complete(prompt) -> reply``, in Arrow batches on the
    executors. A failing call or an unreadable reply gives (false, 0.0)."""

    def score(output: str | None) -> float:
        try:
            reply = complete(f"## Criteria\n{criteria}\n\n## Output to evaluate\n{output}")
            try:
                data = json.loads(reply)
            except ValueError:
                data = json.loads(re.search(r"\{[\s\S]*\}", reply).group(0))
            return max(0.0, min(1.0, float(data.get("score", 0.0))))
        except Exception:  # noqa: BLE001 - one bad reply must not stop the job
            return 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = batch["output"].map(score)
            yield batch.drop(columns=["output"]).assign(judge_score=scores, passed=scores >= threshold)

    kept = [f for f in outputs.schema.fields if f.name != "output"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return outputs.mapInPandas(run, f"{schema}, judge_score double, passed boolean")

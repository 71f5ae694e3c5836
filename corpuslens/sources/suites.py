"""Benchmark suites, run history, baselines and trend caches as tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SUITE_SCHEMA = (
    "version int, benchmarks array<struct<id:string,prompt:string,weight:double,checks:array<struct<"
    "type:string,pattern:string,message:string,criteria:string,threshold:double,min_words:int,"
    "max_words:int,sections:array<string>>>>>"
)
RUN_SCHEMA = (
    "run_id string, ts timestamp, model string, score double, delta double, severity string, "
    "results array<struct<benchmark_id:string,score:double,checks:array<struct<type:string,passed:boolean,message:string>>>>"
)


def read_suites(spark: SparkSession, path: str, many_lines: bool = True) -> DataFrame:
    """All suite files below ``path``; a malformed file fails the read, an empty one is skipped.
    ``many_lines=False`` reads the one-suite-per-line files that ``write_suites`` makes."""
    rows = spark.read.schema(SUITE_SCHEMA).option("mode", "FAILFAST").option("multiLine", many_lines).json(path)
    return rows.filter(F.col("benchmarks").isNotNull())


def suite_checks(suites: DataFrame) -> DataFrame:
    """One row per check: (benchmark_id, check_no, type, ..., weight)."""
    bench = suites.select(F.explode("benchmarks").alias("b"))
    rows = bench.select(F.col("b.id").alias("benchmark_id"), F.coalesce("b.weight", F.lit(1.0)).alias("weight"),
                        F.posexplode("b.checks").alias("check_no", "c"))
    return rows.select("benchmark_id", "weight", "check_no", "c.*").withColumn(
        "sections", F.array_join("sections", "|")).withColumn("threshold", F.coalesce("threshold", F.lit(0.8)))


def write_suites(suites: DataFrame, path: str) -> None:
    suites.write.mode("overwrite").json(path)


def save_runs(runs: DataFrame, path: str) -> None:
    """Appends run records without raw outputs, in one folder per day."""
    lean = runs
    if "results" in runs.columns:
        item = runs.schema["results"].dataType.elementType
        if "output" in item.fieldNames():
            lean = runs.withColumn("results", F.transform("results", lambda r: r.dropFields("output")))
    lean.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run history; records that do not parse or miss a key field are skipped."""
    rows = (
        spark.read.schema(f"{RUN_SCHEMA}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    )
    good = F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull() & F.col("ts").isNotNull() & F.col("score").between(0, 1)
    return rows.filter(good).drop("_corrupt_record")


def save_baseline(runs: DataFrame, path: str) -> None:
    """One current row per model."""
    runs.write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_trend(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").json(path)


def load_trend(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cached trend; content of another shape gives an empty table."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    some = F.coalesce(*[F.col(c).cast("string") for c in rows.columns if c != "_corrupt_record"])
    return rows.filter(F.col("_corrupt_record").isNull() & some.isNotNull()).drop("_corrupt_record")

"""Session transcripts: one JSON object per line, one file per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.functions.json_text import strict_json


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, pos, line). The session is the file name; ``pos`` grows along each file."""
    rows = spark.read.text(path).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "").alias("session"),
        (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("pos"),
        F.col("value").alias("line"),
    )
    return rows


def transcript_items(lines: DataFrame) -> DataFrame:
    """Tool calls and tool results: (session, pos, item_no, kind, tool_id, tool, cwd, is_error, text).

    Lines that are not JSON and messages without an item list are skipped. The text of a
    result is its string, or its text parts joined by a space.
    """
    event = lines.filter(strict_json(F.col("line"))).withColumn("_e", F.try_parse_json("line"))
    get = lambda v, path, t="string": F.try_variant_get(v, path, t)
    rows = event.select(
        "session", "pos", get("_e", "$.cwd").alias("_cwd"),
        F.posexplode(get("_e", "$.message.content", "array<variant>")).alias("item_no", "_i"),
    )
    kind = get("_i", "$.type")
    parts = F.transform(
        get("_i", "$.content", "array<variant>"),
        lambda p: F.when(
            F.startswith(F.schema_of_variant(p), F.lit("OBJECT")), F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))
        ),
    )
    text = F.coalesce(F.array_join(F.array_compact(parts), " "), get("_i", "$.content"), F.lit(""))
    is_use, is_result = kind == "tool_use", kind == "tool_result"
    return rows.filter(is_use | is_result).select(
        "session", "pos", "item_no", F.when(is_use, "use").otherwise("result").alias("kind"),
        F.coalesce(F.when(is_use, get("_i", "$.id")).otherwise(get("_i", "$.tool_use_id")), F.lit("")).alias("tool_id"),
        F.when(is_use, F.coalesce(get("_i", "$.name"), F.lit("?"))).alias("tool"),
        F.when(is_use, F.col("_cwd")).alias("cwd"),
        F.coalesce(get("_i", "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.when(is_result, text).alias("text"),
    )

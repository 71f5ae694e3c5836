"""Exact duplicates with a heavy-hitter split (DataFrame operations only).

Frequent digests come from a Misra-Gries type summary (``approx_top_k``: mergeable counters with a
fixed number of slots). Their winners are counted exactly, broadcast (at most ``slots`` rows) and
applied on the map side, so that a digest with a third of all rows never meets in one task. All
other digests are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
OUT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def heavy_digests(digests: DataFrame, column: str, slots: int = 512, tracked: int = 8192) -> DataFrame:
    """Candidates for frequent values, ``slots`` rows at most. Any value with more than
    about 1/tracked of all rows is among the tracked ones; a missing or a superfluous candidate
    changes the plan of its rows, never the result."""
    top = digests.agg(F.expr(f"approx_top_k({column}, {slots}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("hit")).where("hit.count > 1").select(
        F.col("hit.item").alias(column))


def exact_duplicates(docs: DataFrame, slots: int = 512) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of white space became one space; null is
    the empty text. The smallest doc_id of a group stays. A null doc_id counts as the largest; rows
    that repeat the same doc_id and text share keep_id, and exactly one of them is kept. Other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256")),
        "digests",
    )
    winners = (
        rows.join(F.broadcast(heavy_digests(rows, "text_sha256", slots)), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(F.min("doc_id").alias("heavy_id"), F.count("*").alias("heavy_size"))
    )
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    is_heavy = F.col("heavy_size").isNotNull()
    # of a heavy group only the rows of the winning doc_id go on (normally one)
    loser = is_heavy & ~F.col("doc_id").eqNullSafe(F.col("heavy_id"))
    removed = marked.where(loser).select(
        "doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"),
        F.lit(False).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    first = F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last()))
    others = marked.where(~loser).select(
        "doc_id", F.min("doc_id").over(group).alias("keep_id"),
        F.coalesce("heavy_size", F.count("*").over(group)).alias("group_size"),
        (first == 1).alias("kept"), "text_sha256")
    return removed.unionByName(others).select(*OUT)


ORACLE = r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

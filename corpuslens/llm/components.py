"""Connected components by alternating large and small stars, on Spark all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import cut_lineage

MOST_ROUNDS = 60


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours. Written, so that the join with it can split
    a node with very many neighbours."""
    return cut_lineage(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "nearest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _nearest(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another: root is the least node of its component.
    ``edges`` has columns u and v of one orderable type, in any direction, repeated at will."""
    edges = cut_lineage(edges.where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        edges = cut_lineage(_large_star(edges).distinct(), "large")
        edges = cut_lineage(_small_star(edges).distinct(), "small")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

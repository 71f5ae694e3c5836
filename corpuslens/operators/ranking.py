"""Ranks and prefix sums that never put one key or the whole table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.session import cut_lineage


def global_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position in the global order of ``order`` (columns must give a total order).

    The rows are range-partitioned and sorted once and written; a second pass adds, to the
    rank inside a partition, the row counts of all earlier partitions.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    fixed_parts = cut_lineage(parts, "ranges")
    counts = fixed_parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition: bounded by the number of shuffle partitions
    before = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        fixed_parts.withColumn("_in", inside).join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("bigint"))
        .drop("_part", "_in", "_before")
    )


def bucketed_counts(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], counters: dict[str, Column]
) -> DataFrame:
    """Running counts per key (the row itself included) of the rows that fulfil each condition of
    ``counters``, exact when one key holds a large share of all rows.

    ``bucket`` must not decrease along ``order``. Rows are counted per (key, bucket) with map-side
    partial sums, the small counts are accumulated over buckets, and rows are counted one by one
    only inside their (key, bucket). The count table has one row per key and bucket.
    """
    rows = df.select("*", bucket.alias("_bucket"), *[c.cast("int").alias(f"_is_{n}") for n, c in counters.items()])
    sums = rows.groupBy(*keys, "_bucket").agg(*[F.sum(f"_is_{n}").alias(f"_sum_{n}") for n in counters])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in counters])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("*", *[F.sum(f"_is_{n}").over(inside).alias(f"_in_{n}") for n in counters])
    return seen.join(before, [*keys, "_bucket"]).select(
        *df.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in counters])


def bucketed_rank(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """Exact ``row_number`` per key, see ``bucketed_counts``."""
    return bucketed_counts(df, keys, bucket, order, {name: F.lit(True)})


def ranged_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` per key where one key may hold a large share of all rows and nothing is known
    of the spread of ``order`` (null keys are keys, nulls come first in the order).

    The rows are range-partitioned by key and order and written once; a row is ranked inside its
    key and range, and the counts of the earlier ranges, one row per key and range, are added.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id())
    rows = cut_lineage(parts, "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = before.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).alias("b")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    same = " AND ".join(f"r.`{c}` <=> b.`{c}`" for c in [*keys, "_part"])
    return rows.withColumn("_in", inside).alias("r").join(before, F.expr(same)).select(
        *[F.col(f"r.`{c}`") for c in df.columns], (F.col("_before") + F.col("_in")).cast("int").alias(name))


def carried(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, Column],
    how: str = "last",
) -> DataFrame:
    """Running last non-null value (or running maximum) per key, for keys of any size.

    Each (key, bucket) is scanned on its own; what enters a bucket is taken from one row per
    key and earlier bucket. ``bucket`` must not decrease along ``order``.
    """
    rows = df.withColumn("_bucket", bucket)
    at = F.struct(*order)
    names = list(values)

    def end(v: Column) -> Column:
        return F.max(v) if how == "max" else F.max_by(v, F.when(v.isNotNull(), at))

    def running(v: Column | str) -> Column:
        return F.max(v) if how == "max" else F.last(v, ignorenulls=True)

    ends = rows.groupBy(*keys, "_bucket").agg(*[end(values[n]).alias(f"_end_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select(
        *keys, "_bucket", *[running(f"_end_{n}").over(earlier).alias(f"_in_{n}") for n in names]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("*", *[running(values[n]).over(inside).alias(f"_at_{n}") for n in names])
    joined = seen.join(entering, [*keys, "_bucket"], "left")
    merge = F.greatest if how == "max" else F.coalesce
    out = joined.select("*", *[merge(F.col(f"_at_{n}"), F.col(f"_in_{n}")).alias(n) for n in names])
    return out.drop("_bucket", *[f"_at_{n}" for n in names], *[f"_in_{n}" for n in names])

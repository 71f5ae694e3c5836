"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

Every source is laid out as a line of words in a shuffled order (by digest of the doc_id), three
rounds long, and cut into blocks of equal size up to the source's target; the last block is a part.
The unit interval is cut into a power of two of points, at least as many as there are blocks, and
each source owns as many neighbouring points as it has blocks. Slot t of the schedule has the van
der Corput point of t, which visits every point once: the k-th slot of a source takes block k of its
line, and every stretch of the schedule has the sources in their shares. Ranks of slots and
positions on the lines are prefix sums over buckets: no source is walked by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import cut_lineage, text_hash, unused_names

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  #: by code point of the source, repeating
ROUNDS = 3  #: times a source may be used
BLOCK_WORDS = 2048  #: words of a block at most
LEAST_SLOTS = 4096  #: small corpora get smaller blocks, so that there are so many slots at least
BUCKET_DIGITS = 3  #: hexadecimal digits of the digest that name a bucket of a line
CELL_BITS = 12  #: cells into which the points are cut for the join with the sources
SLOT_BUCKET = 1 << 16  #: consecutive slots whose ranks are counted by one task


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def sized_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, source, size and start: the place of a document on the line of its source.
    ``row`` tells repeated rows apart; it is written once and never computed again."""
    sized = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_key"),
            F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        ).withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS)),
        "sizes",
    )
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(
        sums.alias("b"), F.expr("d.source <=> b.source AND d.bucket = b.bucket"))
    return at.select("d.row", "d.doc_id", "d.text_key", "d.source", "d.size", (F.col("before") + F.col("inside")).alias("start"))


def source_targets(lines: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """source, source_size, target, due (words that the mix takes); one row per source.

    Water filling: sources are capped in the order of cap / weight as long as the level at which
    the rest would stand is above theirs. The windows here see one row per source.
    """
    per = lines.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * rounds)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * common))
    return per.select("source", "source_size", "target", F.round("target").cast("bigint").alias("due"))


def block_words(targets: DataFrame, most: int = BLOCK_WORDS, slots: int = LEAST_SLOTS) -> int:
    """Words of a block."""
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    return max(1, min(most, total // slots))


def schedule(targets: DataFrame, words: int) -> DataFrame:
    """slot, source, block (rank of the slot among those of its source), upto (place on the line where
    the block ends)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    owned = targets.where("due > 0").withColumn("blocks", F.ceil(F.col("due") / words))
    owned = owned.select("source", "due", (F.sum("blocks").over(by_name) - F.col("blocks")).alias("low"), F.sum("blocks").over(by_name).alias("high"))
    n = owned.agg(F.coalesce(F.max("high"), F.lit(0)).alias("n")).first()["n"]
    bits = max(0, n - 1).bit_length()
    cell = max(0, bits - CELL_BITS)
    # the bits of the slot number in reverse order: each point below 2**bits once
    point = F.conv(F.reverse(F.lpad(F.bin("id"), max(1, bits), "0")), 2, 10).cast("bigint")
    points = targets.sparkSession.range(1 << bits if n else 0).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", cell))
    # a source has a row for each cell that it touches: at most sources + 2**CELL_BITS rows
    ranges = owned.select("source", "due", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    drawn = points.join(ranges, "cell").where("point >= low AND point < high").select("slot", "source", "due")
    drawn = drawn.withColumn("bucket", F.floor(F.col("slot") / SLOT_BUCKET))
    counts = drawn.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("slot"))
    ranked = drawn.withColumn("inside", inside).alias("s").join(
        counts.alias("c"), F.expr("s.source <=> c.source AND s.bucket = c.bucket"))
    block = F.col("before") + F.col("inside") - 1
    return ranked.select("slot", "s.source", block.alias("block"), F.least((block + 1) * words, F.col("due")).alias("upto"))


def mixed_pieces(lines: DataFrame, targets: DataFrame, plan: DataFrame, words: int, rounds: int = ROUNDS) -> DataFrame:
    """The mix: slot, row, doc_id, round, skip (words of the document left out in front), words.
    A document appears once per scheduled block that holds a part of it."""
    placed = lines.where("size > 0").alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select(
        "row", "doc_id", "d.source", "size", "start", "source_size",
        F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    placed = placed.withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
    parts = placed.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("at") / words), F.floor((F.col("at") + F.col("size") - 1) / words))))
    joined = parts.alias("p").join(plan.alias("s"), F.expr("p.source <=> s.source AND p.block = s.block"))
    begin = F.greatest("at", F.col("p.block") * words)
    end = F.least(F.col("at") + F.col("size"), F.col("upto"))
    return joined.where(begin < end).select("slot", "row", "doc_id", "round", (begin - F.col("at")).alias("skip"), (end - begin).alias("words"))


def planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(lines, targets, schedule, words of a block) of a corpus."""
    lines = sized_lines(docs)  # from the written sizes; narrow rows, whose exchange is shared
    targets = cut_lineage(source_targets(lines), "targets")
    words = block_words(targets)
    return lines, targets, schedule(targets, words), words


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot (where in the
    schedule it comes first, null if it isn't taken).

    A null text has size 0 and is never taken. A null source is a source of its own, last in order.
    Repeated rows and rows that share a doc_id are documents of their own; no row exceeds three
    times its size, and the words of a source add up to its target, rounded. An empty table gives an
    empty result. Other columns are ignored.
    """
    lines, targets, plan, words = planned(docs)
    taken = mixed_pieces(lines, targets, plan, words).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    sized = lines.alias("l").join(targets.alias("s"), F.expr("l.source <=> s.source")).select("row", "doc_id", "size", "source_size", "target")
    return sized.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, whatever their names, each as often as its first
    word is scheduled (0 to ``ROUNDS`` times). Repeated rows share their number, rounded; a document
    without words isn't taken; a null source is a source of its own; an empty table gives none."""
    lines, targets, plan, words = planned(docs)
    key, mix_id, mix_key, times, copy = unused_names(docs, "_mix_text", "_mix_id", "_mix_key", "_mix_times", "_mix_copy")
    pieces = mixed_pieces(lines, targets, plan, words).where("skip = 0").groupBy("row").agg(F.count("*").alias("times"))
    often = lines.join(pieces, "row", "left").groupBy(F.col("doc_id").alias(mix_id), F.col("text_key").alias(mix_key)).agg(
        F.round(F.sum(F.coalesce("times", F.lit(0))) / F.count("*")).cast("int").alias(times)).where(F.col(times) > 0)
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col(mix_id)) & (F.col(key) == F.col(mix_key))
    rows = docs.withColumn(key, text_hash()).join(often, on)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
l AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rn - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 3 AS cap FROM p),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
 / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, rn, CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE) ELSE weight * max(CASE WHEN cap / weight > level THEN level END) OVER () END AS target FROM v),
g AS (SELECT CAST(greatest(1, least(2048, sum(source_size) // 4096)) AS BIGINT) AS words FROM t),
q AS (SELECT t.*, CAST(round(target) AS BIGINT) AS due, CAST((CAST(round(target) AS BIGINT) + words - 1) // words AS BIGINT) AS blocks FROM t, g),
h AS (SELECT *, CAST(sum(blocks) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high FROM q),
n AS (SELECT length(ltrim(bin(max(high) - 1), '0')) AS bits FROM h),
s AS (SELECT slot, coalesce(list_sum(list_transform(range(bits), lambda i: ((slot >> i) & 1) << (bits - 1 - i))), 0) AS point FROM (SELECT bits, unnest(range(1 << bits)) AS slot FROM n)),
k AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM s JOIN h ON point >= high - blocks AND point < high),
f AS (SELECT l.doc_id, min(k.slot) AS first_slot FROM (SELECT l.*, start + e * source_size AS pos, words, due FROM l JOIN q ON l.source IS NOT DISTINCT FROM q.source, g, unnest([0, 1, 2]) AS u(e) WHERE size > 0) l
 JOIN k ON l.source IS NOT DISTINCT FROM k.source AND k.block BETWEEN pos // words AND (least(pos + size, due) - 1) // words WHERE pos < due GROUP BY l.doc_id)
SELECT doc_id, size, source_size, target, CAST((SELECT sum(greatest(0, least(start + e * source_size + size, due) - start - e * source_size)) FROM unnest([0, 1, 2]) AS u(e)) AS BIGINT) AS taken, first_slot
FROM l JOIN q ON l.source IS NOT DISTINCT FROM q.source LEFT JOIN f USING (doc_id)"""

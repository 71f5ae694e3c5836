"""Filter interaction audit by an incremental stream with retractions.

Five filters remove documents in every possible order; the audit says, per part of the corpus, what
each filter removes at each place. Four filters look at one text, the fifth at whether the same text
stands under a smaller number anywhere in the table. All of it follows from counters per part and
pattern of failed filters, so the files are read once, as micro-batches of a stream that ends when
they are used up. State per text holds the smallest number seen so far and who bears it; a smaller
one that arrives later takes back the pattern counted for the earlier one. What a micro-batch changes is
written under its number, so a repeated batch replaces its own changes.

Equal texts are summed up inside the tasks before the shuffle, so a text with a third of all rows
brings a few rows per task to its state.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuslens.llm.common import map_batches, ship_with_tasks
from corpuslens.session import local_rows, scratch_path
from corpuslens.streaming.jobs import run_available

ship_with_tasks(__name__)

SPACES = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"  #: the position is the bit of a failure
COPY = 16  #: the bit of filter E
NO_ID = (1 << 63) - 1  #: stands for a null doc_id, which is larger than every number
MICRO_BATCHES = 4  #: the files are dealt to so many micro-batches (a file is never cut)
COMBINED = 50_000  #: texts that a task sums up at a time
BUCKET_TEXTS = 64  #: texts of a key of the state, about
_BEARER = "text_key: binary, least: bigint, part: string, good: int, toxic: int, n: bigint"
_PARTIAL = "text_key binary, part string, good int, toxic int, mask int, n bigint, least bigint, n_least bigint"
_CHANGE = "part string, mask int, good int, toxic int, n bigint"


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D; ``words`` is the text split at white space."""
    first_empty, last_empty = (words[0] == "").cast("int"), ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    n = F.size(words) - first_empty - last_empty
    distinct = F.size(F.array_distinct(words)) - F.greatest(first_empty, last_empty)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    failed = (n < 50, distinct * 100 < n * 65, capitals * 100 > F.length(text) * 5, text.rlike("[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text_key, part, good, toxic, mask (A to D), doc_id of every document."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.split("text", SPACES)).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), text_failures(F.col("text"), F.col("words")).cast("int").alias("mask"))
    return rows.join(told, rows["doc_id"] == told["label_id"], "left").select(
        "text_key", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "mask",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))


def combined(rows: DataFrame) -> DataFrame:
    """Rows of equal text, part and labels inside a task become one: their number, the least doc_id, and how
    many have it."""
    def run(batches):
        names = [f.split()[0] for f in _PARTIAL.split(", ")]

        def out(seen):
            lines = [(*key, *value) for key, value in seen.items()]
            columns = list(zip(*lines)) if lines else [[] for _ in names]
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        seen: dict = {}
        for batch in batches:
            for *key, doc_id in zip(*(batch.column(c).to_pylist() for c in ("text_key", "part", "good", "toxic", "mask", "doc_id"))):
                n, least, same = seen.get(tuple(key), (0, doc_id, 0))
                seen[tuple(key)] = (n + 1, min(least, doc_id), same + 1 if doc_id == least else 1 if doc_id < least else same)
            if len(seen) >= COMBINED:
                yield out(seen)
                seen = {}
        yield out(seen)

    return map_batches(rows, run, _PARTIAL)


class LeastBearers(StatefulProcessor):
    """State of a bucket of texts: per text the least doc_id so far and its bearers, by part and labels.
    Gives the changes of the counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", f"bearers array<struct<{_BEARER}>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        least: dict[bytes, int] = {}
        bearers: dict[bytes, dict] = defaultdict(dict)
        for text, number, part, good, toxic, n in known[0] if known else ():
            text = bytes(text)
            least[text] = number
            bearers[text][part, good, toxic] = n
        changes, changed = defaultdict(int), False
        for r in rows:
            text, who = bytes(r.text_key), (r.part, r.good, r.toxic)
            changes[who, r.mask | COPY] += r.n
            if text not in least or r.least < least[text]:  # the bearers so far are copies now
                for other, n in bearers.pop(text, {}).items():
                    changes[other, r.mask] -= n
                    changes[other, r.mask | COPY] += n
                least[text] = r.least
            if r.least == least[text]:
                bearers[text][who] = bearers[text].get(who, 0) + r.n_least
                changes[who, r.mask | COPY] -= r.n_least
                changes[who, r.mask] += r.n_least
                changed = True
        if changed:
            self.state.update(([(text, least[text], *who, n) for text, all_of in bearers.items() for who, n in all_of.items()],))
        for ((part, good, toxic), pattern), n in changes.items():
            if n:
                yield Row(part=part, mask=pattern, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def counters(docs: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """part, mask, good, toxic, n after the whole stream ``docs`` (doc_id, text, source) has gone
    through, in micro-batches of what is there now. ``labels`` is a plain table; ``n_rows`` says
    about how many rows there are, which sets the number of buckets and no result."""
    spark = docs.sparkSession
    out, state = scratch_path(spark, "filter-audit"), scratch_path(spark, "filter-audit-state")
    bucket = F.pmod(F.xxhash64("text_key"), F.lit(n_rows // BUCKET_TEXTS + 1)).alias("bucket")
    changes = combined(marked(docs, labels)).select("*", bucket).groupBy("bucket").transformWithState(LeastBearers(), _CHANGE, "update", "none")
    sums = ("part", "mask", "good", "toxic")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*sums).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/epoch={number}")

    spark.createDataFrame([], _CHANGE).write.parquet(f"{out}/epoch=-1")  # a table without files has no batch
    run_available(spark, changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state))
    return spark.read.schema(f"{_CHANGE}, epoch int").parquet(out).groupBy(*sums).agg(F.sum("n").alias("n")).where("n != 0")


def audit(counted: DataFrame) -> DataFrame:
    """The audit from counters (part, mask, good, toxic, n): 600 rows a part, zeros included."""
    orders = [
        ("".join(o), step + 1, 1 << FILTERS.index(o[step]), sum(1 << FILTERS.index(f) for f in o[:step]))
        for o in permutations(FILTERS) for step in range(len(FILTERS))]
    # 600 rows, and 80 pairs of a filter and the set of those before it: fixed by the five filters
    steps = local_rows(counted.sparkSession, orders, "filter_order string, step int, bit int, earlier int")
    cases = sorted({(bit, earlier) for *_, bit, earlier in orders})
    ways = {k: len(orders) // len(FILTERS) // k for k in range(1, len(FILTERS) + 1)}  # orders in which one of k filters comes first
    per = counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for b, e in cases])).alias("c")
    # as many rows per part as there are patterns and cases, 32 * 80, summed inside the tasks first
    rows = per.select("part", "mask", "n", "n_good", "n_toxic", case).select("*", "c.bit", "c.earlier")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    share = F.element_at(F.create_map(*[F.lit(x) for kv in ways.items() for x in kv]), F.bit_count("mask"))

    def total(condition: Column, what: str | Column = "n") -> Column:
        return F.sum(F.when(condition, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("bigint")

    found = rows.groupBy("part", "bit", "earlier").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "n_good").alias("good_lost"),
        total(fails & ~gone, "n_toxic").alias("toxic_lost"), total(fails, F.col("n") * F.when(fails, share)).alias("shapley"))
    return found.join(F.broadcast(steps), ["bit", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interaction_audit(spark: SparkSession, path: str, labels: DataFrame, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``path`` is a Parquet table (doc_id, text, source), a file or a folder, whose files are dealt to
    ``micro_batches`` micro-batches; ``labels`` is a table (doc_id, quality, toxic). A null text is the
    empty text and a null source the part ''. A null doc_id is larger than every number and has no
    labels; rows that share a doc_id and a text are no copies of each other. Where a document has several
    labels, one that says so is enough. Other columns are ignored; an empty table gives an empty
    result.
    """
    table = spark.read.parquet(path)
    files = max(1, -(-len(table.inputFiles()) // micro_batches))
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be a file, too
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    return audit(counters(docs, labels, table.count()))  # counted from the files' footers


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(toxic), 0) AS n_toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
e AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bs[step] AS b, CAST(coalesce(list_sum(bs[1:step - 1]), 0) AS INTEGER) AS x FROM o, range(1, 6) u(step))
SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (b | x) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & b <> 0 AND mask & x = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN mask & b <> 0 AND mask & x <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = b THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
 CAST(sum(CASE WHEN mask & b <> 0 AND mask & x = 0 THEN n_good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & b <> 0 AND mask & x = 0 THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
 CAST(sum(CASE WHEN mask & b <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, e GROUP BY part, filter_order, step"""

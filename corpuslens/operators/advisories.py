"""Dependencies against an advisory table with version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.versions import version_key
from corpuslens.operators.ranking import carried
from corpuslens.session import cut_lineage


def cvss_band(score: Column) -> Column:
    """Band of a CVSS text: null is unknown, text that is no number counts as 0."""
    n = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return (
        F.when(score.isNull(), "unknown").when(n >= 9, "critical").when(n >= 7, "high")
        .when(n >= 4, "medium").otherwise("low")
    )


def _covering(low: Column, high: Column, bits: int) -> Column:
    """array<struct<level, node>>: the fewest aligned blocks of powers of two that make up [low, high)."""
    def blocks(level: Column) -> Column:
        a = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1), level) - 1, level)
        b = F.call_function("shiftright", high, level)
        node = lambda n: F.struct(level.alias("level"), n.cast("int").alias("node"))
        none = F.array().cast("array<struct<level: int, node: int>>")
        first = F.when(a % 2 == 1, F.array(node(a))).otherwise(none)
        last = F.when(b % 2 == 1, F.array(node(b - 1))).otherwise(none)
        return F.when(a < b, F.concat(first, last)).otherwise(none)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), blocks))


PACKAGE = ["ecosystem", "name"]
CHUNK = 2048  #: rows of one side of a join that meet as many of the other in one group
TASK_PAIRS = 8_000_000  #: pairs that a task of such a join makes, about


def _levels(interval: Column, bits: int) -> Column:
    """array<struct<level, node>>: the aligned blocks that hold an interval, one per level."""
    number = F.coalesce(interval, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: F.struct(
        level.alias("level"), F.call_function("shiftright", number, level).cast("int").alias("node")))


def _located(versions: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Intervals of distinct ``versions`` (ecosystem, name, version, interval), the aligned blocks that the ranges
    of each advisory cover (ecosystem, name, adv_id, block), each block once, and the number of levels."""
    # keys cost far more than the size of the rows tells: made once, over all tasks
    tasks = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut_lineage(versions.repartition(tasks).select(
        *PACKAGE, "version", version_key(F.col("version"), F.col("ecosystem")).alias("at")), "version-keys").where("at IS NOT NULL")
    bounds = ranges.where("adv_id IS NOT NULL").select(
        *PACKAGE, "adv_id", version_key(F.col("introduced"), F.col("ecosystem")).alias("low"), version_key(F.col("fixed"), F.col("ecosystem")).alias("high"),
        (F.col("introduced").isNull()).alias("from_start"), F.col("fixed").isNull().alias("to_end"))
    bounds = bounds.where("(from_start OR low IS NOT NULL) AND (to_end OR high IS NOT NULL)")
    ends = bounds.select(*PACKAGE, F.explode(F.array("low", "high")).alias("at")).where("at IS NOT NULL").distinct()
    # one row per end of a range; windows are per package
    ends = cut_lineage(ends.withColumn("no", F.row_number().over(Window.partitionBy(*PACKAGE).orderBy("at"))), "range-ends")
    bits = (ends.agg(F.coalesce(F.max("no"), F.lit(0))).first()[0] + 1).bit_length()
    one, other = ends.select(*PACKAGE, F.col("at").alias("low"), F.col("no").alias("first")), ends.select(*PACKAGE, F.col("at").alias("high"), F.col("no").alias("beyond"))
    spans = bounds.join(one, [*PACKAGE, "low"], "left").join(other, [*PACKAGE, "high"], "left")
    count = ends.groupBy(*PACKAGE).agg(F.max("no").alias("most"))
    spans = spans.join(count, PACKAGE, "left").select(
        *PACKAGE, "adv_id", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("beyond", F.col("most") + 1, F.lit(1)).alias("beyond")).where("first < beyond")
    # ranges of one advisory that touch become one: no version is hit twice by the same advisory
    of_advisory = Window.partitionBy(*PACKAGE, "adv_id").orderBy("first", "beyond")
    reached = F.max("beyond").over(of_advisory.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.distinct().withColumn("_new", (reached.isNull() | (reached < F.col("first"))).cast("int"))
    spans = spans.withColumn("_run", F.sum("_new").over(of_advisory)).groupBy(*PACKAGE, "adv_id", "_run").agg(
        F.min("first").alias("first"), F.max("beyond").alias("beyond"))
    blocks = spans.select(*PACKAGE, "adv_id", F.explode(_covering(F.col("first"), F.col("beyond"), bits)).alias("block"))
    # as-of: the number of the last end that isn't beyond the version; ends come before equal versions
    both = ends.select(*PACKAGE, "at", F.lit(0).alias("side"), "no", F.lit(None).cast("string").alias("version")).unionByName(
        keyed.select(*PACKAGE, "at", F.lit(1).alias("side"), F.lit(None).cast("int").alias("no"), "version"))
    placed = carried(both, PACKAGE, F.substring("at", 1, 12), ["at", "side", "version"], {"interval": F.col("no")}).where("side = 1")
    return placed.select(*PACKAGE, "version", "interval"), blocks, bits


def affected_versions(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """ecosystem, name, version, adv_id for distinct ``versions`` (ecosystem, name, version) and
    ``ranges`` (ecosystem, name, adv_id, introduced, fixed): introduced <= version < fixed.

    The ends of a package's ranges cut its versions into disjoint intervals, numbered in order. A
    version finds its interval by an as-of lookup; a range becomes the few aligned blocks of intervals that
    it covers, so hits come from an equi join on blocks and no version meets a range that doesn't hold
    it. A null introduced has no lower end, a null fixed no upper one; what is no version is never hit.
    """
    placed, blocks, bits = _located(versions, ranges)
    asked = placed.select(*PACKAGE, "version", F.explode(_levels(F.col("interval"), bits)).alias("block"))
    return asked.join(blocks, [*PACKAGE, "block"]).select(*PACKAGE, "version", "adv_id")


def chunked_join(left: DataFrame, right: DataFrame, on: list[str], chunk: int = CHUNK) -> DataFrame:
    """Inner equi join whose popular keys are dealt to many tasks.

    Rows of a key are dealt by hash to chunks of about ``chunk`` rows on both sides, and each chunk meets each
    chunk of the other side in a group of its own: a group has ``chunk`` squared pairs, and a row is copied
    once per ``chunk`` partners. The number of tasks follows the number of pairs, not the size of the sides,
    which are read several times.
    """
    spark = left.sparkSession
    sizes = cut_lineage(left.groupBy(*on).agg(F.count("*").alias("_m")).join(right.groupBy(*on).agg(F.count("*").alias("_n")), on), "pairs")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_m").cast("double") * F.col("_n")), F.lit(0.0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs / TASK_PAIRS) + 1)
    sizes = sizes.select(*on, F.ceil(F.col("_m") / chunk).alias("_a"), F.ceil(F.col("_n") / chunk).alias("_b"))
    groups = [*on, "_i", "_j"]

    def dealt(side: DataFrame, own: str, others: str, i: str, j: str) -> DataFrame:
        number = F.pmod(F.xxhash64(*[c for c in side.columns if c not in on]), F.col(own)).alias(i)
        copies = side.join(sizes, on).select(*side.columns, number, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1)).alias(j))
        return copies.repartition(tasks, *groups)  # a given number isn't made smaller at run time

    return dealt(left, "_a", "_b", "_i", "_j").join(dealt(right, "_b", "_a", "_j", "_i"), groups).drop("_i", "_j")


def vulnerabilities(deps: DataFrame, advisories: DataFrame, summary_chars: int = 200) -> DataFrame:
    """Pinned dependencies hit by an advisory: introduced <= version < fixed.

    Intervals are looked up for the distinct (ecosystem, name, version) triples, which do not grow
    with the number of projects that use a popular package (see ``affected_versions``). What is told of an
    advisory goes to its blocks and the interval of a version to its dependencies, so that the join that
    makes the hits comes last and hits are shuffled nowhere.
    ``summary`` is cut to ``summary_chars``, ``full_summary`` is whole.
    """
    pinned = deps.filter(F.col("version") != "")
    triples = pinned.select(*PACKAGE, "version").distinct()
    text = F.coalesce("summary", F.lit("No description available"))
    told = advisories.select(
        *PACKAGE, "adv_id", F.coalesce("alias", "adv_id").alias("cve_id"), cvss_band(F.col("cvss")).alias("severity"),
        F.substring(text, 1, summary_chars).alias("summary"), text.alias("full_summary"), F.col("fixed").alias("fix_version"))
    placed, blocks, bits = _located(triples, advisories.select(*PACKAGE, "adv_id", "introduced", "fixed"))
    asking = cut_lineage(pinned.join(placed, [*PACKAGE, "version"]), "intervals")
    asked = asking.select(*pinned.columns, F.explode(_levels(F.col("interval"), bits)).alias("block"))
    answers = cut_lineage(blocks.join(told, [*PACKAGE, "adv_id"]), "blocks")
    rest = [c for c in pinned.columns if c not in (*PACKAGE, "version")]
    return chunked_join(asked, answers, [*PACKAGE, "block"]).select(
        *PACKAGE, "version", *rest, *[c for c in told.columns if c not in PACKAGE])


def severity_counts(found: DataFrame, key: str = "project") -> DataFrame:
    bands = ("critical", "high", "medium", "low", "unknown")
    return found.groupBy(key).agg(
        F.count("*").alias("vulnerabilities"),
        *[F.count_if(F.col("severity") == b).alias(f"n_{b}") for b in bands])

"""Rule packs of any number of rules, as a table: only rules that a line may match are run on it.

Each pattern is taken apart once, by the tasks that read the rules. A text that matches it must hold one of a
few literals, and each literal stands for one of its q-grams, the one that is rarest by its characters.
These q-grams are an index; the distinct q-grams of a line are joined with it, and of the candidates those
whose literal the line holds are run. A rule without such a literal that must match whole lines of a few
lengths is found by the length of the line. Only what is left is run on every line.
"""

from __future__ import annotations

from collections.abc import Sequence
from re import _constants as op, _parser as parser  # the parts of a pattern

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.rules import Rule, first_match
from corpuslens.functions.text import explode_lines
from corpuslens.session import cut_lineage, local_rows, ship_with_tasks

ship_with_tasks(__name__)

GRAM = 3  #: characters of a q-gram
MOST_LENGTHS = 256  #: lengths of lines under which a rule is found at most
PLAN_RULES = 32  #: rules without any index that are columns of the plan at most; more of them are joined
MOST_LITERALS = 64  #: literals that stand for a rule at most; with more of them it has none
_COMMON = {c: 3 for c in "etaoinsrhld "} | {c: 2 for c in "cumfpgwybvkxjqz"} | {c: 1 for c in "0123456789_"}


def _needs(parts) -> list[list[str]]:
    """Sets of lower-case literals of a sequence; a match holds at least one of each set."""
    sets: list[list[str]] = []
    run = ""
    for kind, value in [*parts, (None, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            sets.append([run])
            run = ""
        if kind is op.SUBPATTERN:
            sets += _needs(value[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            sets += _needs(value[2])
        elif kind is op.ATOMIC_GROUP:
            sets += _needs(value)
        elif kind is op.BRANCH:
            best = [_best(_needs(branch)) for branch in value[1]]
            if all(best):
                sets.append([x for b in best for x in b])
    return sets


def _cost(gram: str) -> int:
    return sum(_COMMON.get(c, 0) for c in gram)


def _gram(literal: str) -> str:
    return min((literal[i:i + GRAM] for i in range(len(literal) - GRAM + 1)), key=_cost)


def _best(sets: list[list[str]]) -> list[str]:
    """The set whose literals are all long enough and whose commonest q-gram is the rarest."""
    usable = [s for s in sets if len(s) <= MOST_LITERALS and all(len(x) >= GRAM for x in s)]
    return min(usable, key=lambda s: (max(_cost(_gram(x)) for x in s), len(s)), default=[])


def _parsed(pattern: str):
    """Parts of a pattern, or None for syntax that only the other engine knows."""
    try:
        parts = parser.parse(pattern)
    except Exception:  # noqa: BLE001
        return None
    return None if parts.state.flags & parser.SRE_FLAG_VERBOSE else parts


def required_literals(pattern: str) -> list[str]:
    """Lower-case literals one of which every text that matches holds; empty if none can be told."""
    parts = _parsed(pattern)
    return [] if parts is None else sorted(set(_best(_needs(parts))))


def required_grams(pattern: str) -> list[str]:
    """Lower-case q-grams one of which every text that matches holds; empty if none can be told."""
    return sorted({_gram(x) for x in required_literals(pattern)})


def line_lengths(pattern: str) -> range:
    """Lengths that a text must have to match, if the pattern takes the whole text and they are few; else empty."""
    parts = _parsed(pattern)
    if parts is None or len(parts) < 2 or parts.state.flags & parser.SRE_FLAG_MULTILINE:
        return range(0)
    whole = parts[0] in ((op.AT, op.AT_BEGINNING), (op.AT, op.AT_BEGINNING_STRING)) and parts[-1] in ((op.AT, op.AT_END), (op.AT, op.AT_END_STRING))
    low, high = parts.getwidth()
    # an end may stand in front of a line break of two characters
    return range(low, high + 3) if whole and high - low + 3 <= MOST_LENGTHS else range(0)


_RULE = "ord bigint, pattern string, category string, severity string, message string"
_INDEX = f"kind string, gram string, literal string, n_chars int, {_RULE}"


def _indexed(batches):
    """Rows of the index, of kind ``gram``, ``length`` or ``none``."""
    for rules in batches:
        rows = []
        for rule in rules.itertuples(index=False, name=None):
            literals = required_literals(rule[1])
            lengths = line_lengths(rule[1]) if not literals else ()
            rows += [("gram", _gram(x), x, None, *rule) for x in literals] or [("length", None, None, n, *rule) for n in lengths] or [("none", None, None, None, *rule)]
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in _INDEX.split(", ")], dtype=object)


def pack_findings(files: DataFrame, rules: DataFrame) -> DataFrame:
    """project, path, line, ord, category, severity, message: the first rule (least ``ord``, a number that no
    other rule has) of every line that some rule matches.

    ``files`` has project, path and text, ``rules`` ord, pattern, category, severity and message. A null
    text has no lines, rules with a null pattern are left out, and an empty pack finds nothing. The index
    is broadcast: one row per rule and literal or length.
    """
    spark = files.sparkSession
    names = [f.split()[0] for f in _RULE.split(", ")]
    pack = rules.where("pattern IS NOT NULL AND ord IS NOT NULL").select(F.col("ord").cast("bigint"), *names[1:])
    index = cut_lineage(pack.mapInPandas(_indexed, _INDEX), "rule-index")
    lines = explode_lines(files, "project", "path").select("project", "path", F.col("line_no").alias("line"), F.col("line").alias("line_text"))
    out = ["project", "path", "line", "ord", "category", "severity", "message"]
    kinds = {r[0] for r in index.select("kind").distinct().collect()}
    found = spark.createDataFrame([], "project string, path string, line int, ord bigint, category string, severity string, message string")
    if "gram" in kinds:
        # overlapping q-grams in one pass: an empty match in front of each
        every = F.array_distinct(F.regexp_extract_all("lower_text", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
        lower = lines.withColumn("lower_text", F.lower("line_text"))
        held = lower.withColumn("gram", F.explode(every))
        by_gram = index.where("kind = 'gram'").select("gram", "literal", *names)
        # the literal is looked for first: a pattern that differs from row to row is compiled for each
        found = found.unionByName(held.join(F.broadcast(by_gram), "gram").where("contains(lower_text, literal) AND line_text RLIKE pattern").select(*out))
    if "length" in kinds:
        by_length = index.where("kind = 'length'").select("n_chars", *names)
        found = found.unionByName(lines.withColumn("n_chars", F.length("line_text")).join(F.broadcast(by_length), "n_chars").where("line_text RLIKE pattern").select(*out))
    if "none" in kinds:
        left = index.where("kind = 'none'").select(*names)
        few = sorted(left.limit(PLAN_RULES + 1).collect(), key=lambda r: r["ord"])
        if len(few) > PLAN_RULES:
            found = found.unionByName(lines.join(F.broadcast(left), F.expr("line_text RLIKE pattern")).select(*out))
        else:
            first = first_match(F.col("line_text"), F.col("line"), [Rule(r["pattern"], str(i), "", "") for i, r in enumerate(few)])
            plain = lines.select("project", "path", "line", first["category"].cast("int").alias("_i")).where("_i IS NOT NULL")
            told = F.broadcast(local_rows(spark, [(i, r["ord"], *r[2:]) for i, r in enumerate(few)], "_i int, ord bigint, category string, severity string, message string"))
            found = found.unionByName(plain.join(told, "_i").select(*out))
    best = found.groupBy("project", "path", "line").agg(F.min(F.struct("ord", "category", "severity", "message")).alias("r"))
    return best.select("project", "path", "line", "r.*")


def pack_rows(rules: Sequence[tuple[str, str, str, str]]) -> list[tuple[int, str, str, str, str]]:
    """Rows of a pack table from rules in their order."""
    return [(i, *r) for i, r in enumerate(rules)]

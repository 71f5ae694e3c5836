"""Text checks of documents look at positions and at one lower-case text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.functions.text import section_has, section_slice
from corpuslens.operators import audit

SECTIONS = [
    "## Commands\nrun `x`", "## Commands\n```\nx\n```\n## Next", "## Commands\nx\n## Next\n```", "## COMMON COMMANDS\n\n## Commands\n```",
    "## Commands\n## Common Commands ```", "x\n## Common Commands", "İİİİİİİİİİİİİİİİİİİİİİ ## Commands\n```\n## A\n", "nothing ```",
    "## Commands\n## ```", "## Commands\n##```", "İ## commands```\n## x", "", None,
]


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_section_by_positions(spark):
    low = F.lower("text")
    for needle in ("`", "```"):
        for titles in (("## command",), ("## common command", "## command")):
            got = _rows(spark, SECTIONS).select(
                section_has(F.col("text"), low, needle, *titles).alias("now"),
                F.contains(section_slice(F.col("text"), *titles), F.lit(needle)).alias("slow")).collect()
            assert [r["now"] for r in got] == [r["slow"] for r in got]


def test_said_words_read_the_lowered_text_once(spark):
    rows = spark.createDataFrame([("p", "d", "GreenField in DJANGO"), ("p", "e", None)], "project string, path string, text string")
    facts_of = audit.with_text_facts(rows).select(audit.said_words().alias("said"))
    plan = facts_of._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert [r["said"] for r in facts_of.collect()] == [[w for w in (audit.GREENFIELD, *fixed.AUDITED_FRAMEWORKS) if w in ("greenfield", "django")], []]


def test_phrases_are_looked_for_before_the_pattern(spark):
    texts = ["I want it", "xI want", "We used", "TODO", "TODOS", "a FIXME.", "todo", ""]
    rows = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project string, path string, text string")
    found = audit.text_check_findings(rows, audit.anti_pattern_checks()).collect()
    of = lambda start: sorted(int(r["path"]) for r in found if r["message"].startswith(start))
    assert (of("Uses first-person"), of("Contains TODO")) == ([0], [3, 5])

"""Style and vocabulary patterns run only where one of their literals occurs and find the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuslens.operators import facts, style

CODE = [
    "MAX_A = 'x'\nlong_name_without_sign b='y' c = auto() d== 'z' e=\n\"w\"", "'a'b='c'd=\"e\"", "ÄB1 = 'q' x.Y = auto()=''",
    "def do_it(a: int) -> str:\n    return 'x'\nclass MyError(Exception): pass", "it's 'quoted', [1, ] (2) {3 }", None, "",
]


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_counted_patterns(spark):
    rows = _rows(spark, CODE)
    for pattern in style.HELD:
        got = rows.select(style.hits(pattern).alias("now"), F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).alias("slow")).collect()
        assert [r["now"] for r in got] == [r["slow"] for r in got]
    of = lambda p: F.coalesce(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.array().cast("array<string>"))
    got = rows.select(facts._all(facts.CONSTANT_BY_WORD).alias("now"), of(facts.CONSTANT).alias("slow")).collect()
    assert [r["now"] for r in got] == [r["slow"] for r in got]
    assert got[0]["now"] == ["MAX_A", "b", "c", "e"]
    for pattern in (facts.CLASS_NAME, facts.STRUCT_NAME, facts.ROUTE, facts.ENUM_NAME, *facts.COMMENT_MARKERS):
        got = _rows(spark, [*CODE, "class A", "enum B", "struct C", "app. get('/x')", "# TODO: y // HACK z"]).select(
            facts._all(pattern).alias("now"), of(pattern).alias("slow")).collect()
        assert [r["now"] for r in got] == [r["slow"] for r in got]


def test_semicolons_of_lines_that_end_blank(spark):
    text = "a;  \t\nb; \x0b\nfoo\n// c\n  \n{ \nimport x\n y = 1 ;x"
    rows = spark.createDataFrame([("p", "a.js", text)], "project string, path string, text string")
    got = style.semicolon_votes(rows).select("with_semi", "without_semi").first()
    stripped = [re.sub(r"\s+$", "", x) for x in re.split(r"[\n\x0b]", text)]
    some = [x for x in stripped if x and not re.match(r"//|/\*|\*|import|export", x)]
    assert tuple(got) == (sum(x.endswith(";") for x in some), sum(not re.search(r"[;{}(),]$", x) for x in some))

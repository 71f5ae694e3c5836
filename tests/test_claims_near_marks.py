"""Claims are searched near slashes, lines and folders are found without patterns, all as before."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import around, explode_lines, parent_dirs
from corpuslens.operators import claims

TEXTS = [
    "", " ", "/", "a/b.py", "`a/b.py` (x/y.ts) z/w.md", "see src/core/a.py, not /etc/x.py nor b /c.py or d/ e.py",
    "│a/b.tsx\n├── c/d.json\tq/r.go └x/y/z.rs─m/n.css", "  a/b.py  c/d.py  ", "no mark at all here",
    "x  a/b.py/c.md d", "İ/ü-1.html `İ/ü.html", "a/b.py\ra/b.py\n\na//b.py a/.py", "a b/c d/e.sh f g", None,
]


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_words_away_from_marks_hold_no_claim(spark):
    for bounded in (False, True):
        pattern = F.lit(claims.claimed_path_pattern(bounded))
        got = _rows(spark, TEXTS).select(
            "text", F.regexp_extract_all(around(F.col("text"), "/"), pattern, F.lit(1)).alias("near"),
            F.regexp_extract_all("text", pattern, F.lit(1)).alias("whole")).collect()
        assert [r["near"] for r in got] == [r["whole"] for r in got]
        assert any(r["near"] for r in got)
    assert _rows(spark, ["a bc d/e f/g"]).select(around(F.col("text"), "/")).first()[0] == "a d/e f/g"


def test_file_claims_search_a_part_of_the_text(spark):
    plan = claims.claimed_files(spark.createDataFrame([("p", "d", "a/b.py")], "project string, path string, text string"))
    assert "substring_index" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_lines_and_folders(spark):
    texts = ["a\nb\n", "a\r\nb", "\n", "a\x0bb c\n", "a\n\n", "x"]
    got = [(r["i"], r["line_no"], r["line"]) for r in explode_lines(_rows(spark, texts), "i").orderBy("i", "line_no").collect()]
    assert got == [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines(), 1)]
    paths = ["a", "a/b", "a/b/c.py", "/a", "a//b", "a/", "", None]
    dirs = [r[0] for r in _rows(spark, paths).select(parent_dirs("text")).collect()]
    assert dirs == [["/".join(p.split("/")[:n]) for n in range(1, p.count("/") + 1)] if p else [] for p in paths]

"""Text helpers and detectors against plain Python on small fixtures."""

from __future__ import annotations

import fnmatch
import random
import re
from pathlib import PurePosixPath

import pytest
import regex
from pyspark.sql import functions as F

from conftest import rows
from corpuslens.functions import fixed
from corpuslens.functions.json_text import holds_json, strict_json
from corpuslens.functions.rules import Rule, first_match
from corpuslens.functions.text import explode_lines, glob_regex, line_total, matches_with_line, suffix
from corpuslens.operators import detect, facts, harvest, inventory, style

TEXTS = [
    "a\nb\n", "a\nb", "\n", "\n\n", "x\r\ny\r\n", "x\ry", "a\x0bb\x0cc", "a\x1cb\x1dc\x1e", "p\x85q r ",
    "end\r\n\n", "é\nü\n",
]


def test_lines_equal_splitlines(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got: dict[int, list[str]] = {}
    for i, n, line in rows(explode_lines(df, "i"), "i", "line_no", "line"):
        got.setdefault(i, []).append((n, line))
    for i, t in enumerate(TEXTS):
        assert [x for _, x in sorted(got.get(i, []))] == t.splitlines(), repr(t)
    counts = dict(rows(df.select("i", line_total("text"))))
    assert counts == {i: len(t.splitlines()) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("pattern", [fixed.BARE_EXCEPT, fixed.PY_DEF, fixed.PRINT_CALL, fixed.CONSOLE_LOG])
def test_match_lines_equal_finditer(spark, pattern):
    rng = random.Random(7)
    pieces = ["except:", "  except :", "def f(x):", "    def g(", "print(1)", " print (2)", "console.log(1); console.log (2)",
              "", "   ", "x = 1", "\t", "éé"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {i: [tuple(m) for m in found] for i, found in rows(df.select("i", matches_with_line("t", "(?md)" + pattern)))}
    for i, t in enumerate(texts):
        want = [(t[: m.start()].count("\n") + 1, m.group(0)) for m in regex.finditer(pattern, t, regex.M)]
        assert got[i] == want, repr(t)


def test_globs_and_suffix(spark):
    names = ["node_modules", "x.egg-info", "a.pyc", "src", ".git", "dist2", "mypyc", ".coverage", "b.egg-infos"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(rows(df.select("n", F.concat(F.lit("a/"), "n", F.lit("/b")).rlike(glob_regex(fixed.EXCLUDE_GLOBS)))))
    assert got == {n: any(fnmatch.fnmatch(n, g) for g in fixed.EXCLUDE_GLOBS) for n in names}
    paths = ["a.PY", ".env", "x/.env", "a.tar.gz", "a.", "b/.env.example", "noext", "d.ir/file", "R/x.R"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert dict(rows(df.select("p", suffix("p")))) == {p: PurePosixPath(p).suffix.lower() for p in paths}


def test_debt_signals(files):
    long_fn = "def big(x):\n" + "    x = 1\n" * 55 + "\n\ndef small():\n    pass\n"
    nested = "a\n" + " " * 24 + "deep\n" + "\t" * 6 + "same\n  \t  \t" + " " * 12 + "five\n"
    tree = {
        "src/a.py": "# TODO: x\ntry:\n    pass\n\nexcept:\n    print(1)\nexcept Exception:\n    pass\n# fixme and todo\n",
        "src/b.py": long_fn, "src/c.js": "console.log(1); console.log(2)\n" + nested,
        "src/d.py": "k = 'api-0123456789abcdef01'\nt = \"ghp_" + "a" * 30 + "\"\n",
        "tests/a.py": "try:\n  pass\nexcept:\n  print(2)\n# HACK y\n", "big.go": "x\n" * 501,
    }
    got = rows(detect.debt_findings(files({"p": tree})), "path", "line", "category", "severity")
    assert ("src/a.py", 1, "debt_markers", "medium") in got
    # the match of a multi-line pattern starts on the first blank line in front of it
    assert ("src/a.py", 4, "error_handling", "high") in got
    assert ("src/a.py", 7, "error_handling", "medium") in got
    assert ("src/a.py", 9, "debt_markers", "medium") in got  # first marker of the pack wins: TODO before FIXME
    assert ("src/a.py", 6, "code_quality", "low") in got
    assert [g for g in got if g[0] == "src/b.py"] == [("src/b.py", 1, "complexity", "medium")]
    assert got.count(("src/c.js", 1, "code_quality", "low")) == 2
    assert ("src/c.js", 3, "complexity", "medium") in got
    assert [g[1:] for g in got if g[0] == "src/d.py"] == [(1, "security", "critical"), (2, "security", "critical")]
    assert [g for g in got if g[0] == "tests/a.py"] == [("tests/a.py", 5, "debt_markers", "high")]
    assert ("big.go", None, "complexity", "high") in got
    assert ("<project>", None, "infrastructure", "low") in got and ("<project>", None, "infrastructure", "medium") in got


def test_long_function_ends(files):
    body = "    x\n" * 60
    nested = "def outer():\n    def inner():\n" + body + "def last():\n    y\n"
    got = rows(detect.text_findings(files({"p": {"m.py": nested}}), [], detect.long_function_findings()), "line", "message")
    # a deeper next definition does not end a function: it runs to the end of the file
    assert got == [(1, "Function `outer` is 64 lines (>50)"), (2, "Function `inner` is 61 lines (>50)")]


def test_leaks_and_suppression(files):
    key = "sk-" + "ant-" + "a1" * 12
    tree = {
        # a search command within the first 500 characters would mark the file as a scanner
        "a.py": "pad = 1\n" * 80 + f"x = '{key}'\n# {key}\n// {key}\ngrep {key}\nyour_{key}\n",
        "scan.sh": f"gitleaks run\n{key}\n", "conf.example": f"{key}\npassword = 'hunter22'\n",
        "b.yml": "password: 'hunter22'\npassword: 'changeme'\nurl: postgres://u:p@h/d\nC:\\Users\\bob\\x\n/home/bob/y\n",
        "k.pem": "-----BEGIN " + "EC PRIVATE KEY-----\n", "d/.env": "A=1", "Pitch.MD": "x", "bin.exe": key,
        "z/interview.md": "q", "a-task/take_home.md": "q",
    }
    got = rows(detect.leak_findings(files({"p": tree})), "path", "line", "category", "severity")
    assert [g[1:] for g in got if g[0] == "a.py"] == [(81, "secrets", "critical")]
    assert not [g for g in got if g[0] in ("scan.sh", "conf.example", "bin.exe")]
    assert [g[1:] for g in got if g[0] == "b.yml"] == [
        (1, "credentials", "high"), (3, "credentials", "critical"), (4, "local_paths", "high"), (5, "local_paths", "high")]
    assert ("k.pem", None, "secrets", "critical") in got and ("d/.env", None, "credentials", "critical") in got
    assert ("Pitch.MD", None, "strategy_docs", "high") in got
    assert [g for g in got if g[3] == "low"] == [("a-task/take_home.md", None, "strategy_docs", "low")]


def test_all_leaks_are_reported_in_pages(files):
    from corpuslens.operators import documents

    tree = {"a.yml": "".join(f"password: 'hunter{i:04d}'\n" for i in range(300)), "b.yml": "url: postgres://ü:p@h/d\n"}
    pages = rows(documents.leak_report_pages(detect.leak_findings(files({"p": tree}))), "severity", "page", "content")
    high = [c for s, _, c in pages if s == "high"]
    assert [p for s, p, _ in pages] == [1, 1, 2, 3] and high[0].startswith("### High Priority\n\n- ")
    assert sum(c.count("- ") for c in high) == 300 and [c for s, _, c in pages if s == "critical"][0].count("b.yml:1") == 1


@pytest.mark.parametrize("project", ["p", None])
def test_ranks_of_one_hot_project_are_dealt_out(files, spark, project):
    from corpuslens.operators import documents

    tree = {f"m{i:03d}.py": f"class Name{i:03d}:\n    KEY_{i:03d} = 'x'\n# TODO: do {i}\napp.get('/r{i:03d}')\npassword: 'hunter{i:04d}'\n" for i in range(400)}
    some = files({project: tree}).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for found, value in (
            (facts.class_names(some), lambda i: f"Name{i:03d}"), (facts.route_paths(some), lambda i: f"/r{i:03d}"),
            (facts.constant_names(some), lambda i: f"KEY_{i:03d}"), (facts.marker_comments(some).withColumnRenamed("body", "term"), lambda i: f"do {i}"),
        ):
            got = found.select("project", "position", "term", F.spark_partition_id().alias("task")).collect()
            assert sorted((r[1], r[2], r[0]) for r in got) == sorted((i + 1, value(i), project) for i in range(400))
            assert max(sum(r["task"] == t for r in got) for t in {r["task"] for r in got}) < 400
        plan = documents.leak_report_pages(detect.leak_findings(some))
        assert len(plan.collect()) == 4 and "_part" in plan._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_words_of_all_scripts(files, spark):
    tree = {"src/größe.py": "class Größe:\n    pass\n", "a.yml": "x: /home/müller/data\n"}
    found = rows(detect.leak_findings(files({"p": tree})), "path", "line", "category")
    assert ("a.yml", 1, "local_paths") in found
    assert [t for _, t, _ in rows(facts.class_names(files({"p": tree})), "project", "term", "position")] == ["Größe"]
    error = spark.createDataFrame([("no file /home/müller/x.py here",)], "t string")
    assert rows(error.select(harvest.error_signature(F.col("t")))) == [("no file <PATH> here",)]


def test_scores_keep_clean_projects_and_invariance(files, spark):
    df = files({"dirty": {f"m{i}.py": "# FIXME\n" for i in range(30)}, "clean": {"a.py": "x\n"}})
    findings = detect.debt_findings(df)
    got = dict(rows(detect.scored_projects(df, findings), "project", "score"))
    assert got == {"dirty": 0, "clean": 100}
    shuffled = df.repartition(7, "path").orderBy(F.desc("path"))
    assert rows(detect.debt_findings(shuffled)) == rows(findings)


def test_user_rule_pack_first_match_wins(spark):
    df = spark.createDataFrame([("alpha beta",), ("beta",), ("none",)], "l string")
    rules = [Rule("alpha", "c", "low", "one"), Rule("beta", "c", "high", "two")]
    got = dict(rows(df.select("l", first_match(F.col("l"), F.lit(1), rules)["message"])))
    assert got == {"alpha beta": "one", "beta": "two", "none": None}


def test_detector_registry(files):
    from pyspark.sql import DataFrame

    def empty_files(df: DataFrame) -> DataFrame:
        return df.filter(F.col("text") == "").select(
            "project", "path", F.lit(None).cast("int").alias("line"), F.lit("empty").alias("category"),
            F.lit("low").alias("severity"), F.lit("empty file").alias("message"))

    detect.register_detector("empty", empty_files)
    got = rows(detect.run_detectors(files({"p": {"a.py": "", "b.py": "x"}}), "empty"), "detector", "path")
    assert got == [("empty", "a.py")]


def test_quote_votes_equal_python(files):
    rng = random.Random(3)
    bits = ["'a'", '"b"', "\\'", '\\"', "x", " ", "'", '"', "''", '""', "\n"]
    tree = {f"m{i}.py": "".join(rng.choice(bits) for _ in range(60)) for i in range(40)}
    for path, text in tree.items():
        got = style.style_counts(files({"p": {path: text}})).select("single_py", "double_py").first() if path in ("m0.py", "m1.py") else None
        if got:
            assert tuple(got) == (len(re.findall(r"(?<![\"\\])'[^']*'", text)), len(re.findall(r'(?<![\'\\])"[^"]*"', text)))
    total = style.style_counts(files({"p": tree})).select("single_py", "double_py").first()
    assert tuple(total) == (
        sum(len(re.findall(r"(?<![\"\\])'[^']*'", t)) for t in tree.values()),
        sum(len(re.findall(r'(?<![\'\\])"[^"]*"', t)) for t in tree.values()))


def test_primary_language_tie_goes_to_first_path(files):
    df = files({"p": {"a/z.rs": "", "a-b/a.py": "", "q.sql": "", "r.sql": "", "s.sql": ""}})
    assert rows(inventory.primary_language(inventory.language_counts(df))) == [("p", "Rust")]


def test_enum_variants(files):
    text = "pub enum No {\n    A,\n}\nenum Color {\n    Red,\n    green,\n    Blue }\n    After\nSIZE = 'x'\nlow = 'x'\n"
    got = [t for _, t, _ in rows(facts.constant_names(files({"p": {"a.rs": text}})), "project", "term", "position")]
    assert sorted(got) == ["Blue", "Color", "No", "Red", "SIZE"]


def test_json_validity(spark):
    import json

    cases = ["{}", "[]", "1", '"a"', "null", "true", "{\"a\":1} x", "[1,2", "", " ", "1 2", "{'a':1}", "[1]]", "x", "1,2", '{"a":[1,{"b":null}]}']
    df = spark.createDataFrame([(c,) for c in cases], "t string")

    def valid(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert dict(rows(df.select("t", strict_json(F.col("t"))))) == {c: valid(c) for c in cases}
    fenced = "text\n```json\n{\"a\": 1}\n```\n"
    df = spark.createDataFrame([(fenced,), ("```\nnope\n```",)], "t string")
    assert dict(rows(df.select("t", holds_json(F.col("t"))))) == {fenced: True, "```\nnope\n```": False}


def test_priority_items_make_the_findings_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    kind = "project string, path string, line int, category string, severity string, message string"
    found = spark.createDataFrame([("p", f"f{i:02}", i, "c", "high" if i % 2 else "low", "m") for i in range(30)], kind).mapInArrow(count, kind)
    got = [(r["item"], r["line"], r["more"]) for r in detect.priority_items(found, 10).orderBy("item").collect()]
    assert got == [(k + 1, 2 * k + 1, 5) for k in range(10)] and made.value == 30


def test_line_totals_of_all_breaks(spark):
    texts = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "a\x0bb\n", "a\u2028b", "\n\n", "a\x85", "a\nb\x1e", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", line_total("text")).collect()
    assert [n for _, n in sorted(got)] == [t if t is None else len(t.splitlines()) for t in texts]

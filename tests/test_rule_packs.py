"""Packs of thousands of rules against brute force."""

from __future__ import annotations

import random
import re

import pytest

from conftest import rows
from corpuslens.operators import rule_packs

RULE = "ord bigint, pattern string, category string, severity string, message string"


@pytest.mark.parametrize("pattern, texts", [
    (r"ghp_[A-Za-z0-9]{36}", ["ghp_" + "a1" * 18]),
    (r"(?i)Secret\s*=", ["SECRET =", "xsecret="]),
    (r"(alpha|beta)-key", ["alpha-key", "beta-key"]),
    (r"x?yz{2,}abc", ["yzzabc", "xyzzzabc"]),
    (r"(?:foo|ba)r?", ["foo", "ba"]),
    (r"[Kk]ey_(?=a)abc", ["Key_abc"]),
    (r"\bTODO\b.*owner", ["TODO owner", "a TODO: the owner"]),
    (r"a|b", ["a"]), (r"\d+", ["12"]), (r"", [""]), (r"(?>abc)def", ["abcdef"]), (r"(xyz)*abc", ["abc"]),
    (r"^ab\.cd$", ["ab.cd"]), (r"(?x) a b c d", ["abcd"]), (r"\p{Alpha}+token", ["mytoken"]), (r"(a|)(bcd)?", [""]),
])
def test_required_grams_are_in_every_match(pattern, texts):
    grams = rule_packs.required_grams(pattern)
    for text in texts:
        assert not grams or any(g in text.lower() for g in grams), (pattern, grams, text)


def test_five_thousand_rules_equal_brute_force(spark):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcdefgst_") for _ in range(pick.randint(3, 6)))
    vocabulary = [word() for _ in range(1500)]
    pack = []
    for i in range(5000):
        a, b = pick.choice(vocabulary), pick.choice(vocabulary)
        pattern = (rf"\b{a} {b}\b", rf"(?i){a.upper()}\s+{b}", rf"({a}|{b})-[0-9]+;", rf"{a}[=:]{b}?", rf"^{a}.*{b}$")[i % 5]
        pack.append((i, pattern, f"c{i % 7}", "low", f"rule {i}"))
    pack += [(5000, r"^\d+$", "number", "low", "no literal"), (5001, r".{70,}", "long", "low", "no literal"), (5002, None, "null", "low", "no pattern")]
    texts = []
    for i in range(60):
        lines = [" ".join(pick.choice(vocabulary) + pick.choice(("", "", "-12;", ":" + word(), "=")) for _ in range(pick.randint(0, 9))) for _ in range(pick.randint(0, 12))]
        texts.append((f"p{i % 4}", f"f{i}", "\n".join(lines + ["123", "x" * 80])))
    texts += [("p", "empty", ""), ("p", "null", None), ("p", "short", "a\n\nab")]
    files = spark.createDataFrame(texts, "project string, path string, text string")
    got = rows(rule_packs.pack_findings(files, spark.createDataFrame(pack, RULE)), "project", "path", "line", "ord", "message")
    compiled = [(i, re.compile(p), m) for i, p, _, _, m in pack if p is not None]
    want = []
    for project, path, text in texts:
        for n, line in enumerate((text or "").split("\n"), 1):
            hit = next(((i, m) for i, p, m in compiled if text and p.search(line)), None)
            if hit:
                want.append((project, path, n, *hit))
    assert got == sorted(want, key=repr) and len(want) > 200
    assert sum(not rule_packs.required_grams(p) for _, p, *_ in pack if p) < 300
    assert rule_packs.pack_findings(files, spark.createDataFrame([], RULE)).count() == 0


@pytest.mark.parametrize("pattern, lengths", [
    (r"^.{5}[.][.]?$", {6, 7}), (r"^ab?$", {1, 2}), (r"\A[0-9]{2}\Z", {2}), (r"^a*$", None), (r"a{3}$", None), (r"^a{3}", None),
    (r"(?m)^ab$", None), (r"^a$|b", None), (r"(?x) ^ab$ ", None), (r"^\p{Alpha}$", None), (r"^.{2,900}$", None), (r"^", None),
])
def test_lengths_of_lines(pattern, lengths):
    got = set(rule_packs.line_lengths(pattern))
    assert got >= lengths and len(got) <= len(lengths) + 2 if lengths else not got


def test_rules_without_literals_are_no_columns_of_the_plan(spark):
    """Thousands of rules that hold no literal, found by the length of a line or, where that is open, joined."""
    pack = [(i, f"^.{{{i}}}[.][.]?$", "c", "low", f"whole {i}") for i in range(3000)]
    pack += [(5000 + i, f"[{chr(97 + i % 26)}]{{{1 + i // 26}}}[0-9]+", "c", "low", f"open {i}") for i in range(60)]
    texts = ["x" * n + "." for n in (0, 1, 7, 2999, 3005)] + ["x" * 40 + "..", "aa12", "", "é😀.", "c9 and c8"]
    files = spark.createDataFrame([("p", "f", "\n".join(texts)), ("p", "null", None)], "project string, path string, text string")
    found = rule_packs.pack_findings(files, spark.createDataFrame(pack, RULE))
    got = rows(found, "line", "ord")
    want = []
    for n, line in enumerate(texts, 1):
        hit = next((i for i, p, *_ in pack if re.search(p, line)), None)
        if hit is not None:
            want.append((n, hit))
    assert got == sorted(want, key=repr) and len(want) == 8
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000

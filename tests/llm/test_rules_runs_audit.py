"""Quality ledger, periodic runs and filter audit against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from awkward import EXTRA, SCHEMA, empty, messy, rows_of_documents, words  # noqa: F401
from corpuslens.llm import filter_audit, periodic_runs, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules ------------------------------------------------------------------
def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    trimmed = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)),
        sum(x.startswith(("-", "*", "•")) for x in trimmed), sum(x.endswith(("...", "…")) for x in trimmed),
        sum("A" <= c <= "Z" for c in text), sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w), len(covered))


ODD = [
    (100, "- a b\n* c ...\n• d…\n\n  \nA b c A b c A b c\n- a b\n" + "x y z " * 3),
    (101, "one two three one two three"), (102, "a a a"), (103, "a a a a"), (104, "#$% <|> & * 12 34 ..."),
    (105, "\n".join(["same line"] * 40)), (106, " ".join(f"word{i}" for i in range(60))), (107, "\x0b\x0c\r\n"),
]


def test_ledger_equals_plain_measures(spark, messy, empty):
    docs = rows_of_documents() + [(i, t, "en", "z") for i, t in ODD]
    frame = messy.unionByName(spark.createDataFrame([(i, t, "en", "z", *["x"] * len(EXTRA)) for i, t in ODD], SCHEMA))
    got = Counter(tuple(r[c] for c in ("doc_id", *quality_rules.MEASURES)) for r in quality_rules.ledger(frame).collect())
    assert got == Counter((i, *plain_measures(t)) for i, t, *_ in docs)
    assert quality_rules.ledger(empty).count() == 0


def test_verdicts_and_policies(spark):
    frame = spark.createDataFrame(ODD + [(None, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in quality_rules.quality_verdicts(frame).collect()}
    assert found[106]["kept"] and not found[106]["base_failed"]
    assert found[105]["base_failed"] and not found[105]["kept"] and found[None]["base_failed"]
    for r in found.values():
        for k, (_, condition) in enumerate(quality_rules.RULES):
            assert bool(r["failed"] >> k & 1) == eval(condition, {}, r.asDict()), (r, condition)  # noqa: S307


def test_ablations(spark, empty):
    pick = random.Random(4)
    patterns = [pick.randrange(1 << len(quality_rules.RULES)) & pick.randrange(1 << len(quality_rules.RULES)) for _ in range(300)] + [0] * 20
    got = {tuple(r[:3]): tuple(r[3:]) for r in quality_rules.ablations(spark.createDataFrame([(p,) for p in patterns], "failed bigint")).collect()}
    want = {}
    for policy, version, rules in quality_rules.POLICIES:
        mask = quality_rules.mask_of(rules)
        for rule in rules:
            bit = quality_rules.mask_of([rule])
            beside = [p & mask & ~bit for p in patterns if p & bit]
            also, always = 0, -1
            for b in beside:
                also, always = also | b, always & b
            want[policy, version, rule] = (
                len(patterns), sum(not p & mask for p in patterns), len(beside), sum(p & mask == bit for p in patterns), also, always if beside else 0)
    assert got == want
    nothing = quality_rules.ablations(quality_rules.ledger(empty)).collect()
    assert len(nothing) == len(want) and not any(sum(r[3:]) for r in nothing)


# ---- periodic runs ------------------------------------------------------------------
def plain_runs(w, least_length=6, least_periods=4):
    n, out = len(w), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            long = i - begin + q
            if i > begin and long >= max(least_length, least_periods * q):
                run = w[begin:begin + long]
                if all(run[d:] != run[:-d] for d in range(1, q)):
                    out.append((begin, long, q))
            i += i == begin
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def plain_row(doc_id, text):
    w = plain_planted(doc_id, WORD.findall(text or ""))
    runs = plain_runs(w)
    dropped = {k for s, long, q in runs for k in range(s + q, s + long)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{long},{q}\n" for s, long, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), len(w))


def test_runs_of_sequences():
    pick = random.Random(3)
    for _ in range(1500):
        w = [pick.randint(1, pick.choice((1, 2, 3, 8))) for _ in range(pick.randint(0, 80))]
        if len(w) > 4 and pick.random() < 0.5:
            a, p = pick.randrange(len(w)), pick.randint(1, 15)
            w = w[:a] + (w[a:a + p] * len(w))[:len(w) - a] + [pick.randint(1, 9) for _ in range(pick.randint(0, 20))]
        assert periodic_runs.runs_of_words([b"%d" % x for x in w]) == plain_runs(w)
        # all runs of two periods and more, over the trees alone
        assert sorted(map(tuple, periodic_runs.runs_of_sequence(w, 2, 2).tolist())) == sorted(plain_runs(w, 2, 2))


def test_suffix_tree_extensions():
    pick = random.Random(9)
    for _ in range(60):
        w = [pick.randint(1, 3) for _ in range(pick.randint(2, 40))]
        depths, place, rank, _ = periodic_runs.SuffixTree(w).tour(ordered=True)
        assert [i for _, i in sorted(zip(rank, range(len(w) + 1)))] == sorted(range(len(w) + 1), key=lambda i: w[i:])
        pairs = [(i, j) for i in range(len(w) + 1) for j in range(len(w) + 1) if i != j]
        got = periodic_runs.extensions(depths, place)(*map(np.array, zip(*pairs)))
        for (i, j), long in zip(pairs, got.tolist()):
            assert long == next((k for k, (a, b) in enumerate(zip(w[i:], w[j:])) if a != b), min(len(w) - i, len(w) - j))


def test_runs_of_documents(spark, messy, empty):
    pick = random.Random(12)
    docs = [r[:2] for r in rows_of_documents()]
    more = [(1000 + i, words(i, pick.randint(0, 200))) for i in range(120)]  # a tenth is rewritten
    more += [(2000 + i, f"{words(i, 9)} {(words(50 + i, 1 + i) + ' ') * 7}{words(90 + i, 9)}") for i in range(12)]
    more += [(3000, "ä " * 500), (3001, "a b a b c " * 200), (3002, "x y " * 8), (None, "z " * 30)]
    frame = messy.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*m, "x") for m in more], "doc_id bigint, text string, key string"))
    got = Counter(tuple(r) for r in periodic_runs.run_digests(periodic_runs.periodic_runs(frame, periodic_runs.planted)).collect())
    long = {7}  # the plain version is quadratic: a text without runs is compared by its words alone
    assert Counter(g for g in got.elements() if g[0] not in long) == Counter(plain_row(*d) for d in docs + more if d[0] not in long)
    assert [g[1] for g in got if g[0] == 7] == [len(periodic_runs.runs_of_words(plain_planted(7, words(7, 30000).encode().split())))]
    assert periodic_runs.periodic_runs(empty).count() == 0
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in more if i)


def test_plain_operator_keeps_texts(spark):
    frame = spark.createDataFrame([(1, "so so so so so so it goes"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in periodic_runs.periodic_runs(frame).collect()}
    assert got == {1: ([(0, 6, 1)], "so it goes"), 2: ([], "")}


# ---- filter audit -------------------------------------------------------------------
def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    number = lambda d: filter_audit.NO_ID if d is None else d
    least = {}
    for d, text, _ in docs:
        least[text or ""] = min(least.get(text or "", filter_audit.NO_ID), number(d))
    failing = []
    for d, text, source in docs:
        text = text or ""
        w = WORD.findall(text)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
             "D": bool(re.search(r"[#$%&*|]", text)), "E": number(d) > least[text]}
        failing.append((source or "", {k for k, v in f.items() if v}, d in good and d is not None, d in toxic and d is not None))
    out = Counter()
    for part in {p for p, *_ in failing}:
        mine = [x for x in failing if x[0] == part]
        removed_ever = Counter()
        rows = []
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                here = [x for x in mine if letter in x[1] and not x[1] & before]
                removed_ever[letter] += len(here)
                rows.append(("".join(order), k + 1, letter, sum(not x[1] & (before | {letter}) for x in mine), len(here),
                             sum(letter in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {letter} for x in mine),
                             sum(x[2] for x in here), sum(x[3] for x in here)))
        out.update((part, o, k, *rest, removed_ever[letter]) for o, k, letter, *rest in rows)
    return out


def files_of(spark, path, schema, batches):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("micro_batches", [1, 4])
def test_audit_with_late_smaller_ids(spark, tmp_path, micro_batches):
    base, shout = words(1, 80), words(2, 90).upper()
    docs = [(*r[:2], r[3]) for r in rows_of_documents()]
    # smaller numbers of the same text come in later files, from other parts
    batches = [
        [(900, base, "late"), (901, shout, "late"), (902, shout, None), (903, "# " + base, "")],
        docs,
        [(50, base, "a"), (60, shout, "b"), (50, base, "b"), (70, "# " + base, "a")],
        [(-5, base, "c"), (59, shout, "late"), (None, shout, "a"), (59, shout, "late"), (71, base + " " + base, "c")],
    ]
    labels = [(900, 1, 0), (901, None, 1), (50, 1, None), (59, 0, 1), (59, 1, 0), (-5, 1, 1), (None, 1, 1), (1, 1, 0), (5, None, None)]
    path = str(tmp_path / "documents.parquet")
    rows = [[(i, t, "en", s, *["x"] * len(EXTRA)) for i, t, s in b] for b in batches]
    files_of(spark, path, SCHEMA, rows)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = Counter(tuple(r) for r in filter_audit.interaction_audit(spark, path, told, micro_batches).collect())
    assert got == plain_audit([d for b in batches for d in b], labels)


def test_audit_of_an_empty_table(spark, tmp_path, empty):
    path = str(tmp_path / "documents.parquet")
    empty.write.parquet(path)
    told = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.interaction_audit(spark, path, told).count() == 0


def test_a_hot_text_is_summed_before_the_shuffle(spark):
    frame = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text", "'s' AS source")
    told = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.combined(filter_audit.marked(frame, told)).groupBy("text_key").count()
    assert rows.agg({"count": "max"}).first()[0] <= 4

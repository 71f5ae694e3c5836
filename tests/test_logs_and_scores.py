"""Quotas, chains, drift, feeds and storage against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpuslens.functions import keys
from corpuslens.operators import advisories, chains, drift, licences, repo_health, scans
from corpuslens.operators.ranking import bucketed_rank, carried, global_position
from corpuslens.sources import files as file_source
from corpuslens.sources import suites, tables

T0 = dt.datetime(2024, 1, 30, 12, 0, 0)


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _replay(requests):
    """One request at a time against recorded usage, as a service would decide."""
    limits = {"free": {"audit": 1, "deep_scan": 0}, "pro": {"audit": -1, "deep_scan": 10}}
    usage, out = [], []
    for rid, ts, lic, kind, tier, repo in sorted(requests, key=lambda r: (r[1], r[0])):
        period = ts.strftime("%Y-%m")
        if kind == "audit" and repo:
            used = sum(u[0] == lic and u[1] == "audit" and u[2] == repo for u in usage)
        else:
            used = sum(u[0] == lic and u[1] == kind and u[3] == period for u in usage)
        limit = limits.get(tier, limits["free"]).get(kind, 0)
        allowed = limit == -1 or used < limit
        if allowed:
            usage.append((lic, kind, repo, period))
        out.append((rid, allowed, used + allowed, 0 if not allowed else -1 if limit == -1 else limit - used - 1))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_quota_equals_replay(spark, seed):
    rng = random.Random(seed)
    tiers = {"a": "free", "b": "pro", "c": "odd"}
    requests = []
    for i in range(220):
        lic = rng.choice("aaabc")
        requests.append((i, _at(rng.randint(0, 4 * 86400)), lic, rng.choice(["audit", "audit", "deep_scan", "other"]), tiers[lic],
                         rng.choice([None, "r1", "r2", "r3"])))
    df = spark.createDataFrame(requests, "request_id bigint, ts timestamp, license_id string, scan_type string, tier string, repo_fingerprint string")
    want = _replay(requests)
    for bucket in (3600, 10 * 86400):
        assert rows(licences.quota_admission(df, bucket), "request_id", "allowed", "used", "remaining") == sorted(want, key=repr)


def test_eleventh_deep_scan_is_denied(spark):
    df = spark.createDataFrame([(i, _at(i), "l", "deep_scan", "pro", None) for i in range(11)],
                               "request_id bigint, ts timestamp, license_id string, scan_type string, tier string, repo_fingerprint string")
    last = licences.quota_admission(df).filter("request_id = 10").first()
    assert (last["allowed"], last["used"], last["remaining"]) == (False, 10, 0)


def _retry_reference(requests, window=30):
    out, last = [], {}
    for rid, url, ts, status in sorted(requests, key=lambda r: (r[2], r[0])):
        at = last.get(url)
        hit = at is not None and (ts - at).total_seconds() <= window
        out.append((rid, not hit))
        if not hit and status in ("pending", "error"):
            last[url] = ts
    return sorted(out)


@pytest.mark.parametrize("bucket", [60, 600, 100000])
def test_retries_equal_replay(spark, bucket):
    rng = random.Random(bucket)
    requests = [(0, "u", _at(0), "error"), (1, "u", _at(30), "pending"), (2, "u", _at(31), "error")]
    requests += [(i, rng.choice(["hot", "hot", "hot", "b", "c"]), _at(rng.randint(0, 900)), rng.choice(["pending", "error", "complete"]))
                 for i in range(3, 500)]
    df = spark.createDataFrame(requests, "request_id bigint, repo_url string, created_at timestamp, status string")
    got = rows(chains.suppressed_retries(df, bucket_seconds=bucket), "request_id", "admitted")
    assert got == sorted(_retry_reference(requests), key=repr)
    assert dict(got)[1] is False and dict(got)[2] is True  # exactly 30 s is still suppressed


def test_sessions_equal_replay(spark):
    rng = random.Random(5)
    ttl, under = 100, 30
    uses = [(rng.choice("abcd"), _at(rng.randint(0, 1200))) for _ in range(80)] + [("solo", _at(5))]
    want = {}
    for token, ts in sorted(uses, key=lambda u: u[1]):
        if token not in want:
            want[token] = [ts + dt.timedelta(seconds=ttl), 0, None]
        state = want[token]
        if state[2] is not None:
            continue
        if ts >= state[0]:
            state[2] = ts
        elif (state[0] - ts).total_seconds() < under:
            state[0], state[1] = ts + dt.timedelta(seconds=ttl), state[1] + 1
    df = spark.createDataFrame(uses, "token string, ts timestamp")
    got = {r["token"]: [r["expires_at"], r["renewals"], r["rejected_from"]]
           for r in chains.session_renewals(df, ttl, under).collect()}
    assert got == want


def test_ranks_and_carried_values(spark):
    rng = random.Random(9)
    data = [(rng.choice("aab"), i, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint").repartition(5)
    ranked = bucketed_rank(df, ["k"], F.floor(F.col("t") / 17), [F.col("t")], "n")
    last = carried(df, ["k"], F.floor(F.col("t") / 17), ["t"], {"seen": F.col("v")})
    peak = carried(df, ["k"], F.floor(F.col("t") / 17), ["t"], {"peak": -F.col("v")}, how="max")
    n, seen, best, want = {}, {}, {}, []
    for k, t, v in data:
        n[k] = n.get(k, 0) + 1
        seen[k] = v if v is not None else seen.get(k)
        best[k] = max([x for x in (best.get(k), None if v is None else -v) if x is not None], default=None)
        want.append((k, t, n[k], seen[k], best[k]))
    got = ranked.select("k", "t", "n").join(last.select("k", "t", "seen"), ["k", "t"]).join(peak.select("k", "t", "peak"), ["k", "t"])
    assert rows(got) == sorted(want, key=repr)
    assert [r["p"] for r in global_position(df, ["t"], "p").orderBy("t").collect()] == list(range(200))


def _suite(spark, *checks, weight=1.0):
    data = [("b", i, c.get("type"), c.get("pattern"), c.get("min_words"), c.get("max_words"), c.get("sections"), c.get("threshold"), weight)
            for i, c in enumerate(checks)]
    return spark.createDataFrame(data, "benchmark_id string, check_no int, type string, pattern string, min_words int, max_words int, sections string, threshold double, weight double")


def test_check_types(spark):
    checks = _suite(
        spark, {"type": "pattern_present", "pattern": "HELLO.world"}, {"type": "pattern_absent", "pattern": "bye"},
        {"type": "length_range", "min_words": 2, "max_words": 3}, {"type": "json_valid"},
        {"type": "contains_sections", "sections": "Intro|End"}, {"type": "llm_judge", "threshold": 0.7}, {"type": "odd"})
    outputs = spark.createDataFrame(
        [("r", "m", "b", "hello\nworld", 0.9), ("r2", "m", "b", "# intro **end** bye a b c", None), ("r3", "m", "b", None, 1.0),
         ("r4", "m", "none", "x", 1.0)], "run_id string, model string, benchmark_id string, output string, judge_score double")
    results = drift.benchmark_results(outputs, drift.suites(checks))
    got = {r["run_id"]: (round(r["score"], 4), [x["passed"] for x in r["results"]]) for r in results.collect()}
    assert got["r"] == (round(4 / 7, 4), [True, True, True, False, False, True, False])
    assert got["r2"] == (round(1 / 7, 4), [False, False, False, False, True, False, False])
    assert got["r3"] == (0.0, []) and got["r4"] == (1.0, [])


def test_run_score_and_severity(spark):
    data = [("r", "m", "b1", 1.0, 1.0), ("r", "m", "b2", 0.0, 3.0), ("z", "m", "b1", 1.0, 0.0)]
    df = spark.createDataFrame(data, "run_id string, model string, benchmark_id string, score double, weight double")
    assert rows(drift.run_scores(df), "run_id", "score") == [("r", 0.25), ("z", 0.0)]
    runs = spark.createDataFrame([("a", "m", 0.85), ("b", "m", 0.84), ("c", "m", 0.95), ("d", "m", 1.05), ("e", "x", 0.1)],
                                 "run_id string, model string, score double")
    base = spark.createDataFrame([("m", 1.0)], "model string, score double")
    got = dict(rows(drift.against_baseline(runs, base), "run_id", "severity"))
    assert got == {"a": "critical", "b": "critical", "c": "warning", "d": "improved", "e": "stable"}


def test_judge_failures_score_zero(spark):
    def complete(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        return 'Sure {"score": 1.7} ok' if "good" in prompt else "no json"

    df = spark.createDataFrame([("1", "good"), ("2", "boom"), ("3", "bad")], "run_id string, output string")
    assert rows(drift.judge_outputs(df, complete, "c")) == [("1", 1.0, True), ("2", 0.0, False), ("3", 0.0, False)]


def test_key_checks(spark):
    config = {"alpha": ("ALFA", "s1")}
    import hashlib

    check = hashlib.sha256(b"s1:AB12-CD34").hexdigest()[:4].upper()
    good = f"ALFA-AB12-CD34-{check}"
    df = spark.createDataFrame([(good,), (good.lower(),), ("ALFA-AB12-CD34-ZZZZ",), ("ALFA-AB12",), (f" {good} ",)], "k string")
    got = {r[0]: tuple(r[1:]) for r in df.select(
        "k", keys.key_format_ok(F.col("k"), F.lit("alpha"), config), keys.key_checksum_ok(F.col("k"), F.lit("alpha"), config),
        keys.masked_key(F.col("k"))).collect()}
    assert got[good] == (True, True, f"ALFA-****-****-{check}") and got[f" {good} "][:2] == (True, True)
    assert got[good.lower()][:2] == (False, False) and got["ALFA-AB12-CD34-ZZZZ"][:2] == (True, False)
    assert got["ALFA-AB12"] == (False, False, "****-****-****-****")


def test_version_ranges(spark):
    deps = spark.createDataFrame([("p", "x", "1.10.0", "npm"), ("q", "x", "1.9", "npm"), ("r", "x", "", "npm"), ("s", "x", "2.0.0", "npm")],
                                 "project string, name string, version string, ecosystem string")
    adv = spark.createDataFrame([("A", None, "x", "npm", "1.9.1", "2.0", "9.1", "s"), ("B", "CVE-1", "x", "npm", "1.0", None, "vector", "s")],
                                "adv_id string, alias string, name string, ecosystem string, introduced string, fixed string, cvss string, summary string")
    got = rows(advisories.vulnerabilities(deps, adv), "project", "cve_id", "severity")
    assert got == [("p", "A", "critical"), ("p", "CVE-1", "low"), ("q", "CVE-1", "low"), ("s", "CVE-1", "low")]


def test_day_ages_and_branch_plan(spark):
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    now = dt.datetime(2024, 6, 1)
    data = [("p", 1, "old", now - dt.timedelta(days=90)), ("p", 2, "edge", now - dt.timedelta(days=90) + dt.timedelta(seconds=1)),
            ("p", 3, "older", now - dt.timedelta(days=91))]
    issues = spark.createDataFrame(data, "project string, number bigint, title string, updated_at timestamp")
    assert [t for (t,) in rows(repo_health.stale_issue_plan(issues, as_of), "target")] == ["#1: old", "#3: older"]
    assert tuple(repo_health.stale_issues(issues, as_of).first())[1:] == (3, 1, 2)
    prs = spark.createDataFrame([("p", 5, "t", now, False, "merged", "feat/x"), ("p", 6, "t", now, False, "merged", "main"), ("p", 7, "t", now, False, "merged", "gone")],
                                "project string, number bigint, title string, updated_at timestamp, is_draft boolean, state string, head_ref string")
    branches = spark.createDataFrame([("p", "feat/x"), ("p", "main")], "project string, name string")
    assert rows(repo_health.merged_branch_plan(prs, branches), "target") == [("branch `feat/x` (merged in PR #5)",)]


def test_empty_scan_metrics_and_skip_at_equality(spark):
    schema = "scan_id string, repo_url string, status string, score bigint, scan_type string, created_at timestamp, completed_at timestamp, user_id bigint"
    empty = spark.createDataFrame([], schema)
    assert tuple(scans.scan_totals(empty).first()) == (0, 0, 0.0, 0.0)
    done = spark.createDataFrame([("s", "u", "complete", 100, "free", _at(0), _at(10), 1)], schema)
    repos = spark.createDataFrame([("p", "u", _at(10)), ("q", "v", _at(0))], "project string, repo_url string, pushed_at timestamp")
    assert rows(scans.rescan_plan(repos, done), "project", "action") == [("p", "skip"), ("q", "scan")]


def test_history_skips_corrupt_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame([("r1", _at(0), "m", 0.5, 0.0, "stable"), ("r2", _at(9), "m", 0.7, 0.2, "improved")],
                                 "run_id string, ts timestamp, model string, score double, delta double, severity string")
    suites.save_runs(runs, path)
    (tmp_path / "runs" / "date=2024-01-30" / "bad.json").write_text('{"run_id": "x"\n{"run_id": "y", "ts": "2024-01-30T00:00:00Z", "score": 7}\n')
    assert rows(suites.load_runs(spark, path), "run_id") == [("r1",), ("r2",)]
    trend = tmp_path / "trend"
    trend.mkdir()
    (trend / "t.json").write_text("not a list\n")
    assert suites.load_trend(spark, str(trend), "run_id string, score double").count() == 0


def test_event_log_append_and_reset(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("command", "audit", _at(0))], "event_type string, name string, ts timestamp")
    tables.append_events(events, path)
    tables.append_events(events, path)
    assert spark.read.parquet(path).count() == 2
    other = str(tmp_path / "reset")
    tables.reset_events(spark, other, "event_type string, name string, ts timestamp")
    assert spark.read.parquet(other).count() == 0


def test_read_corpus(spark, tmp_path):
    def put(path, data):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    put("p1/src/a.py", b"x\ny\n")
    put("p1/bin.dat", b"a\x00b")
    put("p1/bad.txt", b"caf\xe9\n")
    put("p1/node_modules/x.js", b"1")
    put("p2/big.txt", b"x" * 2048)
    df = file_source.read_corpus(spark, str(tmp_path), max_kb=1)
    assert rows(df, "project", "path", "text", "size_bytes", "skipped") == [
        ("p1", "bad.txt", "caf�\n", 5, None), ("p1", "bin.dat", None, 3, "binary"), ("p1", "src/a.py", "x\ny\n", 4, None),
        ("p2", "big.txt", None, 2048, "oversize")]


def test_read_corpus_is_listed_by_tasks(spark, tmp_path):
    """No file index of Spark, which would hold the status of every file in the driver; the same names are left out."""
    for path in ("p/a.py", "p/d e/b.txt", "p/_c/x.py", "p/.d/x.py", "p/_k=1/c.py", "p/_metadata", "p/f._COPYING_", "top.md", ".git/config"):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(path)
    (tmp_path / "p/empty.py").touch()
    df = file_source.read_corpus(spark, str(tmp_path))
    assert not [n for n in ("binaryFile", "FileIndex", "FileScan") if n in df._jdf.queryExecution().toString()]
    assert rows(df, "project", "path", "text") == [
        ("p", "_k=1/c.py", "p/_k=1/c.py"), ("p", "_metadata", "p/_metadata"), ("p", "a.py", "p/a.py"), ("p", "d e/b.txt", "p/d e/b.txt"), ("top.md", "top.md", "top.md")]
    assert rows(file_source.read_corpus(spark, f"file://{tmp_path}", glob_filter="[!b]*.{py,md}"), "path") == [("_k=1/c.py",), ("a.py",), ("top.md",)]


def test_suite_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "benchmarks": [
        {"id": "b", "prompt": "p", "checks": [{"type": "contains_sections", "sections": ["A", "B"]}]}]}))
    got = suites.suite_checks(suites.read_suites(spark, str(tmp_path))).select("benchmark_id", "weight", "type", "sections", "threshold").first()
    assert tuple(got) == ("b", 1.0, "contains_sections", "A|B", 0.8)


def test_groups_may_span_batches():
    import numpy as np
    import pandas as pd

    pick = np.random.default_rng(1)
    for _ in range(30):
        keys = np.sort(pick.integers(0, 5, 40))
        whole = pd.DataFrame({"key": keys, "bucket": np.zeros(40, int), "t": pick.integers(0, 99, 40)})
        cuts = [0, *np.sort(pick.integers(0, 41, 6)), 40]
        sums = chains.per_group(["key", "bucket"], lambda g: {"key": g["key"][:1], "n": np.array([len(g["t"])]), "t": np.array([g["t"].sum()])})
        got = pd.concat(list(sums(whole.iloc[a:b] for a, b in zip(cuts, cuts[1:]))))
        want = whole.groupby("key").agg(n=("t", "size"), t=("t", "sum")).reset_index()
        assert got.reset_index(drop=True).equals(want.astype(got.dtypes.to_dict()))
        times = np.unique(pick.integers(0, 500, 60))
        for i, last in enumerate(chains._exits(times, 40)):
            at = times[i]
            while (times > at + 40).any():
                at = times[times > at + 40][0]
            assert at == last


#: In rising order; those of one line are equal.
PYTHON_VERSIONS = [
    ["0"], ["1.0.dev456", "1.0.0.dev456"], ["1.0a1"], ["1.0a2.dev456"], ["1.0a12.dev456"], ["1.0a12", "1.0.alpha-12"], ["1.0b1.dev456"], ["1.0b2"], ["1.0b2.post345.dev456"],
    ["1.0b2.post345", "1.0b2-345"], ["1.0rc1.dev456"], ["1.0rc1", "1.0c1", "1.0-preview1"], ["1.0", "1", "v1.0.0"], ["1.0+abc.5"], ["1.0+abc.7"], ["1.0+5"], ["1.0.post456.dev34"], ["1.0.post456", "1.0.r456"],
    ["1.0.15"], ["1.1.dev1"], ["1.2.3.4.5"], ["1.2.3.4.5.0.1"], ["1.9"], ["1.10"], ["1.123456789012345678901234567890"], ["2024.1"], ["1!0.1"], ["1!2"],
]
SEMANTIC_VERSIONS = [
    ["1.0.0-1"], ["1.0.0-2"], ["1.0.0-10"], ["1.0.0-alpha"], ["1.0.0-alpha.1"], ["1.0.0-alpha.beta"], ["1.0.0-beta"], ["1.0.0-beta.2"], ["1.0.0-beta.11"], ["1.0.0-rc.1", "1.0.0-rc.1+build.5"],
    ["1.0.0", "1.0", "v1"], ["1.0.1"], ["1.2.3.4.5"], ["1.10.0"], ["2.0.0"],
]


def test_version_keys_sort_as_versions(spark):
    from corpuslens.functions.versions import version_key

    for ecosystem, order in (("PyPI", PYTHON_VERSIONS), ("npm", SEMANTIC_VERSIONS)):
        frame = spark.createDataFrame([(i, v, ecosystem) for i, same in enumerate(order) for v in same], "place int, version string, ecosystem string")
        found = frame.withColumn("key", version_key(F.col("version"), F.col("ecosystem"))).collect()
        by_place = {}
        for r in found:
            assert by_place.setdefault(r["place"], r["key"]) == r["key"], r
        keys = [by_place[i].encode() for i in range(len(order))]
        assert all(a < b for a, b in zip(keys, keys[1:])), [(order[i], order[i + 1]) for i in range(len(keys) - 1) if keys[i] >= keys[i + 1]]
    none = spark.createDataFrame([("latest", "PyPI"), ("", "npm"), ("1.x", "npm"), (">=1", "PyPI"), (None, "npm")], "version string, ecosystem string")
    assert all(r[0] is None for r in none.select(version_key(F.col("version"), F.col("ecosystem"))).collect())


def test_affected_versions_equal_every_range_tested(spark):
    pick = random.Random(11)
    order = [v for same in PYTHON_VERSIONS for v in same]
    place = {v: i for i, same in enumerate(PYTHON_VERSIONS) for v in same}
    versions = [("PyPI", name, v) for name in ("x", "y", "z") for v in order]
    ranges = []
    for k in range(120):  # x is hit by many ranges, z by none
        low, high = (pick.choice(order + [None]) for _ in range(2))
        ranges.append(("PyPI", pick.choice(("x", "x", "x", "y", "w")), f"A{k}", low, high))
    ranges.append(("PyPI", "y", "odd", "latest", None))  # an end that is no version: never
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    got = advisories.affected_versions(
        frame(versions, "ecosystem string, name string, version string"), frame(ranges, "ecosystem string, name string, adv_id string, introduced string, fixed string"))
    want = [(n, v, a) for _, n, v in versions for _, m, a, low, high in ranges
            if n == m and a != "odd" and (low is None or place[low] <= place[v]) and (high is None or place[v] < place[high])]
    assert rows(got, "name", "version", "adv_id") == sorted(want, key=repr) and len(want) > 500
    assert advisories.affected_versions(frame([], "ecosystem string, name string, version string"), frame([], "ecosystem string, name string, adv_id string, introduced string, fixed string")).count() == 0


def test_errors_alike_for_a_signature_are_told_apart_by_their_whole_text(spark):
    from corpuslens.operators import harvest

    same = "Command failed: " + "x" * 500
    texts = [same + " first /tmp/a", same + " second /tmp/b", same + " first /tmp/c"]
    items = [("s", 2 * i + k, kind, f"t{i}", "Bash" if k == 0 else None, "/w", k == 1, t) for i, t in enumerate(texts) for k, kind in enumerate(("use", "result"))]
    frame = spark.createDataFrame(items, "session string, pos bigint, kind string, tool_id string, tool string, cwd string, is_error boolean, text string")
    short, whole = (harvest.paired_errors(frame, **cut) for cut in ({}, {"read": None, "kept": None, "example": None}))
    assert rows(harvest.gotchas(short, min_count=1), "count") == [(3,)]
    assert rows(harvest.gotchas(whole, min_count=1), "count") == [(1,), (2,)]
    assert short.select("text_sha256").distinct().count() == 3 and rows(whole, "example") == sorted((t,) for t in texts)


def test_hits_of_one_popular_package_are_dealt_to_many_tasks(spark):
    """Every dependency has the same package and version, and every advisory holds it: no task makes most hits."""
    deps = spark.range(300).select(F.format_string("p%d", F.col("id") % 3).alias("project"), F.lit("x").alias("name"), F.lit("1.5").alias("version"), F.lit("npm").alias("ecosystem"), "id")
    adv = spark.range(200).select(F.format_string("A%d", "id").alias("adv_id"), F.lit(None).cast("string").alias("alias"), F.lit("x").alias("name"), F.lit("npm").alias("ecosystem"),
                                  F.lit("1.0").alias("introduced"), F.lit("2.0").alias("fixed"), F.lit("5").alias("cvss"), F.lit("s").alias("summary"))
    # the same advisory again with a range that overlaps: told twice, as its rows are, and not four times
    twice = adv.where("adv_id = 'A7'").withColumn("fixed", F.lit("3.0"))
    found = advisories.vulnerabilities(deps, adv.unionByName(twice))
    assert found.count() == 300 * 201 and found.distinct().count() == 300 * 201
    left, right = deps.select("name", "id"), adv.select("name", "adv_id")
    pairs = advisories.chunked_join(left, right, ["name"], chunk=20)
    assert pairs.count() == 300 * 200 and pairs.distinct().count() == 300 * 200
    most = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.6 * 300 * 200
    assert advisories.chunked_join(left.where("false"), right, ["name"]).count() == 0

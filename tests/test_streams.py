"""Keyed stream decisions over several micro-batches, one file each."""

from __future__ import annotations

import datetime as dt
import time

from conftest import rows
from corpuslens.streaming import jobs

DAY = 86_400
START = dt.datetime(2024, 1, 1)


def replay(spark, path, schema, batches):
    """A stream that brings one file per micro-batch, in the given order."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        if i + 1 < len(batches):
            time.sleep(0.05)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(days: float) -> dt.datetime:
    return START + dt.timedelta(seconds=days * DAY)


def state_rows(progress):
    """Rows of keyed state after the last micro-batch, timers included."""
    return progress[-1]["stateOperators"][-1]["numRowsTotal"]


def test_sessions_over_batches(spark, tmp_path):
    schema = "token string, ts timestamp, use_id bigint, kind string, owner string"
    stream = replay(spark, str(tmp_path / "uses"), schema, [
        [("a", at(0), 1, "login", "u"), ("a", at(1), 2, "use", "u"), ("b", at(0), 3, "login", "u"), ("z", at(1), 20, "use", "u")],
        [("a", at(25), 4, "use", "u"), ("b", at(40), 5, "use", "u"), ("c", at(40), 6, "login", "v"), ("d", at(40), 12, "login", "v")],
        [("a", at(54), 7, "use", "u"), ("b", at(41), 8, "use", "u"), ("c", at(41), 9, "revoke", "v"), ("a", at(53.97), 21, "use", "u")],  # out of order
        [("a", at(90), 10, "use", "u"), ("c", at(89.99), 11, "use", "v"), ("e", at(90), 13, "login", "w"), ("f", at(90), 14, "login", "w"), ("b", at(3), 99, "use", "u")],  # the last one is late
        [("x", at(91), 15, "revoke_all", "w"), ("e", at(92), 16, "use", "w"), ("f", at(93), 17, "use", "w")],
        [("g", at(200), 18, "login", "w")],
    ])
    progress = []
    got = {i: o for i, o in rows(jobs.run_append(jobs.session_stream(stream), "sessions-test", progress=progress), "use_id", "outcome")}
    assert got == {
        1: "issued", 2: "used", 20: "rejected", 4: "renewed", 21: "renewed", 7: "used", 10: "rejected",  # renewed at day 25 and 53.97
        3: "issued", 5: "rejected", 8: "rejected", 6: "issued", 12: "issued", 9: "revoked", 11: "rejected",
        13: "issued", 14: "issued", 15: "revoked", 16: "rejected", 17: "rejected", 18: "issued"}
    assert state_rows(progress) <= 3  # session g and its timers: what expired or was revoked is gone


def test_first_use_issues_without_kinds(spark, tmp_path):
    schema = "token string, ts timestamp, use_id bigint"
    stream = replay(spark, str(tmp_path / "uses"), schema, [[("a", at(0), 1), ("a", at(1), 2)], [("a", at(25), 3), ("b", at(25), 4)]])
    got = rows(jobs.run_append(jobs.session_stream(stream), "sessions-test"), "use_id", "outcome")
    assert got == [(1, "issued"), (2, "used"), (3, "renewed"), (4, "issued")]


def test_retries_over_batches(spark, tmp_path):
    schema = "request_id bigint, repo_url string, status string, created_at timestamp"
    second = 1 / DAY
    stream = replay(spark, str(tmp_path / "requests"), schema, [
        [(1, "r", "pending", at(0)), (2, "r", "pending", at(20 * second))],
        [(3, "r", "pending", at(30 * second)), (4, "r", "pending", at(31 * second))],
        [(5, "r", "complete", at(100 * second)), (6, "r", "pending", at(101 * second))],
        [(7, f"r{i}", "error", at(500 * second)) for i in range(1)] + [(8 + i, f"q{i}", "error", at((501 + i) * second)) for i in range(20)],
        [(40, "s", "complete", at(2000 * second))],
    ])
    progress = []
    got = dict(rows(jobs.run_append(jobs.retry_stream(stream, 30), "retries-test", progress=progress), "request_id", "admitted"))
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 40: True} | {i: True for i in range(7, 28)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) >= 21 and state_rows(progress) == 0


def test_quota_over_batches(spark, tmp_path):
    schema = "request_id bigint, license_id string, scan_type string, repo_fingerprint string, tier string, ts timestamp"
    deep = lambda i, day: (i, "l", "deep_scan", None, "pro", at(day))
    stream = replay(spark, str(tmp_path / "quota"), schema, [
        [deep(i, 0.1 * i) for i in range(6)], [deep(i, 0.1 * i) for i in range(6, 12)], [deep(12, 40)],
        [deep(13, 80)], [deep(14, 400), deep(99, 10)],  # the second one is late
        [deep(15, 500)]])
    progress = []
    got = sorted(rows(jobs.run_append(jobs.quota_stream(stream), "quota-test", progress=progress), "request_id", "allowed", "used"))
    assert got == [(i, i < 10 or i >= 12, min(i + 1, 10) if i < 12 else 1) for i in range(16)]
    assert state_rows(progress) <= 3  # the last month and its timer


def test_repository_quotas_stay(spark, tmp_path):
    schema = "request_id bigint, license_id string, scan_type string, repo_fingerprint string, tier string, ts timestamp"
    stream = replay(spark, str(tmp_path / "quota"), schema, [[(10 * k + i, "l", "audit", "repo", "free", at(40 * k + i)) for i in range(4)] for k in range(3)])
    got = sorted(rows(jobs.run_append(jobs.quota_stream(stream), "quota-test"), "request_id", "allowed", "used", "limit"))
    limit = got[0][3]
    assert [g[1] for g in got] == [i < limit for i in range(12)] and got[-1][2] == limit


BILLING = "event_id bigint, ts timestamp, event_type string, subscription_id string, product string, bundle_products string, email string"


def billing(i, day, kind, sub, product="alpha", listed=""):
    return (i, at(day), {"buy": "checkout.session.completed", "end": "customer.subscription.deleted", "fail": "invoice.payment_failed"}[kind], sub, product, listed, "u@example.org")


def licence_versions(spark, path, batches):
    progress = []
    stream = replay(spark, path, BILLING, batches)
    out = jobs.run_batches(jobs.licence_stream(stream, ("alpha", "beta")), "billing-test", lambda b: b, progress=progress)
    got = {(r["checkout_id"], r["item_no"]): (r["product"], r["revoked_at"]) for r in jobs.latest_updates(out, "checkout_id", "item_no").collect()}
    return got, progress


def test_licence_states_over_batches(spark, tmp_path):
    batches = [
        [billing(1, 0, "buy", "s", "bundle"), billing(2, 0.5, "fail", "s"), billing(3, 1, "buy", "t", "beta")],
        [billing(4, 2, "end", "s"), billing(5, 1.999, "end", "s")],  # the earlier one counts
        [billing(6, 3, "buy", "s", "bundle", "gamma, delta,"), billing(6, 3, "buy", "s", "bundle", "gamma, delta,"), billing(7, 2.99, "end", "t")],
        [billing(3, 1, "buy", "t", "beta"), billing(8, 4, "buy", "t"), billing(9, 3.99, "end", "s")],  # the first comes again, too late
        [billing(10, 30, "end", "nobody"), billing(11, 30, "buy", "v")],
    ]
    got, progress = licence_versions(spark, str(tmp_path / "billing"), batches)
    assert got == {
        (1, 0): ("alpha", at(1.999)), (1, 1): ("beta", at(1.999)), (3, 0): ("beta", at(2.99)), (6, 0): ("gamma", at(3.99)), (6, 1): ("delta", at(3.99)),
        (8, 0): ("alpha", None), (11, 0): ("alpha", None)}
    # a delivery of all files twice changes nothing
    again, _ = licence_versions(spark, str(tmp_path / "again"), [b * 2 for b in batches])
    assert again == got
    assert progress[-1]["stateOperators"][-1]["numRowsTotal"] <= 8  # open licences, and what the watermark hasn't passed


def test_licence_state_does_not_grow_with_the_log(spark, tmp_path):
    """Sixty subscriptions are bought and ended, a hundred events each batch: what a batch holds at its end stays."""
    batches = [[billing(1000 * k + i, 10 * k + i / 1000, "buy", f"s{k}-{i}") for i in range(60)]
               + [billing(1000 * k + 500 + i, 10 * k + 1 + i / 1000, "end", f"s{k}-{i}") for i in range(60)] for k in range(5)]
    got, progress = licence_versions(spark, str(tmp_path / "billing"), batches)
    assert len(got) == 300 and all(end is not None for _, end in got.values())
    held = [p["stateOperators"][-1]["numRowsTotal"] for p in progress if p["numInputRows"]]
    assert held[-1] <= 1.5 * held[0]


def test_events_that_come_twice_count_once(spark, tmp_path):
    schema = "session string, pos bigint, ts timestamp, tool string, signature string"
    second = 1 / DAY
    piece = [[(f"s{i % 3}", 10 * k + i, at((600 * k + i) * second), "t", "sig") for i in range(6)] for k in range(4)]
    once, twice = (rows(jobs.run_append(jobs.rolling_gotchas(replay(spark, str(tmp_path / f"errors{n}"), schema, pieces), "10 minutes", "5 minutes", ["session", "pos"]), "g"), "start", "n", "sessions")
                   for n, pieces in ((1, piece), (2, [piece[0], piece[0] + piece[1], piece[1], piece[2], piece[3]])))
    assert once == twice and [(n, s) for _, n, s in once] == [(6, 3)] * 2  # the windows that the watermark has passed


def test_active_users_by_bitmaps(spark, tmp_path):
    schema = "user_id bigint, ts timestamp"
    events = [[(u, at(day + u / 1e6)) for u in range(day * 7, day * 7 + 40_000, 997)] for day in range(10)] + [[(1, at(12))]]
    stream, progress = replay(spark, str(tmp_path / "events"), schema, events), []
    daily = jobs.run_append(jobs.daily_users(stream), "daily", progress=progress)
    got = {r["from_day"]: r["users"] for r in jobs.active_users(daily, jobs.last_watermark(progress)).collect()}
    want = {}
    for start in range(-6, 5):
        users = {u for day in range(max(0, start), min(10, start + 7)) for u, _ in events[day]}
        want[at(start)] = len(users)
    assert got == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 8  # a bitmap per open day and 32,768 ids


def test_rows_of_a_popular_key_are_decided_in_order_and_small():
    """Many rows of one key, in any order: sorted by time and number, far below a hundred bytes a row."""
    import tracemalloc

    from pyspark.sql import Row
    from corpuslens.streaming import keyed

    n = 300_000
    rows_of = (Row(request_id=(i * 7_919) % n, t=1_700_000_000_000_000 + ((i * 7_919) % n) // 3, status=("error", None, "complete")[i % 3]) for i in range(n))
    tracemalloc.start()
    count, last = 0, (0, -1)
    for t, number, _ in keyed._in_order(rows_of, "request_id", "status"):
        assert (t, number) > last
        count, last = count + 1, (t, number)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and peak < 100 * n
    odd = [Row(request_id=i, t=t, status=None) for i, t in ((5, 2), (None, 1), (4, 2), (0, 1))]
    assert [r[:2] for r in keyed._in_order(odd, "request_id")] == [(1, None), (1, 0), (2, 4), (2, 5)]
    assert list(keyed._in_order([], "request_id", "status")) == []


class CountedState:
    """A list state and the timers of one bucket, which count the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def getListState(self, name, schema):
        outer, kept = self, self.rows.setdefault(name, [])

        class State:
            def __getattribute__(self, call):
                outer.calls += 1
                return {"get": lambda: iter(list(kept)), "put": lambda rows: kept.__setitem__(slice(None), rows), "appendList": kept.extend, "clear": kept.clear}[call]

        return State()

    def __getattr__(self, call):
        self.calls += 1
        return {"listTimers": lambda: iter(list(self.timers)), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[call]


def test_a_bucket_of_many_keys_costs_few_state_calls():
    """Sessions and licences of two thousand keys in one bucket: calls and timers are those of the bucket."""
    import pandas as pd
    from corpuslens.streaming import keyed

    n, day = 2_000, DAY * 1_000_000
    held = CountedState()
    licences = keyed.LicenceStates()
    licences.init(held)
    told = lambda ended, t: pd.DataFrame({
        "ended": [ended] * n, "subscription_id": [f"s{i}" if i else None for i in range(n)], "t": [t + i for i in range(n)], "checkout": [str(i) if i != 1 else None for i in range(n)],
        "email": [None] * n, "bundle_id": ["b"] * n, "item_no": [0] * n, "product": ["p"] * n})
    assert sum(map(len, licences.handleInputRows((0,), iter([told(False, 0)]), None))) == n
    out = pd.concat(licences.handleInputRows((0,), iter([told(True, day)]), None))
    assert out["revoked"].tolist() == [day + i for i in range(n)] and out["subscription_id"][0] is None and out["checkout"][1] is None
    assert held.calls <= 20 and len(held.timers) == 1
    licences.forget((day + n) // 1000 + 1)
    assert not held.rows["items"] and not held.rows["ended"] and not held.timers

    held = CountedState()
    sessions = keyed.SessionDecisions(30 * day, 7 * day, False)
    sessions.init(held)
    used = lambda kind, t: pd.DataFrame({
        "owner": [f"o{i}" for i in range(n)], "token": ["x"] * n, "use_id": range(n), "given": [True] * n, "kind": [kind] * n, "t": [t + i for i in range(n)]})
    assert set(pd.concat(sessions.handleInputRows((0,), iter([used("login", 0)]), None))["outcome"]) == {"issued"}
    out = pd.concat(sessions.handleInputRows((0,), iter([used("use", 25 * day)]), None))
    assert set(out["outcome"]) == {"renewed"} and out["expires_t"].tolist() == [55 * day + i for i in range(n)]
    assert held.calls <= 20 and len(held.timers) == 1

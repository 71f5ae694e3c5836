"""Keyed stream decisions: one object per kind of key, with named state and event-time timers.

What can no longer change a decision leaves the state when the watermark passes it: a month that
is over, a suppression window, an expired or revoked session, a cancellation and the licences that it
ended. Sessions and licences, of which there are as many as owners and subscriptions, are decided by the
bucket: rows and state of a bucket come and go as a whole, with one timer, so that a key costs no calls of
its own; a micro-batch reads the state of the buckets that it touches. Quotas and retries read and write
their state entry by entry. Rows are held as numbers until they are decided in their order.
"""

from __future__ import annotations

import datetime as dt
import pickle
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuslens.session import ship_with_tasks

ship_with_tasks(__name__)


def _month_end(period: str) -> int:
    """First millisecond after a month ``yyyy-MM``."""
    year, month = map(int, period.split("-"))
    after = dt.datetime(year + month // 12, month % 12 + 1, 1, tzinfo=dt.timezone.utc)
    return int(after.timestamp() * 1000)


def _in_order(rows: Iterator[Row], number: str, *names: str) -> Iterator[tuple]:
    """(t, ``number``, other values) of rows by t and number, null numbers first. Numbers lie in arrays, other
    values once: rows of a popular key as objects fill a worker."""
    t, numbers, given, at = array("q"), array("q"), array("b"), [array("i") for _ in names]
    codes: list[dict] = [{} for _ in names]
    for r in rows:
        n = r[number]
        t.append(r.t)
        numbers.append(0 if n is None else n)
        given.append(n is not None)
        for name, column, code in zip(names, at, codes):
            column.append(code.setdefault(r[name], len(code)))
    order = np.lexsort([np.frombuffer(c, c.typecode) for c in (numbers, given, t)]) if t else np.empty(0, "int64")
    values = [list(code) for code in codes]
    for begin in range(0, len(order), 65_536):
        for i in order[begin:begin + 65_536].tolist():
            yield (t[i], numbers[i] if given[i] else None, *[v[c[i]] for v, c in zip(values, at)])


class _Keyed(StatefulProcessor):
    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget(expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


class QuotaDecisions(_Keyed):
    """Per (licence, type): requests recorded per month, and per repository over all time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "period string", "used bigint")
        self.repos = handle.getMapState("repos", "repo string", "used bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used, new_months = {}, set()

        def count(state, name):
            if (state, name) not in used:
                known = state.getValue((name,))
                used[state, name] = known[0] if known else 0
                if known is None and state is self.months:
                    new_months.add(name)
            return used[state, name]

        changed = set()
        for _, request_id, scan_type, period, repo, limit in _in_order(rows, "request_id", "scan_type", "period", "repo_fingerprint", "limit"):
            by_repo = scan_type == "audit" and repo is not None
            of_month = count(self.months, period)
            before = count(self.repos, repo) if by_repo else of_month
            allowed = limit == -1 or before < limit
            if allowed:
                for at in [(self.months, period)] + [(self.repos, repo)] * by_repo:
                    used[at] += 1
                    changed.add(at)
            before += allowed
            remaining = 0 if not allowed else -1 if limit == -1 else max(0, limit - before)
            yield Row(request_id=request_id, license_id=key[0], scan_type=scan_type, period=period, limit=limit,
                      allowed=allowed, used=before, remaining=remaining)
        for state, name in changed:
            state.updateValue((name,), (used[state, name],))
            if name in new_months and state is self.months:
                self.handle.registerTimer(_month_end(name))

    def forget(self, until: int) -> None:
        for (period,) in list(self.months.keys()):
            if _month_end(period) <= until:
                self.months.removeKey((period,))


class RetryDecisions(_Keyed):
    """Per repository: when the last admitted request that blocks others was made."""

    def __init__(self, hop: int, blocking: tuple[str, ...] = ("pending", "error")):
        self.hop, self.blocking = hop, blocking

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def _over(self, last: int) -> int:
        return (last + self.hop) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        before = last = known[0] if known else None
        for t, request_id, status in _in_order(rows, "request_id", "status"):
            admitted = last is None or t > last + self.hop
            yield Row(request_id=request_id, repo_url=key[0], admitted=admitted, reused_t=None if admitted else last)
            if admitted and status in self.blocking:
                last = t
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._over(before))
            self.last.update((last,))
            self.handle.registerTimer(self._over(last))

    def forget(self, until: int) -> None:
        known = self.last.get()
        if known and self._over(known[0]) <= until:
            self.last.clear()


class _Bucketed(StatefulProcessor):
    """Decisions for all keys of a bucket; one timer wakes the bucket when the first of its entries is over."""

    FRAME = 50_000  #: rows of a frame that is given out

    def _wake(self, over: Iterable[int]) -> None:
        """The one timer is set to the first of ``over`` (milliseconds)."""
        at = min(over, default=None)
        known = list(self.handle.listTimers())
        for old in known:
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None and at not in known:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # entries that are over at the same watermark go together
        self.forget(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1))
        return iter(())

    def _frames(self, rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
        while piece := list(islice(rows, self.FRAME)):
            yield pd.DataFrame(piece, columns=columns, dtype=object)

    def close(self) -> None:
        pass


def _over(t: int) -> int:
    """First millisecond after ``t`` microseconds."""
    return t // 1000 + 1


CHUNK = 4096  #: entries of a bucket that lie in one row of the state


def _packed(rows: Iterable[tuple]) -> list[tuple]:
    rows = iter(rows)
    return [(pickle.dumps(piece, 4),) for piece in iter(lambda: list(islice(rows, CHUNK)), [])]


def _entries(state) -> list[tuple]:
    return [row for (piece,) in state.get() for row in pickle.loads(piece)]


def _put(state, rows: Iterable[tuple]) -> None:
    packed = _packed(rows)
    state.put(packed) if packed else state.clear()


class SessionDecisions(_Bucketed):
    """Per bucket of owners of sessions: when each of their live sessions ends.

    ``login`` issues a session, ``use`` renews it when little is left, ``revoke`` ends it and
    ``revoke_all`` ends all of the owner's. A token without a live session is rejected, so that ended
    sessions need no state; only ``first_use_issues`` takes an unknown token for a login.
    """

    OUT = "use_id bigint, given boolean, token string, outcome string, expires_t bigint"

    def __init__(self, ttl: int, renew_under: int, first_use_issues: bool):
        self.ttl, self.renew_under, self.first_use_issues = ttl, renew_under, first_use_issues

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getListState("ends", "entries binary")  # (owner, token, t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = defaultdict(dict)  # the sessions that the state knows, by owner and token
        for owner, token, end in _entries(self.ends):
            ends[owner][token] = end
        before = {owner: dict(live) for owner, live in ends.items()}
        yield from self._frames(self._decided(rows, ends), ["use_id", "given", "token", "outcome", "expires_t"])
        live = {owner: {token: end for token, end in of.items() if end is not None} for owner, of in ends.items()}
        if {owner: of for owner, of in live.items() if of} != before:
            self._keep([(owner, token, end) for owner, of in live.items() for token, end in of.items()])

    def _decided(self, rows: Iterator[pd.DataFrame], ends: dict) -> Iterator[tuple]:
        ttl, renew_under, first_use_issues = self.ttl, self.renew_under, self.first_use_issues
        for t, use_id, given, owner, token, kind in _frames_in_order(rows, ["t", "use_id", "given"], ["owner", "token", "kind"]):
            live = ends[owner]
            if kind == "revoke_all":
                live.update(dict.fromkeys(live))
                yield use_id, given, token, "revoked", None
                continue
            end = live.get(token)
            if kind == "revoke":
                end, outcome = None, "revoked"
            elif kind == "login" or end is None and first_use_issues:
                end, outcome = t + ttl, "issued"
            elif end is None or t >= end:
                outcome = "rejected"
            elif end - t < renew_under:
                end, outcome = t + ttl, "renewed"
            else:
                outcome = "used"
            live[token] = end
            yield use_id, given, token, outcome, end

    def _keep(self, live: list[tuple]) -> None:
        _put(self.ends, live)
        self._wake(_over(end) for *_, end in live)

    def forget(self, until: int) -> None:
        self._keep([row for row in _entries(self.ends) if _over(row[2]) > until])


def _frames_in_order(frames: Iterator[pd.DataFrame], numbers: list[str], names: list[str]) -> Iterator[tuple]:
    """(``numbers``, ``names``) of the rows of frames, by the first number, then ``given`` (false first), then
    the second; names are held once, rows as numbers."""
    codes: list[dict] = [{} for _ in names]
    parts = []
    for frame in frames:
        columns = [frame[c].to_numpy() for c in numbers]
        for name, code in zip(names, codes):
            at, found = pd.factorize(frame[name], use_na_sentinel=False)
            found = [None if pd.isna(v) else v for v in found]
            columns.append(np.array([code.setdefault(v, len(code)) for v in found], "int32")[at])
        parts.append(columns)
    if not parts:
        return
    columns = [np.concatenate(c) for c in zip(*parts)]
    del parts
    order = np.lexsort((columns[1], columns[2], columns[0]))
    values = [list(code) for code in codes]
    for begin in range(0, len(order), 65_536):
        some = order[begin:begin + 65_536]
        plain = [c[some].tolist() for c in columns[:len(numbers)]]
        named = [[v[i] for i in c[some].tolist()] for v, c in zip(values, columns[len(numbers):])]
        yield from zip(*plain, *named)


class LicenceStates(_Bucketed):
    """Per bucket of subscriptions: licences that may still be revoked and cancellations that may still meet a
    licence. A licence ends with the first cancellation that isn't earlier than its purchase."""

    OUT = "checkout string, t bigint, subscription_id string, email string, bundle_id string, item_no int, product string, revoked bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "entries binary")  # (subscription_id, checkout, item_no, t, email, bundle_id, product, revoked)
        self.ended = handle.getListState("ended", "entries binary")  # (subscription_id, t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._frames(self._versions(rows), ["checkout", "t", "subscription_id", "email", "bundle_id", "item_no", "product", "revoked"])

    def _versions(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        bought, ended = {}, []
        columns = ["ended", "subscription_id", "checkout", "item_no", "t", "email", "bundle_id", "product"]
        for frame in rows:
            for is_end, sub, checkout, item_no, t, *told in zip(*(frame[c].tolist() for c in columns)):
                if is_end:
                    ended.append((sub, t))
                else:
                    bought[sub, checkout, item_no] = (t, *told, None)
        known = _entries(self.ended)
        of_new, of_all = _by_key(ended), _by_key(known + ended)
        # licences of earlier micro-batches meet the new cancellations only
        items, changed = {i[:3]: i[3:] for i in _entries(self.items)}, {}
        for at, item in items.items():
            if at[0] in of_new:
                first = _first(of_new[at[0]], item[0])
                if first is not None and (item[4] is None or first < item[4]):
                    changed[at] = (*item[:4], first)
        for at, item in bought.items():
            changed[at] = (*item[:4], _first(of_all.get(at[0], ()), item[0]))
        if any(at in items for at in changed):
            _put(self.items, [(*at, *item) for at, item in (items | changed).items()])
        elif changed:
            self.items.appendList(_packed((*at, *item) for at, item in changed.items()))
        if ended:
            self.ended.appendList(_packed(ended))
            self._wake(_over(t) for _, t in known + ended)
        for (sub, checkout, item_no), (t, email, bundle_id, product, revoked) in changed.items():
            yield checkout, t, sub, email, bundle_id, item_no, product, revoked

    def forget(self, until: int) -> None:
        # no purchase and no cancellation before the watermark comes any more
        left = [row for row in _entries(self.ended) if _over(row[1]) > until]
        _put(self.ended, left)
        items = _entries(self.items)
        open_items = [row for row in items if row[7] is None or _over(row[7]) > until]
        if len(open_items) < len(items):
            _put(self.items, open_items)
        self._wake(_over(t) for _, t in left)


def _by_key(ended: list[tuple]) -> dict[object, list[int]]:
    found = defaultdict(list)
    for sub, t in ended:
        found[sub].append(t)
    return {sub: sorted(times) for sub, times in found.items()}


def _first(times: list[int], t: int) -> int | None:
    """The first of sorted ``times`` that isn't before ``t``."""
    at = bisect_left(times, t)
    return times[at] if at < len(times) else None

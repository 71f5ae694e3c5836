"""Greedy chains per key: retry-storm suppression and sliding sessions, for keys of any size.

A chain keeps the first row, then the first row more than ``hop`` behind the last kept one, and
so on. One task per key would put a hot key into one task, so time is cut into buckets:

1. per (key, bucket): for every possible entry, where does the chain leave the bucket? Entries
   that merge are one piece, so a bucket gives few rows;
2. per key: walk the buckets with these pieces (small) to learn each bucket's entry;
3. per (key, bucket): replay the rows from that entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.session import ship_with_tasks

ship_with_tasks(__name__)
_LONG_AGO = -(1 << 62)
HOPS_PER_BUCKET = 4  #: width of a bucket of session uses, in shortest renewal gaps


def _exits(times: np.ndarray, hop: int) -> np.ndarray:
    """For each row kept first, the last row kept in the same bucket: the next kept row, followed
    by doubling."""
    rows = np.arange(len(times))
    after = np.searchsorted(times, times + hop, side="right")
    last = np.where(after < len(times), after, rows)
    while True:
        further = last[last]
        if (further == last).all():
            return times[last]
        last = further


def per_group(keys: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]):
    """Batch function for ``mapInPandas`` over partitions sorted by ``keys``.

    Groups are slices of the Arrow batches, without one pandas frame per group; only a group
    that spans batches is carried over.
    """
    def groups(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        ends = np.append(starts[1:], len(pdf))
        out = [fn({c: v[i:j] for c, v in columns.items()}) for i, j in zip(starts, ends)]
        return pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return groups(pd.concat(parts, ignore_index=True), np.array([0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: list[pd.DataFrame] = []  # pieces of the one group that goes on, joined when it ends
        for pdf in batches:
            if not len(pdf):
                continue
            starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            if carry and (carry[-1][keys].iloc[-1] == pdf[keys].iloc[0]).all():
                if len(starts) == 1:
                    carry.append(pdf)
                    continue
                carry.append(pdf.iloc[: starts[1]])
                starts = starts[1:]
            if carry:
                yield whole(carry)
            if len(starts) > 1:
                yield groups(pdf.iloc[starts[0]: starts[-1]], starts[:-1] - starts[0])
            carry = [pdf.iloc[starts[-1]:]]
        if carry:
            yield whole(carry)

    return run


def _same(values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values[:1], n)


def bucket_pieces(hop: int):
    """Entry ``a`` (time of the last kept row) with ``a + hop < upto`` leaves at ``leaves``."""
    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        times = np.unique(g["t"])
        leaves = _exits(times, hop)
        last = np.append(leaves[1:] != leaves[:-1], True)
        n = int(last.sum())
        return {"key": _same(g["key"], n), "bucket": _same(g["bucket"], n), "upto": times[last], "leaves": leaves[last]}

    return one


def bucket_entries(hop: int):
    """Entry of every bucket of one key, from the pieces in bucket order."""
    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        starts = np.flatnonzero(np.append(True, g["bucket"][1:] != g["bucket"][:-1]))
        ends = np.append(starts[1:], len(g["bucket"]))
        entry, entries = _LONG_AGO, []
        for i, j in zip(starts, ends):
            entries.append(entry)
            at = i + int(np.searchsorted(g["upto"][i:j], entry + hop, side="right"))
            if at < j:
                entry = int(g["leaves"][at])
        return {"key": _same(g["key"], len(starts)), "bucket": g["bucket"][starts], "entry": np.array(entries, dtype=np.int64)}

    return one


def bucket_kept(hop: int):
    """Times kept in one bucket, starting from its entry."""
    def one(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        times = np.unique(g["t"])
        at, kept = int(np.searchsorted(times, g["entry"][0] + hop, side="right")), []
        while at < len(times):
            kept.append(times[at])
            at = int(np.searchsorted(times, times[at] + hop, side="right"))
        return {"key": _same(g["key"], len(kept)), "t": np.array(kept, dtype=np.int64)}

    return one


def _grouped(df: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(per_group(keys, fn), schema)


def chain_times(rows: DataFrame, hop: int, bucket: int) -> DataFrame:
    """Kept times of ``rows(key, t)`` in microseconds: (key, t)."""
    cut = rows.distinct().withColumn("bucket", F.floor(F.col("t") / bucket).cast("bigint"))
    key = f"key {cut.schema['key'].dataType.simpleString()}"
    pieces = _grouped(cut, ["key", "bucket"], ["t"], bucket_pieces(hop), f"{key}, bucket bigint, upto bigint, leaves bigint")
    entries = _grouped(pieces, ["key"], ["bucket", "upto"], bucket_entries(hop), f"{key}, bucket bigint, entry bigint")
    return _grouped(cut.join(entries, ["key", "bucket"]), ["key", "bucket"], ["t"], bucket_kept(hop), f"{key}, t bigint")


def suppressed_retries(
    requests: DataFrame, window_seconds: int = fixed.RETRY_WINDOW_SECONDS, bucket_seconds: int = 3600
) -> DataFrame:
    """Adds ``admitted`` and ``reused_at``: a request is answered by a pending or failed request
    of the same repository that was admitted at most ``window_seconds`` ago.

    Suppressed requests do not extend the window. Requests that completed block nobody, so only
    the others form the chain; at equal times the first request id is the admitted one.
    """
    hop = window_seconds * 1_000_000
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    blocking = requests.filter(F.col("status").isin("pending", "error"))
    kept = chain_times(
        blocking.select(F.col("repo_url").alias("key"), t.alias("t")), hop, bucket_seconds * 1_000_000)
    first = blocking.groupBy(F.col("repo_url").alias("key"), t.alias("t")).agg(F.min("request_id").alias("first_id"))
    admitted = kept.join(first, ["key", "t"])
    # an admission reaches into its own and the next slices of one window length each
    slices = admitted.select(
        "key", F.col("t").alias("at"), "first_id",
        F.explode(F.array(F.floor(F.col("t") / hop), F.floor(F.col("t") / hop) + 1)).alias("slice"))
    rows = requests.withColumn("key", F.col("repo_url")).withColumn("t", t).withColumn("slice", F.floor(t / hop))
    near = rows.select("key", "slice", "request_id", "t").join(slices, ["key", "slice"])
    covers = (F.col("at") <= F.col("t")) & (F.col("t") <= F.col("at") + hop) & (
        (F.col("at") < F.col("t")) | (F.col("first_id") < F.col("request_id")))
    hit = near.filter(covers & (F.col("first_id") != F.col("request_id"))).groupBy("request_id").agg(F.max("at").alias("_at"))
    return (
        requests.join(hit, "request_id", "left")
        .withColumn("admitted", F.col("_at").isNull())
        .withColumn("reused_at", F.timestamp_micros("_at")).drop("_at")
    )


def session_renewals(
    uses: DataFrame, ttl_seconds: int = fixed.SESSION_TTL_SECONDS,
    renew_under_seconds: int = fixed.SESSION_RENEW_UNDER_SECONDS,
) -> DataFrame:
    """Renewals and end of every session: (token, issued_at, renewals, last_renewal, expires_at,
    rejected_from).

    A session is issued at its first use and lives ``ttl``. A use with less than
    ``renew_under`` left renews it; a use at or after the expiry is rejected for good. Up to the
    rejection the renewals are the greedy chain of uses more than ``ttl - renew_under`` apart, so the
    plan is the same for every time span; a token has one row per renewal left when the first gap
    of ``ttl`` is looked for.
    """
    ttl, hop = ttl_seconds * 1_000_000, (ttl_seconds - renew_under_seconds) * 1_000_000
    log = uses.select(F.col("token").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    kept = chain_times(log, hop, HOPS_PER_BUCKET * hop)
    token = Window.partitionBy("key")
    late = F.col("t") - F.lag("t").over(token.orderBy("t")) >= ttl
    rejected = F.min(F.when(F.col("late"), F.col("t"))).over(token)
    rows = kept.withColumn("late", late).withColumn("rejected", rejected)
    alive = F.when(F.col("rejected").isNull() | (F.col("t") < F.col("rejected")), F.col("t"))
    state = rows.groupBy(F.col("key").alias("token")).agg(
        F.min("t").alias("issued"), F.max(alive).alias("at"), (F.count(alive) - 1).cast("int").alias("renewals"), F.min("rejected").alias("rejected"))
    return state.select(
        "token", F.timestamp_micros("issued").alias("issued_at"), "renewals",
        F.timestamp_micros("at").alias("last_renewal"), F.timestamp_micros(F.col("at") + ttl).alias("expires_at"),
        F.timestamp_micros("rejected").alias("rejected_from"),
    )

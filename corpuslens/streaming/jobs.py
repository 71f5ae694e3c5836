"""Online jobs as Structured Streaming: streaming DataFrame in, streaming DataFrame out.

Every operator names its watermark; rows later than it are dropped by Spark. Decisions that were
emitted (admissions, suppressions) are never revised.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuslens.functions import fixed
from corpuslens.operators import drift, licences
from corpuslens.operators.harvest import error_signature
from corpuslens.session import ROCKSDB_PROVIDER, scratch_path
from corpuslens.streaming import keyed


# ---- running ------------------------------------------------------------------------
#: Keyed state lies in RocksDB, so that it is bounded by disk and not by the executors' heaps. A
#: commit uploads what changed; space isn't reserved ahead for stores of which there are many small ones.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def run_available(spark: SparkSession, writer: DataStreamWriter) -> list[dict]:
    """Runs a stream over what is there now, under ``STATE_CONF``; gives the progress reports of its
    micro-batches. The session's own settings are left as they were."""
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        run = writer.trigger(availableNow=True).start()
        run.awaitTermination()
        return [json.loads(p.json) for p in run.recentProgress]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_append(stream: DataFrame, label: str, arrivals: Iterable[object] = (None,), progress: list[dict] | None = None) -> DataFrame:
    """Runs an append-mode stream over what is there now, once for each of ``arrivals`` (see
    ``arriving``); returns its files as a table. ``progress`` takes the reports of its micro-batches."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    for _ in arrivals:
        reports = run_available(
            spark, stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append"))
        if progress is not None:
            progress += reports
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, label: str, each: Callable[[DataFrame], DataFrame], mode: str = "append",
    arrivals: Iterable[object] = (None,), progress: list[dict] | None = None,
) -> DataFrame:
    """``foreachBatch`` sink: ``each`` turns a micro-batch into rows that are written under the
    batch number, so a repeated batch replaces its own files."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/epoch={batch_id}")

    for _ in arrivals:
        reports = run_available(spark, stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode))
        if progress is not None:
            progress += reports
    return spark.read.parquet(out)


def arriving(rows: DataFrame, time: str, pieces: int, label: str) -> tuple[DataFrame, Iterator[int]]:
    """A log as a stream to which it comes piece by piece in the order of ``time`` (equal stretches of
    time): the stream, and an iterator that writes the next piece each time it is asked."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.limit(0).write.parquet(path)
    at = F.unix_micros(F.col(time).cast("timestamp"))

    def pieces_of() -> Iterator[int]:
        low, high = rows.agg(F.min(at), F.max(at)).first()
        for k in range(pieces):
            if low is None:
                part = F.lit(False)
            else:
                edges = [low + (high - low + 1) * i // pieces for i in (k, k + 1)]
                part = (at >= edges[0]) & (at < edges[1])
            rows.where(part).write.mode("append").parquet(path)
            yield k

    return spark.readStream.schema(rows.schema).parquet(path), pieces_of()


def latest_updates(updates: DataFrame, *keys: str) -> DataFrame:
    """Newest version of every key of an update-mode sink."""
    rest = [c for c in updates.columns if c not in (*keys, "epoch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return newest.select(*keys, "_r.*")


def _ts(c: str = "ts") -> Column:
    return F.col(c).cast("timestamp")


def once(stream: DataFrame, ids: list[str], time: str, late: str) -> DataFrame:
    """Rows whose ``ids`` came before, within the watermark, are dropped: a file that is delivered twice
    counts once, and the state holds the ids of the last ``late`` only."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


# ---- keyed decisions (see ``keyed``) --------------------------------------------------
LATE = "1 hour"  #: how late a row may come
BUCKETS = 1024  #: sessions and licences are decided by so many buckets of owners and subscriptions


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def quota_stream(requests: DataFrame, late: str = LATE) -> DataFrame:
    """Quota admission as requests arrive, state per (licence, type)."""
    rows = requests.withColumn("ts", _ts()).withWatermark("ts", late).select(
        "request_id", "license_id", "scan_type", "repo_fingerprint", licences.period_key(F.col("ts")).alias("period"), "ts",
        F.unix_micros("ts").alias("t"), licences.tier_limit(F.col("tier"), F.col("scan_type")).alias("limit"))
    return rows.groupBy("license_id", "scan_type").transformWithState(
        keyed.QuotaDecisions(),
        "request_id bigint, license_id string, scan_type string, period string, limit int, allowed boolean, used bigint, remaining bigint",
        "append", "eventTime")


def retry_stream(requests: DataFrame, window_seconds: int = fixed.RETRY_WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """Retry-storm suppression per repository."""
    rows = requests.withColumn("created_at", _ts("created_at")).withWatermark("created_at", late).select(
        "request_id", "repo_url", "status", "created_at", F.unix_micros("created_at").alias("t"))
    return rows.groupBy("repo_url").transformWithState(
        keyed.RetryDecisions(window_seconds * 1_000_000), "request_id bigint, repo_url string, admitted boolean, reused_t bigint", "append", "eventTime")


def session_stream(
    uses: DataFrame, ttl_seconds: int = fixed.SESSION_TTL_SECONDS, renew_under_seconds: int = fixed.SESSION_RENEW_UNDER_SECONDS, late: str = LATE,
) -> DataFrame:
    """Session renewal and revocation. ``uses(token, ts, use_id[, kind][, owner])``: kind is ``login``, ``use``,
    ``revoke`` or ``revoke_all`` (all sessions of the owner; without owners each token is its own).
    Without a column ``kind`` every row is a use, and the first use of an unknown token issues it."""
    given = "kind" in uses.columns
    owner = F.coalesce("owner", "token") if "owner" in uses.columns else F.col("token")
    rows = uses.withColumn("ts", _ts()).withWatermark("ts", late).where(F.col("ts").isNotNull()).select(
        _bucket(owner), owner.alias("owner"), "token", F.coalesce("use_id", F.lit(0)).alias("use_id"), F.col("use_id").isNotNull().alias("given"),
        (F.col("kind") if given else F.lit("use")).alias("kind"), "ts", F.unix_micros("ts").alias("t"))
    decide = keyed.SessionDecisions(ttl_seconds * 1_000_000, renew_under_seconds * 1_000_000, not given)
    decided = rows.groupBy("bucket").transformWithStateInPandas(decide, decide.OUT, "append", "eventTime")
    return decided.select(F.when(F.col("given"), F.col("use_id")).alias("use_id"), "token", "outcome", "expires_t")


def licence_stream(events: DataFrame, default_bundle: Sequence[str], late: str = LATE) -> DataFrame:
    """Versions of licence states from billing events; the newest of a licence (checkout_id, item_no) holds,
    see ``latest_updates``. An event that is delivered again changes nothing. Siblings of a bundle
    come from one checkout, hence from one subscription, and end together."""
    events = once(events, ["event_id"], "ts", late)
    products, bundle_id = licences.bought_products(default_bundle)
    is_end = F.col("event_type") == "customer.subscription.deleted"
    items = F.when(is_end, F.array(F.lit(None).cast("string"))).otherwise(products)
    told = events.where((is_end | licences.is_checkout()) & F.col("ts").isNotNull())
    # a number that may be null would come as a float
    rows = told.select(
        _bucket(F.col("subscription_id")), "subscription_id", "ts", is_end.alias("ended"), F.unix_micros("ts").alias("t"), F.col("event_id").cast("string").alias("checkout"),
        "email", bundle_id.alias("bundle_id"), F.posexplode(items).alias("item_no", "product"))
    states = rows.groupBy("bucket").transformWithStateInPandas(keyed.LicenceStates(), keyed.LicenceStates.OUT, "append", "eventTime")
    kind = events.schema["ts"].dataType
    return states.select(
        F.col("checkout").cast("bigint").alias("checkout_id"), F.timestamp_micros("t").cast(kind).alias("ts"), "subscription_id", "email", "bundle_id", "item_no", "product",
        F.timestamp_micros("revoked").cast(kind).alias("revoked_at"), F.col("revoked").isNull().alias("active"))


# ---- windows ------------------------------------------------------------------------
def request_rates(requests: DataFrame, limit: int, key: str, late: str = "2 minutes") -> DataFrame:
    """Keys over ``limit`` requests in a minute (tumbling)."""
    counts = (
        requests.withColumn("ts", _ts()).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 minute"), key).agg(F.count("*").alias("n"))
    )
    return counts.filter(F.col("n") > limit).select(F.col("window.start").alias("minute"), key, "n")


def daily_names(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Commands and gate hits per day (tumbling)."""
    return (
        events.withColumn("ts", _ts()).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "event_type", "name").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("day"), "event_type", "name", "n")
    )


def daily_users(events: DataFrame, late: str = LATE) -> DataFrame:
    """Exact user sets per day as bitmaps, one per stretch of 32,768 ids (``user_id`` is a whole number that
    isn't negative): the state has a bitmap per open day and stretch, however many events there are."""
    return (
        events.withColumn("ts", _ts()).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), F.bitmap_bucket_number("user_id").alias("stretch"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users"))
        .select(F.col("window.start").alias("day"), "stretch", "users")
    )


def active_users(daily: DataFrame, until, days: int = 7) -> DataFrame:
    """Distinct users of ``days`` days, for every window that ends at ``until`` (the watermark of
    ``daily_users``) or before: bitmaps of its days, merged."""
    spread = daily.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    start = F.expr("day - make_dt_interval(back)")
    merged = spread.groupBy(start.alias("from_day"), "stretch").agg(F.bitmap_or_agg("users").alias("users"))
    end = F.col("from_day") + F.expr(f"INTERVAL {days} DAYS")
    return merged.where(end <= F.lit(until).cast("timestamp")).groupBy("from_day", end.alias("to_day")).agg(
        F.sum(F.bitmap_count("users")).alias("users"))


def last_watermark(progress: list[dict]) -> str | None:
    """The watermark that a stream reached."""
    return max((p["eventTime"]["watermark"] for p in progress if p.get("eventTime", {}).get("watermark")), default=None)


def paired_calls(items: DataFrame, bound: str = "1 hour") -> DataFrame:
    """Failed results with their call of the same session and id, at most ``bound`` older;
    results without a call get tool ``?`` once the watermark has passed."""
    rows = items.withColumn("ts", _ts())
    calls = rows.filter(F.col("kind") == "use").select(
        F.col("session").alias("c_session"), F.col("tool_id").alias("c_id"), "tool", F.col("ts").alias("c_ts")
    ).withWatermark("c_ts", "10 minutes")
    results = rows.filter((F.col("kind") == "result") & F.col("is_error")).select(
        "session", "tool_id", "text", "ts").withWatermark("ts", "10 minutes")
    on = (
        (F.col("session") == F.col("c_session")) & (F.col("tool_id") == F.col("c_id"))
        & (F.col("c_ts") <= F.col("ts")) & (F.col("c_ts") >= F.col("ts") - F.expr(f"INTERVAL {bound}"))
    )
    return results.join(calls, on, "left_outer").select(
        "session", "tool_id", "ts", F.coalesce("tool", F.lit("?")).alias("tool"), error_signature(F.col("text")).alias("signature"))


def rolling_gotchas(errors: DataFrame, window: str = "1 day", late: str = LATE, ids: Sequence[str] = ()) -> DataFrame:
    """Error counts and distinct sessions by tool and signature per window. With ``ids``, the columns that
    name an error, one that comes again within the watermark isn't counted again."""
    timed = once(errors, list(ids), "ts", late) if ids else errors.withColumn("ts", _ts()).withWatermark("ts", late)
    per_session = (
        timed
        .groupBy(F.window("ts", window), "tool", "signature", "session").agg(F.count("*").alias("_n"))
    )
    return per_session.groupBy("window", "tool", "signature").agg(
        F.sum("_n").alias("n"), F.count("*").alias("sessions")
    ).select(F.col("window.start").alias("start"), "tool", "signature", "n", "sessions")


# ---- running totals and stream-static jobs ------------------------------------------
def batch_counter(scans: DataFrame) -> DataFrame:
    """Finished scans per batch (update mode)."""
    done = scans.filter(F.col("status").isin("complete", "error"))
    return done.groupBy("batch_id").agg(F.count("*").alias("done"))


def machine_counter(uses: DataFrame) -> DataFrame:
    """First and last use per licence and machine (update mode)."""
    return uses.groupBy("license_id", "machine_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def drift_alerts(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Runs whose score fell critically below the baseline of their model (stream-static join)."""
    return drift.against_baseline(runs, baseline).filter(F.col("severity") == "critical")

"""Registered queries: the online jobs, run over the logs until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import licences
from corpuslens.plans.harvest_queries import _SIG, SEV_SQL
from corpuslens.plans.registry import query
from corpuslens.plans.service_queries import _BOUGHT, _CAND, _CFG, _LOOK, _OUT, ALIASES, DEFAULT_BUNDLE, KEY_CONFIG, QUOTA_SQL
from corpuslens.plans.registry import ORACLES
from corpuslens.sources.bindings import stream_view, view
from corpuslens.streaming import jobs


PIECES = 3  #: a log comes to a keyed stream in so many pieces, in the order of time


def _arriving(spark, sf_dir, name, time="ts"):
    return jobs.arriving(view(spark, sf_dir, name), time, PIECES, f"{name}-log")


def _event_stream(spark, sf_dir):
    return stream_view(spark, sf_dir, "telemetry")


@query("stream_quota", "R1", f"""WITH {QUOTA_SQL} SELECT request_id, license_id, scan_type, period, lim AS "limit", allowed, CAST(before + CAST(allowed AS INT) AS BIGINT) AS used,
 CAST(CASE WHEN NOT allowed THEN 0 WHEN lim = -1 THEN -1 ELSE greatest(0, lim - before - 1) END AS BIGINT) AS remaining FROM every""", "usage_requests")
def stream_quota(spark, sf_dir):
    requests, pieces = _arriving(spark, sf_dir, "usage_requests")
    return jobs.run_append(jobs.quota_stream(requests), "quota", pieces)


@query("stream_retries", "R2", "SELECT request_id, repo_url, admitted, epoch_us(reused_at) AS reused_t FROM (" + ORACLES["suppressed_retries"] + ") w")
def stream_retries(spark, sf_dir):
    requests, pieces = _arriving(spark, sf_dir, "scan_requests", "created_at")
    return jobs.run_append(jobs.retry_stream(requests), "retries", pieces)


@query("stream_sessions", "R3", "SELECT token, renewals, epoch_us(expires_at) AS expires_t FROM (" + ORACLES["session_renewals"] + ") w")
def stream_sessions(spark, sf_dir):
    # the log has no logins: the first use of a token is one
    every = view(spark, sf_dir, "session_uses")
    first = every.groupBy("token").agg(F.min(F.struct("ts", "use_id"))["use_id"].alias("use_id")).withColumn("kind", F.lit("login"))
    log = every.join(first, ["token", "use_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("use")))
    uses, pieces = jobs.arriving(log, "ts", PIECES, "sessions-log")
    found = jobs.run_append(jobs.session_stream(uses), "sessions", pieces)
    return found.groupBy("token").agg(
        F.count_if(F.col("outcome") == "renewed").cast("int").alias("renewals"), F.max("expires_t").alias("expires_t"))


@query("stream_request_rates", "R4", """SELECT date_trunc('minute', ts) AS minute, machine_id, count(*) AS n FROM license_requests, (SELECT max(ts) - INTERVAL 2 MINUTE AS w FROM license_requests) m
 GROUP BY 1, 2, w HAVING count(*) > 0 AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= w""", "license_requests")
def stream_request_rates(spark, sf_dir):
    return jobs.run_append(jobs.request_rates(stream_view(spark, sf_dir, "license_requests"), 0, "machine_id"), "rates")


@query("stream_daily_names", "R5", """WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, name, count(*) AS n FROM telemetry GROUP BY ALL)
SELECT d.* FROM d, (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM telemetry) m WHERE day + INTERVAL 1 DAY <= w""", "telemetry")
def stream_daily_names(spark, sf_dir):
    return jobs.run_append(jobs.daily_names(_event_stream(spark, sf_dir)), "daily")


@query("stream_active_users", "R6", """WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events),
s AS (SELECT user_id, day - k * INTERVAL 1 DAY AS from_day FROM d, range(0, 7) r(k))
SELECT from_day, from_day + INTERVAL 7 DAY AS to_day, count(DISTINCT user_id) AS users FROM s, m WHERE from_day + INTERVAL 7 DAY <= w GROUP BY from_day""")
def stream_active_users(spark, sf_dir):
    from corpuslens.sources.bindings import table

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    progress = []
    daily = jobs.run_append(jobs.daily_users(events), "active", progress=progress)
    return jobs.active_users(daily, jobs.last_watermark(progress))


# transcripts carry no clock: one session per minute, one second per turn
_CLOCK = "timestamp_seconds(1704067200 + CAST(substr(session, 2) AS BIGINT) * 60 + pos)"
_CLOCK_SQL = "(TIMESTAMP '2024-01-01 00:00:00' + (CAST(substr(session, 2) AS BIGINT) * 60 + pos) * INTERVAL '1' SECOND)"


def _items(spark, sf_dir):
    return stream_view(spark, sf_dir, "transcript").withColumn("ts", F.expr(_CLOCK))


@query("stream_paired_calls", "R7", f"""WITH i AS (SELECT *, {_CLOCK_SQL} AS ts FROM transcript), r AS (SELECT * FROM i WHERE kind = 'result' AND is_error), c AS (SELECT * FROM i WHERE kind = 'use'),
w AS (SELECT least(max(ts) FILTER (kind = 'use'), max(ts) FILTER (kind = 'result' AND is_error)) - INTERVAL 10 MINUTE AS w FROM i),
j AS (SELECT r.session, r.tool_id, r.ts, c.tool, {_SIG.replace('(text,', '(r.text,')} AS signature FROM r LEFT JOIN c ON c.session = r.session AND c.tool_id = r.tool_id AND c.ts <= r.ts AND c.ts >= r.ts - INTERVAL 1 HOUR)
SELECT session, tool_id, ts, coalesce(tool, '?') AS tool, signature FROM j, w WHERE tool IS NOT NULL OR ts < w""", "transcript")
def stream_paired_calls(spark, sf_dir):
    return jobs.run_append(jobs.paired_calls(_items(spark, sf_dir)), "pairs")


@query("stream_rolling_gotchas", "R8", f"""WITH i AS (SELECT session, {_CLOCK_SQL} AS ts, {_SIG} AS signature FROM transcript WHERE kind = 'result' AND is_error)
SELECT date_trunc('minute', ts)::TIMESTAMP - (date_part('minute', ts) % 10) * INTERVAL 1 MINUTE AS start, 'result' AS tool, signature, count(*) AS n, count(DISTINCT session) AS sessions FROM i, (SELECT max(ts) - INTERVAL 5 MINUTE AS w FROM i) m
GROUP BY 1, signature, w HAVING start + INTERVAL 10 MINUTE <= w""", "transcript")
def stream_rolling_gotchas(spark, sf_dir):
    from corpuslens.operators.harvest import error_signature

    errors = _items(spark, sf_dir).filter((F.col("kind") == "result") & F.col("is_error")).select(
        "session", "pos", "ts", F.lit("result").alias("tool"), error_signature(F.col("text")).alias("signature"))
    return jobs.run_append(jobs.rolling_gotchas(errors, "10 minutes", "5 minutes", ["session", "pos"]), "gotchas")


@query("stream_batch_progress", "R9", "SELECT batch_id, count(*) AS done FROM scans WHERE status IN ('complete', 'error') GROUP BY batch_id", "scans")
def stream_batch_progress(spark, sf_dir):
    counts = jobs.batch_counter(stream_view(spark, sf_dir, "scans"))
    return jobs.latest_updates(jobs.run_batches(counts, "batches", lambda b: b, "update"), "batch_id")


@query("stream_license_states", "R10", f"WITH {_BOUGHT} SELECT b.*, e.ended AS revoked_at, e.ended IS NULL AS active FROM bought b LEFT JOIN LATERAL (SELECT min(ts) AS ended FROM billing_events x WHERE x.event_type = 'customer.subscription.deleted' AND x.subscription_id = b.subscription_id AND x.ts >= b.ts) e ON true", "billing_events")
def stream_license_states(spark, sf_dir):
    events, pieces = _arriving(spark, sf_dir, "billing_events")
    updates = jobs.run_batches(jobs.licence_stream(events, DEFAULT_BUNDLE), "billing", lambda b: b, arrivals=pieces)
    return jobs.latest_updates(updates, "checkout_id", "item_no")


@query("stream_machine_activity", "R11", "SELECT product AS license_id, machine_id, min(ts) AS first_seen, max(ts) AS last_seen FROM license_requests GROUP BY ALL", "license_requests")
def stream_machine_activity(spark, sf_dir):
    uses = stream_view(spark, sf_dir, "license_requests").withColumnRenamed("product", "license_id")
    return jobs.latest_updates(jobs.run_batches(jobs.machine_counter(uses), "machines", lambda b: b, "update"), "license_id", "machine_id")


@query("stream_validation_log", "R12 S11", f"WITH {_CAND}, {_CFG}, {_LOOK}, {_OUT} SELECT result, count(*) AS n FROM outcome GROUP BY result", "license_requests licenses")
def stream_validation_log(spark, sf_dir):
    known = view(spark, sf_dir, "licenses")
    stream = jobs.once(stream_view(spark, sf_dir, "license_requests"), ["request_id"], "ts", jobs.LATE)
    log = jobs.run_batches(stream, "validation", lambda b: licences.validation_outcomes(b, known, KEY_CONFIG, ALIASES))
    return log.groupBy("result").agg(F.count("*").alias("n"))


@query("stream_drift_alerts", "R13", f"""WITH h AS (SELECT r.*, base AS baseline_score, score - base AS delta FROM run_history r JOIN (SELECT model, max(score) AS base FROM run_history GROUP BY model) b USING (model))
SELECT run_id, model, score, baseline_score, delta, {SEV_SQL} AS severity FROM h WHERE delta <= -0.15""", "run_history")
def stream_drift_alerts(spark, sf_dir):
    score = F.col("score").cast("double")
    baseline = view(spark, sf_dir, "run_history").groupBy("model").agg(F.max(score).alias("score"))
    runs = stream_view(spark, sf_dir, "run_history").withColumn("score", score)
    return jobs.run_append(jobs.drift_alerts(runs, baseline), "alerts").drop("ts")

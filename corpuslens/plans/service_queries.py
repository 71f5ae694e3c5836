"""Registered queries: licences, quotas, sessions, scans, telemetry, feeds, advisories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed, keys
from corpuslens.operators import advisories, audit, chains, inventory, licences, repo_health, scans, telemetry
from corpuslens.plans.audit_queries import QUALITY_SQL  # noqa: F401
from corpuslens.plans.inventory_queries import EXCLUDED_SQL, sql_list, sql_values
from corpuslens.plans.registry import ORACLES, query
from corpuslens.session import cut_lineage, scratch_path
from corpuslens.sources import files as file_source, stored, tables
from corpuslens.sources.bindings import view

AS_OF = "2024-06-01 00:00:00"
KEY_CONFIG = {"alpha": ("ALFA", "alpha-v1"), "alpha-old": ("AOLD", "alpha-old-v1"), "beta": ("BETA", "beta-v1")}
ALIASES = {"alpha": "alpha-old", "alpha-old": "alpha"}
DEFAULT_BUNDLE = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---- licences -----------------------------------------------------------------------
_CAND = "req AS (SELECT request_id, ts, machine_id, product, license_key, sha256(trim(license_key)) AS key_hash, CASE product WHEN 'alpha' THEN ['alpha', 'alpha-old'] WHEN 'alpha-old' THEN ['alpha-old', 'alpha'] ELSE [product] END AS cand FROM license_requests)"
_CFG = f"cfg(product, prefix, salt) AS (VALUES {sql_values([(p, a, b) for p, (a, b) in KEY_CONFIG.items()])})"
_LOOK = """look AS (SELECT request_id, ts, machine_id, key_hash, license_key, lic.* EXCLUDE (request_id), coalesce(f.ok, false) AS format_ok, coalesce(f.sum_ok, false) AS sum_ok FROM req
 LEFT JOIN (SELECT request_id, bool_or(regexp_matches(trim(license_key), '^' || prefix || '(-[A-Z0-9]{4}){3}$')) AS ok,
   bool_or(len(string_split(trim(license_key), '-')) = 4 AND upper(substr(sha256(salt || ':' || split_part(trim(license_key), '-', 2) || '-' || split_part(trim(license_key), '-', 3)), 1, 4)) = split_part(trim(license_key), '-', 4)) AS sum_ok
   FROM (SELECT request_id, license_key, unnest(cand) AS product FROM req) JOIN cfg USING (product) GROUP BY request_id) f USING (request_id)
 LEFT JOIN (SELECT request_id, id, tier, active, expires_at FROM (SELECT r.request_id, l.id, l.tier, l.active, l.expires_at, row_number() OVER (PARTITION BY r.request_id ORDER BY list_position(r.cand, l.product)) AS k
   FROM req r JOIN licenses l ON l.key_hash = r.key_hash AND list_contains(r.cand, l.product)) WHERE k = 1) lic USING (request_id))"""
_OUT = """outcome AS (SELECT request_id, ts, key_hash, machine_id, id AS license_id, CASE WHEN NOT format_ok THEN 'invalid_format' WHEN NOT sum_ok THEN 'invalid_checksum' WHEN id IS NULL THEN 'not_found'
 WHEN NOT active THEN 'revoked' WHEN ts > expires_at THEN 'expired' ELSE 'valid' END AS result, tier AS lic_tier FROM look)"""


def _outcomes(spark, sf_dir):
    return licences.validation_outcomes(
        view(spark, sf_dir, "license_requests"), view(spark, sf_dir, "licenses"), KEY_CONFIG, ALIASES)


@query("validation_outcomes", "F12 F13 J19 S11", f"WITH {_CAND}, {_CFG}, {_LOOK}, {_OUT} SELECT * EXCLUDE (lic_tier), CASE WHEN result = 'valid' THEN lic_tier ELSE 'free' END AS tier FROM outcome", "license_requests licenses")
def validation_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("masked_keys", "F12 J24", """SELECT request_id, CASE WHEN len(string_split(trim(license_key), '-')) = 4 THEN split_part(trim(license_key), '-', 1) || '-****-****-' || split_part(trim(license_key), '-', 4) ELSE '****-****-****-****' END AS masked,
 'free:' || substr(sha256(trim(license_key)), 1, 16) AS anonymous_id FROM license_requests""", "license_requests")
def masked_keys(spark, sf_dir):
    rows = view(spark, sf_dir, "license_requests")
    return rows.select("request_id", keys.masked_key(F.col("license_key")).alias("masked"),
                       licences.anonymous_id(F.col("license_key")).alias("anonymous_id"))


@query("machine_activity", "S12 A43", f"WITH {_CAND}, {_CFG}, {_LOOK}, {_OUT} SELECT license_id, machine_id, min(ts) AS first_seen, max(ts) AS last_seen FROM outcome WHERE result = 'valid' AND machine_id IS NOT NULL GROUP BY ALL", "license_requests licenses")
def machine_activity(spark, sf_dir):
    return licences.machine_activity(_outcomes(spark, sf_dir))


@query("machine_upsert", "S12", ORACLES["machine_activity"])
def machine_upsert(spark, sf_dir):
    """The uses of the mornings are the table, those of the rest of the day are merged into it."""
    outcomes = _outcomes(spark, sf_dir)
    morning = F.hour("ts") < 12
    return licences.merged_machines(licences.machine_activity(outcomes.filter(morning)), licences.machine_activity(outcomes.filter(~morning)))


@query("stored_machines", "S12", ORACLES["machine_activity"])
def stored_machines(spark, sf_dir):
    """The uses of four stretches of the day are merged into a stored table one after the other, the second one twice."""
    outcomes = _outcomes(spark, sf_dir)
    path = scratch_path(spark, "machines")
    stored.create_stored(spark, path, "license_id bigint, machine_id string, first_seen timestamp, last_seen timestamp")
    for batch in (0, 1, 2, 1, 3):
        uses = outcomes.filter(F.floor(F.hour("ts") / 6) == batch).withColumn("ts", F.col("ts").cast("timestamp"))
        stored.upsert_machines(spark, path, licences.machine_activity(uses), batch)
    ntz = [F.col(c).cast(outcomes.schema["ts"].dataType).alias(c) for c in ("first_seen", "last_seen")]
    return stored.read_stored(spark, path).select("license_id", "machine_id", *ntz)


_BOUGHT = f"""bought AS (SELECT event_id AS checkout_id, ts, subscription_id, email, CASE WHEN product = 'bundle' THEN 'bundle-' || event_id END AS bundle_id, n - 1 AS item_no, p AS product FROM billing_events,
 unnest(CASE WHEN product <> 'bundle' THEN [product] WHEN len(list_filter(list_transform(string_split(bundle_products, ','), lambda x: trim(x)), lambda x: x <> '')) > 0 THEN list_filter(list_transform(string_split(bundle_products, ','), lambda x: trim(x)), lambda x: x <> '') ELSE [{sql_list(DEFAULT_BUNDLE)}] END) WITH ORDINALITY AS u(p, n)
 WHERE event_type = 'checkout.session.completed' AND email IS NOT NULL)"""


@query("bundle_products", "F16", f"WITH {_BOUGHT} SELECT * FROM bought", "billing_events")
def bundle_products(spark, sf_dir):
    return licences.bundle_products(view(spark, sf_dir, "billing_events"), DEFAULT_BUNDLE)


@query("license_states", "R10", f"WITH {_BOUGHT} SELECT b.*, e.at AS revoked_at, e.at IS NULL AS active FROM bought b LEFT JOIN LATERAL (SELECT min(ts) AS at FROM billing_events x WHERE x.event_type = 'customer.subscription.deleted' AND x.subscription_id = b.subscription_id AND x.ts >= b.ts) e ON true", "billing_events")
def license_states(spark, sf_dir):
    return licences.license_states(view(spark, sf_dir, "billing_events"), DEFAULT_BUNDLE)


@query("revoked_with_siblings", "J21", """WITH c AS (SELECT DISTINCT subscription_id FROM billing_events WHERE event_type = 'customer.subscription.deleted'),
seeds AS (SELECT * FROM licenses WHERE active AND subscription_id IN (SELECT subscription_id FROM c))
SELECT id, product, bundle_id, subscription_id FROM licenses WHERE active AND (id IN (SELECT id FROM seeds) OR bundle_id IN (SELECT bundle_id FROM seeds WHERE bundle_id IS NOT NULL))""", "billing_events licenses")
def revoked_with_siblings(spark, sf_dir):
    ended = view(spark, sf_dir, "billing_events").filter(F.col("event_type") == "customer.subscription.deleted")
    return licences.revoked_with_siblings(view(spark, sf_dir, "licenses"), ended).select("id", "product", "bundle_id", "subscription_id")


_FEATURES = [("free", f) for f in fixed.FREE_FEATURES] + [("pro", f) for f in fixed.PRO_FEATURES]


@query("gated_commands", "J22", f"WITH feats(tier, feature) AS (VALUES {sql_values(_FEATURES)}) SELECT event_id, tier, feature FROM command_log c WHERE NOT EXISTS (SELECT 1 FROM feats f WHERE f.tier = c.tier AND f.feature = c.feature)", "command_log")
def gated_commands(spark, sf_dir):
    return licences.gated_commands(view(spark, sf_dir, "command_log"))


# ---- quotas -------------------------------------------------------------------------
_LIM = "CASE WHEN tier = 'pro' THEN (CASE scan_type WHEN 'audit' THEN -1 WHEN 'deep_scan' THEN 10 ELSE 0 END) ELSE (CASE scan_type WHEN 'audit' THEN 1 ELSE 0 END) END"
QUOTA_SQL = f"""q AS (SELECT *, strftime(ts, '%Y-%m') AS period, {_LIM} AS lim, scan_type = 'audit' AND repo_fingerprint IS NOT NULL AS by_repo FROM usage_requests),
r AS (SELECT *, row_number() OVER (PARTITION BY license_id, repo_fingerprint ORDER BY ts, request_id) AS n FROM q WHERE by_repo),
ra AS (SELECT *, lim = -1 OR n <= lim AS allowed, CASE WHEN lim = -1 THEN n - 1 ELSE least(n - 1, lim) END AS before FROM r),
c AS (SELECT request_id, license_id, scan_type, period, ts, lim, false AS plain FROM ra WHERE allowed UNION ALL SELECT request_id, license_id, scan_type, period, ts, lim, true FROM q WHERE NOT by_repo),
cr AS (SELECT *, row_number() OVER (PARTITION BY license_id, scan_type, period ORDER BY ts, request_id) AS k FROM c),
ca AS (SELECT *, NOT plain OR lim = -1 OR k <= lim AS ok FROM cr),
cb AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY license_id, scan_type, period ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ca),
every AS (SELECT request_id, license_id, scan_type, period, lim, allowed, before FROM ra UNION ALL SELECT request_id, license_id, scan_type, period, lim, ok, before FROM cb WHERE plain)"""


@query("quota_admission", "W2 J24 F15", f"""WITH {QUOTA_SQL} SELECT request_id, license_id, scan_type, period, lim AS "limit", allowed, CAST(before + CAST(allowed AS INT) AS BIGINT) AS used,
 CAST(CASE WHEN NOT allowed THEN 0 WHEN lim = -1 THEN -1 ELSE greatest(0, lim - before - 1) END AS BIGINT) AS remaining FROM every""", "usage_requests")
def quota_admission(spark, sf_dir):
    return licences.quota_admission(view(spark, sf_dir, "usage_requests"))


@query("usage_counts", "A38 F15", "SELECT license_id, scan_type, strftime(ts, '%Y-%m') AS period, count(*) AS n FROM usage_requests GROUP BY ALL", "usage_requests")
def usage_counts(spark, sf_dir):
    return licences.usage_counts(view(spark, sf_dir, "usage_requests"))


@query("audits_per_repo", "A38", "SELECT license_id, repo_fingerprint, count(*) AS n FROM usage_requests WHERE scan_type = 'audit' AND repo_fingerprint IS NOT NULL GROUP BY ALL", "usage_requests")
def audits_per_repo(spark, sf_dir):
    return licences.audits_per_repo(view(spark, sf_dir, "usage_requests"))


@query("repo_fingerprints", "F11", "SELECT page_id, substr(sha256(lower(trim(url))), 1, 16) AS fingerprint FROM repo_urls", "repo_urls")
def repo_fingerprints(spark, sf_dir):
    return view(spark, sf_dir, "repo_urls").select("page_id", keys.repo_fingerprint(F.col("url")).alias("fingerprint"))


# ---- chains -------------------------------------------------------------------------
@query("suppressed_retries", "W12", """WITH RECURSIVE b AS (SELECT repo_url, created_at, min(request_id) AS first_id FROM scan_requests WHERE status IN ('pending', 'error') GROUP BY ALL),
chain AS (SELECT repo_url, min(created_at) AS at FROM b GROUP BY repo_url
 UNION ALL SELECT c.repo_url, (SELECT min(created_at) FROM b WHERE b.repo_url = c.repo_url AND b.created_at > c.at + INTERVAL 30 SECOND) FROM chain c WHERE c.at IS NOT NULL),
adm AS (SELECT c.repo_url, c.at, b.first_id FROM chain c JOIN b ON b.repo_url = c.repo_url AND b.created_at = c.at)
SELECT r.request_id, r.repo_url, r.created_at, r.status, max(a.at) IS NULL AS admitted, max(a.at) AS reused_at FROM scan_requests r LEFT JOIN adm a ON a.repo_url = r.repo_url AND a.first_id <> r.request_id
 AND a.at <= r.created_at AND r.created_at <= a.at + INTERVAL 30 SECOND AND (a.at < r.created_at OR a.first_id < r.request_id) GROUP BY ALL""", "scan_requests")
def suppressed_retries(spark, sf_dir):
    return chains.suppressed_retries(view(spark, sf_dir, "scan_requests"))


@query("session_renewals", "W13", """WITH RECURSIVE s AS (SELECT token, min(ts) AS issued_at, min(ts) AS cur, 0 AS renewals, CAST(NULL AS TIMESTAMP) AS rejected FROM session_uses GROUP BY token
 UNION ALL SELECT token, issued_at, CASE WHEN nx < cur + INTERVAL 30 DAY THEN nx ELSE cur END, renewals + (CASE WHEN nx < cur + INTERVAL 30 DAY THEN 1 ELSE 0 END), CASE WHEN nx >= cur + INTERVAL 30 DAY THEN nx END FROM
 (SELECT s.*, (SELECT min(ts) FROM session_uses u WHERE u.token = s.token AND u.ts > s.cur + INTERVAL 23 DAY) AS nx FROM s WHERE rejected IS NULL) WHERE nx IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY renewals DESC, rejected NULLS LAST) AS k FROM s)
SELECT token, issued_at, renewals, cur AS last_renewal, cur + INTERVAL 30 DAY AS expires_at, rejected AS rejected_from FROM l WHERE k = 1""", "session_uses")
def session_renewals(spark, sf_dir):
    return chains.session_renewals(view(spark, sf_dir, "session_uses"))


# ---- scans --------------------------------------------------------------------------
@query("answered_from_cache", "J23", """WITH d AS (SELECT repo_url, scan_id, created_at, completed_at FROM scans WHERE scan_type = 'free' AND status = 'complete' AND completed_at IS NOT NULL)
SELECT r.request_id, r.repo_url, arg_max(d.scan_id, (d.created_at, d.scan_id)) AS cached_scan, count(d.scan_id) > 0 AS cached FROM scan_requests r LEFT JOIN d ON d.repo_url = r.repo_url AND d.completed_at <= r.created_at GROUP BY ALL""", "scan_requests scans")
def answered_from_cache(spark, sf_dir):
    return scans.answered_from_cache(view(spark, sf_dir, "scan_requests"), view(spark, sf_dir, "scans"))


_PERFECT = "p AS (SELECT repo_url, max(completed_at) AS completed_at, arg_max(scan_id, (completed_at, scan_id)) AS scan_id FROM scans WHERE status = 'complete' AND score = 100 AND completed_at IS NOT NULL GROUP BY repo_url)"


@query("latest_perfect_scans", "W1", f"WITH {_PERFECT} SELECT * FROM p", "scans")
def latest_perfect_scans(spark, sf_dir):
    return scans.latest_perfect_scans(view(spark, sf_dir, "scans"))


@query("rescan_plan", "J17 E16", f"WITH {_PERFECT} SELECT r.project, r.repo_url, r.pushed_at, p.scan_id AS cached_scan, CASE WHEN r.pushed_at <= p.completed_at THEN 'skip' ELSE 'scan' END AS action FROM repos r LEFT JOIN p USING (repo_url)", "repos scans")
def rescan_plan(spark, sf_dir):
    return scans.rescan_plan(view(spark, sf_dir, "repos"), view(spark, sf_dir, "scans")).drop("license", "protected")


@query("previous_deep_scans", "W4", """SELECT repo_url, scan_id, score, completed_at, lag(scan_id) OVER w AS previous_scan, lag(score) OVER w AS previous_score, lag(completed_at) OVER w AS previous_at, score - lag(score) OVER w AS change
FROM scans WHERE scan_type = 'deep' AND status = 'complete' AND completed_at IS NOT NULL WINDOW w AS (PARTITION BY repo_url ORDER BY completed_at, scan_id)""", "scans")
def previous_deep_scans(spark, sf_dir):
    return scans.previous_deep_scans(view(spark, sf_dir, "scans"))


@query("recent_scans", "J18", "SELECT scan_id, repo_url, status, score, s.created_at, username FROM (SELECT * FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 20) s LEFT JOIN users u ON u.id = s.user_id", "scans users")
def recent_scans(spark, sf_dir):
    return scans.recent_scans(view(spark, sf_dir, "scans"), view(spark, sf_dir, "users"))


_ERR = "round_even(CAST(count_if(status = 'error') AS DOUBLE) / count(*) * 100, 1)"


@query("scan_totals", "A32 A36 E14", f"SELECT count(*) AS total_scans, count(DISTINCT user_id) AS unique_users, round_even(avg(score), 1) AS average_score, {_ERR} AS error_rate FROM scans", "scans")
def scan_totals(spark, sf_dir):
    return scans.scan_totals(view(spark, sf_dir, "scans"))


@query("active_users", "A32 A33 E14", "SELECT count(*) AS total_users, count_if(last_seen_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY) AS dau, count_if(last_seen_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS wau FROM users", "users")
def active_users(spark, sf_dir):
    return scans.active_users(view(spark, sf_dir, "users"), F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("scans_per_day", "A34 E14", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM scans GROUP BY 1 ORDER BY 1 DESC LIMIT 30", "scans")
def scans_per_day(spark, sf_dir):
    return scans.per_day(view(spark, sf_dir, "scans"), "created_at")


@query("new_users_per_day", "A34 E14", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM users GROUP BY 1 ORDER BY 1 DESC LIMIT 30", "users")
def new_users_per_day(spark, sf_dir):
    return scans.per_day(view(spark, sf_dir, "users"), "created_at")


@query("most_scanned", "A35 E14", "SELECT repo_url, count(*) AS n FROM scans GROUP BY repo_url ORDER BY n DESC, repo_url LIMIT 10", "scans")
def most_scanned(spark, sf_dir):
    return scans.most_scanned(view(spark, sf_dir, "scans"))


@query("batch_progress", "A42 E16", "WITH d AS (SELECT batch_id, count_if(status IN ('complete', 'error')) AS done FROM scans GROUP BY batch_id) SELECT b.batch_id, b.created_at, b.repo_count, coalesce(done, 0) AS done, coalesce(done, 0) / b.repo_count AS share FROM batches b LEFT JOIN d USING (batch_id)", "batches scans")
def batch_progress(spark, sf_dir):
    return scans.batch_progress(view(spark, sf_dir, "scans"), view(spark, sf_dir, "batches"))


@query("upserted_users", "S15", """WITH l AS (SELECT github_id, arg_max(username, ts) AS name, min(ts) AS first FROM logins GROUP BY github_id)
SELECT github_id, coalesce(l.name, u.username) AS username, coalesce(u.created_at, l.first) AS created_at, u.id IS NULL AS is_new FROM users u FULL JOIN l USING (github_id)""", "users logins")
def upserted_users(spark, sf_dir):
    return scans.upserted_users(view(spark, sf_dir, "users"), view(spark, sf_dir, "logins"))


@query("stored_users", "S15", "SELECT github_id, arg_max(username, (ts, login_id)) AS username, min(ts) AS created_at FROM logins GROUP BY github_id", "logins")
def stored_users(spark, sf_dir):
    """Three parts of the log of logins are merged into a stored table, the later ones first."""
    logins = view(spark, sf_dir, "logins")
    path = scratch_path(spark, "users")
    kind = logins.schema["github_id"].dataType.simpleString()
    stored.create_stored(spark, path, f"github_id {kind}, username string, created_at timestamp, last_login timestamp")
    for batch in range(3):
        part = logins.filter(F.pmod("login_id", F.lit(3)) == 2 - batch).withColumn("ts", F.col("ts").cast("timestamp"))
        stored.upsert_users(spark, path, part, batch)
    made = F.col("created_at").cast(logins.schema["ts"].dataType)
    return stored.read_stored(spark, path).select("github_id", "username", made.alias("created_at"))


_TREE = "t AS (SELECT project, path, CASE WHEN strlen(text) % 7 = 3 THEN text || chr(0) || 'x' ELSE text END AS text FROM corpus)"


def _tree(spark, sf_dir):
    """The corpus as a tree of files in the shared folder; one file in seven is binary."""
    text = F.when(F.octet_length("text") % 7 == 3, F.concat("text", F.lit("\x00x"))).otherwise(F.col("text"))
    root = scratch_path(spark, "tree")
    files = view(spark, sf_dir, "corpus", "project", "path", "text").withColumn("text", text)
    stored.write_corpus(files, root)
    return files, root


@query("corpus_from_storage", "S1 S2", f"""WITH {_TREE}, s AS (SELECT project, path, text, CAST(strlen(text) AS BIGINT) AS size_bytes, contains(text, chr(0)) AS bin FROM t WHERE NOT {EXCLUDED_SQL})
SELECT project, path, CASE WHEN size_bytes <= 8192 AND NOT bin THEN text END AS text, size_bytes, CASE WHEN size_bytes > 8192 THEN 'oversize' WHEN bin THEN 'binary' END AS skipped FROM s""", "corpus")
def corpus_from_storage(spark, sf_dir):
    root = _tree(spark, sf_dir)[1]
    return stored.opened(stored.tree_listing(spark, root), root, max_kb=8).drop("modified", "sha256")


@query("corpus_by_binary_files", "S1 S2", f"""WITH {_TREE}, s AS (SELECT project, path, text, CAST(strlen(text) AS BIGINT) AS size_bytes, contains(text, chr(0)) AS bin FROM t WHERE NOT {EXCLUDED_SQL} AND NOT regexp_matches(path, '(^|/)[._]'))
SELECT project, path, CASE WHEN size_bytes <= 8192 AND NOT bin THEN text END AS text, size_bytes, CASE WHEN size_bytes > 8192 THEN 'oversize' WHEN bin THEN 'binary' END AS skipped FROM s""", "corpus")
def corpus_by_binary_files(spark, sf_dir):
    return file_source.read_corpus(spark, _tree(spark, sf_dir)[1], max_kb=8)


@query("incremental_scan", "S1 J17", f"""WITH {_TREE} SELECT project, path, 'changed' AS what FROM t WHERE NOT {EXCLUDED_SQL} AND strlen(text) % 5 = 1
UNION ALL SELECT project, CASE WHEN touched THEN 'scan' ELSE 'skip' END, 'project' FROM (SELECT project, bool_or(strlen(text) % 5 = 1) AS touched FROM t WHERE NOT {EXCLUDED_SQL} GROUP BY project)""", "corpus")
def incremental_scan(spark, sf_dir):
    """A tree is scanned, one file in five gets a line more, and the second scan opens those only."""
    files, root = _tree(spark, sf_dir)
    _, first = stored.changed_files(spark, root)
    first = cut_lineage(first, "fingerprints")
    edited = files.filter(F.octet_length("text") % 5 == 1).withColumn("text", F.concat("text", F.lit("\none line more")))
    stored.write_corpus(edited, root)
    texts, second = stored.changed_files(spark, root, first)
    plan = stored.folders_to_scan(first, second).filter("folder = ''")
    return texts.select("project", "path", F.lit("changed").alias("what")).unionByName(plan.select("project", F.col("action").alias("path"), F.lit("project").alias("what")))


@query("scan_rows", "F26", """WITH RECURSIVE l AS (SELECT project, path, length(text) - length(replace(text, chr(10), '')) AS n FROM contexts)
SELECT project, path, CASE WHEN n > 40 THEN 'error' ELSE 'complete' END AS status, CASE WHEN n > 40 THEN 'too long' END AS error, CASE WHEN n <= 40 THEN CAST(n AS BIGINT) END AS score, n <= 40 AS has_json FROM l""", "contexts")
def scan_rows(spark, sf_dir):
    contexts = view(spark, sf_dir, "contexts")
    n = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    results = contexts.select("project", "path", F.when(n > 40, "too long").alias("error"), n.cast("bigint").alias("score"))
    rows = scans.scan_rows(results, audit.category_scores(contexts))
    return rows.withColumn("has_json", F.col("category_json").isNotNull() & F.try_parse_json("category_json").isNotNull()).drop("category_json")


@query("normalized_reports", "F29", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'list' WHEN 3 THEN 'unreadable' ELSE 'object' END AS form,
 CASE event_id % 4 WHEN 0 THEN array_to_string(CAST(json(recommendations) AS VARCHAR[]), ',') WHEN 1 THEN array_to_string(CAST(json_extract(recommendations, '$.recommendations') AS VARCHAR[]), ',') ELSE '' END AS recommendations,
 CASE WHEN event_id % 4 = 1 THEN json_extract_string(recommendations, '$.hygiene.grade') END AS hygiene_grade FROM stored_reports""", "stored_reports")
def normalized_reports(spark, sf_dir):
    rows = scans.normalized_reports(view(spark, sf_dir, "stored_reports"))
    return rows.select("event_id", "form", F.array_join("recommendations", ",").alias("recommendations"),
                       F.try_variant_get("hygiene", "$.grade", "string").alias("hygiene_grade"))


# ---- telemetry ----------------------------------------------------------------------
@query("command_counts", "A29 E13", "SELECT name, count(*) AS n FROM telemetry WHERE event_type = 'command' GROUP BY name", "telemetry")
def command_counts(spark, sf_dir):
    return telemetry.name_counts(view(spark, sf_dir, "telemetry"), "command")


@query("gate_counts", "A29 E13", "SELECT name, count(*) AS n FROM telemetry WHERE event_type = 'pro_gate' GROUP BY name", "telemetry")
def gate_counts(spark, sf_dir):
    return telemetry.name_counts(view(spark, sf_dir, "telemetry"), "pro_gate")


@query("event_totals", "A30 E13", "SELECT count(*) AS n_events, min(ts) AS first_event, max(ts) AS last_event FROM telemetry", "telemetry")
def event_totals(spark, sf_dir):
    return telemetry.totals(view(spark, sf_dir, "telemetry"))


@query("daily_activity", "A31 E13", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM telemetry GROUP BY 1 ORDER BY 1 DESC LIMIT 7", "telemetry")
def daily_activity(spark, sf_dir):
    return telemetry.daily_activity(view(spark, sf_dir, "telemetry"))


# ---- repository feeds ---------------------------------------------------------------
_AGE = f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000) AS BIGINT)"
_ISS = f"i AS (SELECT project, count(*) AS open_issues, count_if({_AGE} > 90) AS stale_90d, count_if({_AGE} > 30 AND {_AGE} <= 90) AS stale_30d FROM issues GROUP BY project)"
_PRS = f"p AS (SELECT project, count(*) AS open_prs, count_if(is_draft) AS draft_prs, count_if({_AGE} > 30) AS stale_prs FROM pull_requests WHERE state = 'open' GROUP BY project)"
_WF = """lr AS (SELECT project, workflow, arg_max(coalesce(conclusion, status), run_no) AS outcome FROM workflow_runs GROUP BY ALL),
w AS (SELECT project, count(*) AS workflows, count_if(outcome = 'failure') AS failing_count, coalesce(string_agg(CASE WHEN outcome = 'failure' THEN workflow END, ',' ORDER BY workflow), '') AS failing FROM lr GROUP BY project)"""


@query("stale_issues", "A39 F14", f"WITH {_ISS} SELECT * FROM i", "issues")
def stale_issues(spark, sf_dir):
    return repo_health.stale_issues(view(spark, sf_dir, "issues"), _as_of())


@query("stale_pulls", "A39 F14", f"WITH {_PRS} SELECT * FROM p", "pull_requests")
def stale_pulls(spark, sf_dir):
    return repo_health.stale_pulls(view(spark, sf_dir, "pull_requests"), _as_of())


@query("workflow_state", "A40 W1", f"WITH {_WF} SELECT * FROM w", "workflow_runs")
def workflow_state(spark, sf_dir):
    return repo_health.workflow_state(view(spark, sf_dir, "workflow_runs"))


@query("release_state", "A41", "SELECT project, count(*) AS releases, arg_max(tag, (published_at, tag)) AS latest, max(published_at) AS latest_date FROM releases GROUP BY project", "releases")
def release_state(spark, sf_dir):
    return repo_health.release_state(view(spark, sf_dir, "releases"))


@query("health_report", "A8 E10", f"""WITH {_ISS}, {_PRS}, {_WF}, al AS (SELECT project, CAST(sum(CASE kind WHEN 'dependency' THEN n ELSE 0 END) AS BIGINT) AS dependency_alerts, CAST(sum(CASE kind WHEN 'code' THEN n ELSE 0 END) AS BIGINT) AS code_alerts FROM alerts GROUP BY project),
j AS (SELECT r.project, r.license, r.protected, coalesce(open_issues, 0) AS open_issues, coalesce(stale_90d, 0) AS stale_90d, coalesce(stale_30d, 0) AS stale_30d, coalesce(open_prs, 0) AS open_prs, coalesce(draft_prs, 0) AS draft_prs, coalesce(stale_prs, 0) AS stale_prs,
 coalesce(workflows, 0) AS workflows, coalesce(failing_count, 0) AS failing_count, coalesce(dependency_alerts, 0) AS dependency_alerts, coalesce(code_alerts, 0) AS code_alerts FROM repos r LEFT JOIN i USING (project) LEFT JOIN p USING (project) LEFT JOIN w USING (project) LEFT JOIN al USING (project))
SELECT *, CAST(greatest(0, 100 - least(30, dependency_alerts * 5) - least(30, code_alerts * 10) - least(10, stale_90d * 2) - least(5, stale_30d) - least(10, stale_prs * 3) - (CASE WHEN protected THEN 0 ELSE 10 END) - least(15, failing_count * 5) - (CASE WHEN license IS NULL THEN 5 ELSE 0 END)) AS INT) AS health FROM j""", "repos issues pull_requests workflow_runs alerts")
def health_report(spark, sf_dir):
    t = {n: view(spark, sf_dir, n) for n in ("repos", "issues", "pull_requests", "workflow_runs", "alerts")}
    return repo_health.health_report(t["repos"], t["issues"], t["pull_requests"], t["workflow_runs"], t["alerts"], _as_of())


_F1 = f"SELECT project, 'close_issue' AS action, '#' || number || ': ' || substr(title, 1, 80) AS target, 'No activity for ' || {_AGE} || ' days' AS reason FROM issues WHERE {_AGE} >= 90"
_F2 = f"SELECT project, 'close_pr' AS action, 'PR #' || number || ': ' || substr(title, 1, 80) AS target, 'No activity for ' || {_AGE} || ' days' AS reason FROM pull_requests WHERE state = 'open' AND NOT is_draft AND {_AGE} >= 30"
_F3 = f"SELECT project, 'close_pr' AS action, 'Draft PR #' || number || ': ' || substr(title, 1, 80) AS target, 'Draft with no activity for ' || {_AGE} || ' days' AS reason FROM pull_requests WHERE state = 'open' AND is_draft AND {_AGE} >= 30"
_F4 = f"SELECT project, 'delete_branch' AS action, 'branch `' || head_ref || '` (merged in PR #' || number || ')' AS target, 'Already merged' AS reason FROM pull_requests p WHERE state = 'merged' AND head_ref NOT IN ({sql_list(fixed.PROTECTED_BRANCHES)}) AND EXISTS (SELECT 1 FROM branches b WHERE b.project = p.project AND b.name = p.head_ref)"


@query("stale_issue_plan", "F1 F14", _F1, "issues")
def stale_issue_plan(spark, sf_dir):
    return repo_health.stale_issue_plan(view(spark, sf_dir, "issues"), _as_of())


@query("stale_pull_plan", "F2", _F2, "pull_requests")
def stale_pull_plan(spark, sf_dir):
    return repo_health.stale_pull_plan(view(spark, sf_dir, "pull_requests"), _as_of())


@query("draft_pull_plan", "F3", _F3, "pull_requests")
def draft_pull_plan(spark, sf_dir):
    return repo_health.stale_pull_plan(view(spark, sf_dir, "pull_requests"), _as_of(), drafts=True)


@query("merged_branch_plan", "J20", _F4, "pull_requests branches")
def merged_branch_plan(spark, sf_dir):
    return repo_health.merged_branch_plan(view(spark, sf_dir, "pull_requests"), view(spark, sf_dir, "branches"))


@query("cleanup_plan", "U5 E11", f"({_F1}) UNION ALL ({_F2}) UNION ALL ({_F3}) UNION ALL ({_F4})", "issues pull_requests branches")
def cleanup_plan(spark, sf_dir):
    return repo_health.cleanup_plan(
        view(spark, sf_dir, "issues"), view(spark, sf_dir, "pull_requests"), view(spark, sf_dir, "branches"), _as_of(), close_drafts=True)


# ---- advisories ---------------------------------------------------------------------
def _vk(c: str) -> str:
    """A version as a list of numbers: epoch, release without trailing zeros, -1, phase and number of a pre-release, post, dev."""
    num = lambda p: f"TRY_CAST(nullif(regexp_extract({c}, '{p}', 1), '') AS BIGINT)"
    release = f"list_transform(string_split(regexp_replace(regexp_extract({c}, '^(?:[0-9]+!)?([0-9]+(?:[.][0-9]+)*)', 1), '([.]0+)+$', ''), '.'), lambda p: CAST(p AS BIGINT))"
    phase = f"CASE WHEN regexp_matches({c}, 'dev') THEN 0 WHEN regexp_matches({c}, '[0-9]-?a') THEN 1 WHEN regexp_matches({c}, 'beta') THEN 2 WHEN regexp_matches({c}, 'rc') THEN 3 ELSE 4 END"
    return (f"list_concat([coalesce({num('^([0-9]+)!')}, 0)], {release}, [-1, {phase}, coalesce({num('(?:a|alpha|beta|rc)[.]?([0-9]+)')}, 0), "
            f"coalesce({num('post([0-9]+)')}, -1), coalesce({num('dev([0-9]+)')}, 1000000)])")


_VULN = f"""v AS (SELECT d.*, a.adv_id, coalesce(a.alias, a.adv_id) AS cve_id, CASE WHEN cvss IS NULL THEN 'unknown' WHEN coalesce(TRY_CAST(cvss AS DOUBLE), 0) >= 9 THEN 'critical' WHEN coalesce(TRY_CAST(cvss AS DOUBLE), 0) >= 7 THEN 'high' WHEN coalesce(TRY_CAST(cvss AS DOUBLE), 0) >= 4 THEN 'medium' ELSE 'low' END AS severity,
 substr(a.summary, 1, 200) AS summary, a.summary AS full_summary, a.fixed AS fix_version FROM deps d JOIN advisories a ON a.ecosystem = d.ecosystem AND a.name = d.name WHERE d.version <> '' AND {_vk('d.version')} >= {_vk('a.introduced')} AND (a.fixed IS NULL OR {_vk('d.version')} < {_vk('a.fixed')}))"""


@query("vulnerabilities", "J15", f"WITH {_VULN} SELECT * FROM v", "deps advisories")
def vulnerabilities(spark, sf_dir):
    return advisories.vulnerabilities(view(spark, sf_dir, "deps"), view(spark, sf_dir, "advisories"))


@query("vulnerability_counts", "A44", f"WITH {_VULN} SELECT project, count(*) AS vulnerabilities, " + ", ".join(f"count_if(severity = '{s}') AS n_{s}" for s in ("critical", "high", "medium", "low", "unknown")) + " FROM v GROUP BY project", "deps advisories")
def vulnerability_counts(spark, sf_dir):
    return advisories.severity_counts(
        advisories.vulnerabilities(view(spark, sf_dir, "deps"), view(spark, sf_dir, "advisories")))


# ---- log sinks ----------------------------------------------------------------------
@query("event_log_round_trip", "S10 S16", "SELECT name, count(*) AS n FROM telemetry GROUP BY name", "telemetry")
def event_log_round_trip(spark, sf_dir):
    path = scratch_path(spark, "events")
    tables.append_events(view(spark, sf_dir, "telemetry"), path)
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"))


@query("event_reset", "S16", "SELECT 'logged' AS phase, count(*) AS n FROM telemetry UNION ALL SELECT 'after reset', 0", "telemetry")
def event_reset(spark, sf_dir):
    """All events are logged and counted, then the log is emptied and counted again."""
    path = scratch_path(spark, "events")
    events = view(spark, sf_dir, "telemetry")
    tables.append_events(events, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    counted = lambda phase: spark.read.schema(schema).parquet(path).agg(F.count("*").alias("n")).select(F.lit(phase).alias("phase"), "n")
    logged = cut_lineage(counted("logged"), "logged")
    tables.reset_events(spark, path, schema)
    return logged.unionByName(counted("after reset"))


@query("feed_round_trip", "S13 S14", f"SELECT project, number, title, {_AGE} AS age FROM issues", "issues")
def feed_round_trip(spark, sf_dir):
    from corpuslens.functions.scores import day_age

    path = scratch_path(spark, "issues")
    tables.write_report(view(spark, sf_dir, "issues").withColumn("number", F.col("number").cast("int")), path)
    rows = tables.read_feed(spark, "issues", path)
    return rows.select("project", "number", "title", day_age(_as_of(), F.col("updated_at")).alias("age"))

"""Registered queries: transcripts, gotchas, advice, model-output scoring."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.operators import drift, harvest
from corpuslens.plans.inventory_queries import sql_values
from corpuslens.plans.registry import query
from corpuslens.session import scratch_path, ship_with_tasks
from corpuslens.sources import suites as suite_io
from corpuslens.sources import json_lines
from corpuslens.sources.bindings import table, view
from corpuslens.streaming import jobs
from corpuslens.sources.transcripts import read_transcripts, transcript_items


ship_with_tasks(__name__)


def _s(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _items(spark, sf_dir):
    return transcript_items(view(spark, sf_dir, "transcript_lines"))


_SIG = "substr(trim(text, ' ' || chr(9) || chr(10)), 1, 400)"
for _p, _r in fixed.ERROR_NOISE:
    _SIG = f"regexp_replace({_SIG}, {_s(_p)}, '{_r}', 'g')"
_SIG_INNER = _SIG
_SIG = f"substr({_SIG}, 1, 160)"
ERRORS_SQL = f"""errors AS (SELECT r.session, r.pos, r.tool_id, coalesce(arg_max(u.tool, u.pos), '?') AS tool, arg_max(u.cwd, u.pos) AS cwd, any_value({_SIG.replace('(text,', '(r.text,')}) AS signature, any_value(substr(r.text, 1, 200)) AS example, any_value(sha256(r.text)) AS text_sha256
FROM transcript r LEFT JOIN transcript u ON u.kind = 'use' AND u.session = r.session AND u.tool_id = r.tool_id AND u.pos <= r.pos WHERE r.kind = 'result' AND r.is_error GROUP BY r.session, r.pos, r.tool_id)"""


@query("transcript_items", "S3 F5", "SELECT session, pos, 0 AS item_no, kind, tool_id, tool, cwd, is_error, text FROM transcript", "transcript")
def transcript_items_query(spark, sf_dir):
    return _items(spark, sf_dir)


@query("transcript_files_round_trip", "S3", "SELECT kind, tool, is_error, count(*) AS n FROM transcript GROUP BY ALL", "transcript")
def transcript_files_round_trip(spark, sf_dir):
    """The lines are written as transcript files and read back as such."""
    path = scratch_path(spark, "transcripts")
    view(spark, sf_dir, "transcript_lines").select("line").write.text(path)
    return transcript_items(read_transcripts(spark, path)).groupBy("kind", "tool", "is_error").agg(F.count("*").alias("n"))


def _line_files(spark, sf_dir):
    path = scratch_path(spark, "sessions")
    view(spark, sf_dir, "transcript_lines").select("line").write.text(path)
    return path


@query("session_lines", "S3 S4 S7", "SELECT starts_with(line, '{') AS valid, count(*) AS n FROM (SELECT unnest(string_split(line, chr(10))) AS line FROM transcript_lines) WHERE trim(line) <> '' GROUP BY ALL", "transcript_lines")
def session_lines(spark, sf_dir):
    """Lines of the session logs by the data source: those that are JSON, and those that are not."""
    return json_lines.read_lines(spark, _line_files(spark, sf_dir)).groupBy("valid").agg(F.count("*").alias("n"))


@query("stream_session_items", "S3 R7", "SELECT kind, tool, is_error, count(*) AS n FROM transcript GROUP BY ALL", "transcript")
def stream_session_items(spark, sf_dir):
    """The same files as a stream through the same reader, taken apart."""
    items = transcript_items(json_lines.stream_lines(spark, _line_files(spark, sf_dir)).where("valid"))
    return jobs.run_append(items, "session-items").groupBy("kind", "tool", "is_error").agg(F.count("*").alias("n"))


@query("paired_errors", "J1 F4", f"WITH {ERRORS_SQL} SELECT session, pos, tool_id, tool, cwd, signature, example, text_sha256 FROM errors WHERE signature <> ''", "transcript")
def paired_errors(spark, sf_dir):
    return harvest.paired_errors(_items(spark, sf_dir)).drop("item_no")


@query("errors_below_folder", "J2", f"WITH {ERRORS_SQL} SELECT tool, count(*) AS n FROM errors WHERE starts_with(cwd, '/work/p1') GROUP BY tool", "transcript")
def errors_below_folder(spark, sf_dir):
    return harvest.paired_errors(_items(spark, sf_dir), "/work/p1").groupBy("tool").agg(F.count("*").alias("n"))


GOTCHA_SQL = """g AS (SELECT tool, signature, count(*) AS count, count(DISTINCT session) AS sessions FROM errors GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT *, row_number() OVER (PARTITION BY tool, signature ORDER BY session, pos) AS r FROM errors),
e AS (SELECT tool, signature, string_agg(example, ' || ' ORDER BY r) AS examples FROM x WHERE r <= 3 GROUP BY ALL),
gotchas AS (SELECT g.*, e.examples FROM g JOIN e USING (tool, signature))"""
RULE_SQL = "CASE " + " ".join(
    f"WHEN tool = '{tool}' AND regexp_matches(signature, {_s('(?i)' + p)}) THEN {i}" for i, (tool, p, _, _) in enumerate(fixed.ADVICE_RULES)
) + " END"
RULES_SQL = f"rules(rule_no, title, body) AS (VALUES {sql_values([(i, r[2], r[3]) for i, r in enumerate(fixed.ADVICE_RULES)])})"


@query("gotchas", "A24 W9", f"WITH {ERRORS_SQL}, {GOTCHA_SQL} SELECT * FROM gotchas", "transcript")
def gotchas(spark, sf_dir):
    found = harvest.gotchas(harvest.paired_errors(_items(spark, sf_dir)))
    return found.withColumn("examples", F.array_join("examples", " || "))


_WHOLE = ERRORS_SQL.replace(f"substr({_SIG_INNER}, 1, 160)".replace("(text,", "(r.text,"), _SIG_INNER.replace("(text,", "(r.text,")).replace(
    ", 1, 400)", ", 1)").replace("substr(r.text, 1, 200)", "r.text")


@query("gotchas_by_whole_text", "A24 W9 J1 F4 J12 E5", f"WITH {_WHOLE}, {GOTCHA_SQL.replace('HAVING count(*) >= 2', '')} SELECT * FROM gotchas", "transcript")
def gotchas_by_whole_text(spark, sf_dir):
    """Errors count as the same only if their whole texts are, but for paths, ids and numbers."""
    found = harvest.gotchas(harvest.paired_errors(_items(spark, sf_dir), read=None, kept=None, example=None), min_count=1)
    return found.withColumn("examples", F.array_join("examples", " || "))


@query("harvest_report", "E5 J12 W5", f"""WITH {ERRORS_SQL}, {GOTCHA_SQL}, {RULES_SQL}, a AS (SELECT *, {RULE_SQL} AS rule_no FROM gotchas)
SELECT row_number() OVER (ORDER BY count DESC, tool, signature) AS rank, tool, signature, count, sessions, title FROM a LEFT JOIN rules USING (rule_no) ORDER BY count DESC, tool, signature LIMIT 10""", "transcript")
def harvest_report(spark, sf_dir):
    advised = harvest.with_advice(harvest.gotchas(harvest.paired_errors(_items(spark, sf_dir))))
    return harvest.ranked_gotchas(advised).select("rank", "tool", "signature", "count", "sessions", "title")


BULLETS_SQL = f"""pg AS (SELECT cwd, tool, signature, count(*) AS count FROM errors GROUP BY ALL HAVING count(*) >= 2),
pa AS (SELECT *, {RULE_SQL} AS rule_no FROM pg), pb AS (SELECT cwd, title, body, count, tool, signature FROM pa JOIN rules USING (rule_no)),
pf AS (SELECT *, row_number() OVER (PARTITION BY cwd, title ORDER BY count DESC, tool, signature) AS r FROM pb)"""


def _bullets(spark, sf_dir):
    errors = harvest.paired_errors(_items(spark, sf_dir))
    return harvest.advice_bullets(harvest.with_advice(harvest.gotchas(errors, "cwd")), "cwd")


@query("advice_bullets", "F23 W11", f"""WITH {ERRORS_SQL}, {RULES_SQL}, {BULLETS_SQL}
SELECT cwd, string_agg('- **' || title || '** — ' || body, chr(10) ORDER BY count DESC, tool, signature) AS bullets FROM pf WHERE r = 1 GROUP BY cwd""", "transcript")
def advice_bullets(spark, sf_dir):
    return _bullets(spark, sf_dir).withColumn("bullets", F.array_join("bullets", "\n"))


@query("patched_documents", "E6 F22 F23", f"""WITH {ERRORS_SQL}, {RULES_SQL}, {BULLETS_SQL},
docs AS (SELECT project, path, text, CASE WHEN contains(text, '## Anti-Patterns') THEN split_part(substr(text, strpos(text, '## Anti-Patterns')), chr(10) || '## ', 1) ELSE '' END AS section FROM contexts),
j AS (SELECT d.project, d.path, d.section, f.title FROM docs d LEFT JOIN pf f ON f.r = 1 AND f.cwd = '/work/p' || substr(d.project, 4))
SELECT project, path, CAST(count(title) FILTER (NOT contains(lower(section), '**' || lower(title) || '**')) AS INT) AS added, CAST(count(title) FILTER (contains(lower(section), '**' || lower(title) || '**')) AS INT) AS skipped FROM j GROUP BY ALL""", "transcript contexts")
def patched_documents(spark, sf_dir):
    bullets = _bullets(spark, sf_dir).select(
        F.concat(F.lit("src"), F.regexp_extract("cwd", r"(\d+)$", 1)).alias("project"), "bullets")
    docs = view(spark, sf_dir, "contexts").join(bullets, "project", "left")
    return harvest.spliced_documents(docs).select("project", "path", "added", "skipped")


@query("patched_texts", "F22")
def patched_texts(spark, sf_dir):
    bullets = _bullets(spark, sf_dir).select(
        F.concat(F.lit("src"), F.regexp_extract("cwd", r"(\d+)$", 1)).alias("project"), "bullets")
    docs = view(spark, sf_dir, "contexts").join(bullets, "project", "left")
    return harvest.spliced_documents(docs).select("project", "path", "patched")


# ---- drift --------------------------------------------------------------------------
def _outputs(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("judge_score"))
    return view(spark, sf_dir, "outputs").join(judged, "doc_id", "left")


def _results(spark, sf_dir):
    return drift.benchmark_results(_outputs(spark, sf_dir), drift.suites(view(spark, sf_dir, "checks")))


_FENCED = "regexp_extract(output, '(?s)' || repeat(chr(96), 3) || '(?:json)?\\s*\\n(.*?)' || repeat(chr(96), 3), 1)"
_SEC = "list_bool_and(list_transform(string_split(sections, '|'), lambda s: contains(lower(output), '# ' || lower(s)) OR contains(lower(output), '**' || lower(s) || '**')))"
RESULTS_SQL = f"""o AS (SELECT o.*, l.quality FROM outputs o LEFT JOIN labels l USING (doc_id)),
cr AS (SELECT o.run_id, o.model, o.ts, o.benchmark_id, c.check_no, c.type, CASE c.type
 WHEN 'pattern_present' THEN regexp_matches(output, '(?is)' || pattern) WHEN 'pattern_absent' THEN NOT regexp_matches(output, '(?is)' || pattern)
 WHEN 'length_range' THEN len(list_filter(string_split_regex(output, '\\s+'), lambda w: w <> '')) BETWEEN min_words AND coalesce(max_words, 1000000000)
 WHEN 'json_valid' THEN json_valid(output) OR ({_FENCED} <> '' AND json_valid({_FENCED})) WHEN 'contains_sections' THEN {_SEC}
 WHEN 'llm_judge' THEN coalesce(quality >= threshold, false) ELSE false END AS passed FROM o JOIN checks c USING (benchmark_id) WHERE output IS NOT NULL),
br AS (SELECT o.run_id, o.model, o.ts, o.benchmark_id, o.output IS NULL AS failed, coalesce(w.weight, 1.0) AS weight, coalesce(n, 0) AS n_checks, coalesce(p, 0) AS n_passed,
 CASE WHEN o.output IS NULL THEN 0.0 WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE p / n END AS score
 FROM o LEFT JOIN (SELECT run_id, benchmark_id, count(*) AS n, count_if(passed) AS p FROM cr GROUP BY ALL) k ON k.run_id = o.run_id AND k.benchmark_id = o.benchmark_id
 LEFT JOIN (SELECT benchmark_id, max(weight) AS weight FROM checks GROUP BY ALL) w ON w.benchmark_id = o.benchmark_id)"""


@query("check_results", "F6 F7 F8 F9 F10 UDF3", f"WITH {RESULTS_SQL} SELECT run_id, benchmark_id, check_no, type, passed FROM cr", "outputs checks")
def check_results(spark, sf_dir):
    return drift.check_results(_results(spark, sf_dir)).drop("message")


@query("benchmark_scores", "A25 J13", f"WITH {RESULTS_SQL} SELECT run_id, model, benchmark_id, weight, score, n_checks, n_passed FROM br", "outputs checks")
def benchmark_scores(spark, sf_dir):
    return _results(spark, sf_dir).drop("results", "ts")


@query("failing_checks", "A28", f"""WITH {RESULTS_SQL}, f AS (SELECT run_id, benchmark_id, string_agg(type, ',' ORDER BY check_no) AS failing FROM cr WHERE NOT passed GROUP BY ALL)
SELECT br.run_id, br.benchmark_id, score, CASE WHEN score >= 0.8 THEN 'PASS' WHEN score >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS status, n_passed, n_checks, coalesce(failing, '') AS failing
FROM br LEFT JOIN f USING (run_id, benchmark_id)""", "outputs checks")
def failing_checks(spark, sf_dir):
    return drift.failing_checks(_results(spark, sf_dir))


RUNS_SQL = "rs AS (SELECT run_id, model, ts, coalesce(sum(score * weight) / nullif(sum(weight), 0), 0.0) AS score, count(*) AS n_benchmarks FROM br GROUP BY ALL)"
SEV_SQL = "CASE WHEN delta <= -0.15 THEN 'critical' WHEN delta <= -0.05 THEN 'warning' WHEN delta >= 0.05 THEN 'improved' ELSE 'stable' END"


@query("drift_runs", "A26 J14 W7 E12", f"""WITH {RESULTS_SQL}, {RUNS_SQL}, b AS (SELECT model, arg_min(score, ts) AS base FROM rs GROUP BY model),
d AS (SELECT rs.*, CASE WHEN base IS NULL THEN 0.0 ELSE score - base END AS delta, base AS baseline_score FROM rs LEFT JOIN b USING (model))
SELECT run_id, model, score, n_benchmarks, baseline_score, delta, {SEV_SQL} AS severity FROM d""", "outputs checks")
def drift_runs(spark, sf_dir):
    runs = drift.run_scores(_results(spark, sf_dir))
    return drift.against_baseline(runs, drift.first_runs(runs)).drop("ts")


HIST_SQL = f"""h AS (SELECT r.*, score - base AS delta FROM run_history r JOIN (SELECT model, arg_min(score, ts) AS base FROM run_history GROUP BY model) b USING (model)),
hs AS (SELECT *, {SEV_SQL} AS severity FROM h)"""


def _history(spark, sf_dir):
    runs = view(spark, sf_dir, "run_history").withColumn("score", F.col("score").cast("double"))
    return drift.against_baseline(runs, drift.first_runs(runs)).drop("baseline_score")


@query("trend_points", "W10 O5", f"""WITH {HIST_SQL}, e AS (SELECT model, min(score) AS lo, max(score) AS hi FROM hs GROUP BY model),
n AS (SELECT *, (score - lo) / (CASE WHEN hi <> lo THEN hi - lo ELSE 1.0 END) AS normalized FROM hs JOIN e USING (model))
SELECT run_id, model, strftime(ts, '%Y-%m-%d') AS day, normalized, greatest(1, CAST(floor(normalized * 60) AS INT)) AS bar,
 CASE severity WHEN 'critical' THEN '!' WHEN 'warning' THEN '~' WHEN 'improved' THEN '+' ELSE ' ' END AS mark, CASE WHEN delta = 0 THEN ' 0.00' ELSE format('{{:+.2f}}', delta) END AS delta_text FROM n""", "run_history")
def trend_points(spark, sf_dir):
    return drift.trend_points(_history(spark, sf_dir))


@query("trend_summary", "A27 O5", "SELECT model, count(*) AS runs, arg_max(score, ts) AS latest, max(score) AS best, min(score) AS worst FROM run_history GROUP BY model", "run_history")
def trend_summary(spark, sf_dir):
    return drift.trend_summary(_history(spark, sf_dir))


@query("run_history_round_trip", "S6 S7 S8 S9 S14", f"WITH {HIST_SQL} SELECT run_id, model, score, severity, strftime(ts, '%Y-%m-%d') AS day FROM hs", "run_history")
def run_history_round_trip(spark, sf_dir):
    path = scratch_path(spark, "runs")
    suite_io.save_runs(_history(spark, sf_dir), path)
    return suite_io.load_runs(spark, path).select(
        "run_id", "model", "score", "severity", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("trend_cache_round_trip", "S9", "SELECT run_id, model, score FROM run_history", "run_history")
def trend_cache_round_trip(spark, sf_dir):
    path = scratch_path(spark, "trend")
    points = _history(spark, sf_dir).select("run_id", "model", "score")
    suite_io.save_trend(points, path)
    return suite_io.load_trend(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema))


@query("baseline_round_trip", "S8", "SELECT model, arg_min(score, ts) AS score FROM run_history GROUP BY model", "run_history")
def baseline_round_trip(spark, sf_dir):
    path = scratch_path(spark, "baseline")
    suite_io.save_baseline(drift.first_runs(_history(spark, sf_dir)), path)
    return suite_io.load_baseline(spark, path)


RAW_SUITES = (
    "SELECT item_id, (CASE WHEN item_id % 4 = 3 THEN 'no json here ' || text ELSE 'Sure! ' || (CASE WHEN item_id % 2 = 0 THEN '' ELSE 'Here it is:' || chr(10) END) "
    "|| '{' || chr(34) || 'benchmarks' || chr(34) || ': [{' || chr(34) || 'id' || chr(34) || ': ' || chr(34) || 'b' || item_id || chr(34) || ', ' || chr(34) || 'prompt' || chr(34) || ': ' || chr(34) "
    "|| replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' ') || chr(34) || ', ' || chr(34) || 'checks' || chr(34) || ': [{' || chr(34) || 'type' || chr(34) || ': ' || chr(34) || 'pattern_present' || chr(34) || ', ' "
    "|| chr(34) || 'pattern' || chr(34) || ': ' || chr(34) || 'p' || item_id || chr(34) || '}, {' || chr(34) || 'type' || chr(34) || ': ' || chr(34) || 'vibes' || chr(34) || '}, {' || chr(34) || 'type' || chr(34) || ': ' || chr(34) || 'length_range' || chr(34) "
    "|| ', ' || chr(34) || 'min_words' || chr(34) || ': ' || item_id || '}]}]}' || chr(10) || 'Done.' END) AS response FROM benchmark"
)


@query("normalized_suites", "UDF5 F30 S4", """SELECT item_id, 1 AS version, 'b' || item_id AS benchmark_id, CAST(1.0 AS DOUBLE) AS weight, j AS check_no, CASE j WHEN 0 THEN 'pattern_present' ELSE 'length_range' END AS type,
 CASE j WHEN 0 THEN 'p' || item_id END AS pattern, CASE j WHEN 1 THEN item_id END AS min_words, CAST(NULL AS INT) AS max_words, CAST(0.8 AS DOUBLE) AS threshold, CAST(NULL AS VARCHAR) AS sections
FROM benchmark, (VALUES (0), (1)) v(j) WHERE item_id % 4 <> 3""")
def normalized_suites(spark, sf_dir):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return drift.normalized_suites(spark.sql(RAW_SUITES))


RAW_FIXES = (
    "SELECT item_id, 'Suggestions: [{' || chr(34) || 'benchmark_id' || chr(34) || ': ' || chr(34) || 'b' || item_id || chr(34) || ', ' || chr(34) || 'description' || chr(34) || ': ' || chr(34) || 'd' || chr(34) || ', ' "
    "|| chr(34) || 'addition' || chr(34) || ': ' || chr(34) || replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' ') || chr(34) || ', ' || chr(34) || 'confidence' || chr(34) || ': 0.' || (item_id % 9 + 1) || '}, {' || chr(34) || 'benchmark_id' || chr(34) || ': ' || chr(34) || 'x' || chr(34) || '}] end' AS response FROM benchmark"
)


@query("fix_candidates", "F30 E12", "SELECT item_id, 'b' || item_id AS benchmark_id, 'd' AS description, replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' ') AS addition, (item_id % 9 + 1) / 10 AS confidence FROM benchmark")
def fix_candidates(spark, sf_dir):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return drift.fix_candidates(spark.sql(RAW_FIXES))


@query("suite_round_trip", "S4 S5", "SELECT benchmark_id, check_no - min(check_no) OVER (PARTITION BY benchmark_id) AS first_gap, type, min_words, max_words, sections FROM checks WHERE type <> 'vibes'", "checks")
def suite_round_trip(spark, sf_dir):
    """Suites written as JSON files and read back; the check number keeps its gap to the first."""
    checks = view(spark, sf_dir, "checks").filter(F.col("type") != "vibes")
    one = F.struct(
        "check_no", "type", "pattern", F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("criteria"),
        "threshold", "min_words", "max_words", F.split("sections", r"\|").alias("sections"))
    packed = checks.groupBy("benchmark_id").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list(one)).alias("checks"))
    suites = packed.select(F.lit(1).alias("version"), F.array(F.struct(
        F.col("benchmark_id").alias("id"), F.lit("").alias("prompt"), "weight", "checks")).alias("benchmarks"))
    path = scratch_path(spark, "suites")
    suite_io.write_suites(suites, path)
    back = suite_io.suite_checks(suite_io.read_suites(spark, path, many_lines=False)).select("benchmark_id", "type", "min_words", "max_words", "sections")
    numbers = checks.groupBy("benchmark_id").agg(F.min("check_no").alias("_first"))
    typed = checks.select("benchmark_id", "type", "check_no").join(numbers, "benchmark_id")
    return back.join(typed, ["benchmark_id", "type"]).select(
        "benchmark_id", (F.col("check_no") - F.col("_first")).alias("first_gap"), "type", "min_words", "max_words", "sections")


def word_share_judge(prompt: str) -> str:
    """Stand-in for a user's model client: the share of distinct words."""
    text = prompt.split("## Output to evaluate\n", 1)[1].split()
    return json.dumps({"score": len(set(text)) / max(len(text), 1)})


@query("judged_outputs", "UDF1 F10", r"""SELECT run_id, benchmark_id, s AS judge_score, s >= 0.5 AS passed FROM (SELECT run_id, benchmark_id,
 CASE WHEN output IS NULL THEN 1.0 ELSE CAST(len(list_distinct(w)) AS DOUBLE) / greatest(len(w), 1) END AS s
 FROM (SELECT run_id, benchmark_id, output, regexp_extract_all(output, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}]+') AS w FROM outputs))""", "outputs")
def judged_outputs(spark, sf_dir):
    rows = view(spark, sf_dir, "outputs").select("run_id", "benchmark_id", "output")
    return drift.judge_outputs(rows, word_share_judge, "varied wording", 0.5)


@query("drift_report_json", "S14 E12", f"""WITH {RESULTS_SQL}, {RUNS_SQL} SELECT run_id, model, n_benchmarks, true AS is_json FROM rs""", "outputs checks")
def drift_report_json(spark, sf_dir):
    """The per-run report as one JSON text per benchmark, counted back per run."""
    results = _results(spark, sf_dir)
    lines = results.select("run_id", "model", F.to_json(F.struct("benchmark_id", "score", "results")).alias("line"))
    return lines.groupBy("run_id", "model").agg(
        F.count("*").alias("n_benchmarks"), F.bool_and(F.try_parse_json("line").isNotNull()).alias("is_json"))

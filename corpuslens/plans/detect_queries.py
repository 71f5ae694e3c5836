"""Registered queries: leak and debt detectors, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.functions.rules import Rule
from corpuslens.operators import detect, rule_packs
from corpuslens.operators import inventory as inv
from corpuslens.plans.inventory_queries import FILES_SQL, IS_TEST_SQL, KEY_SQL, NAME_SQL, sql_list
from corpuslens.plans.registry import query
from corpuslens.sources.bindings import view

TOKEN_RULE = Rule(r'token\s*=\s*"[0-9a-f]{40}"', "secrets", "critical", "Hex token literal")


def token_pack():
    return detect.custom_pack([TOKEN_RULE], ("token",), F.col("_scannable"))


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SCANNABLE_SQL = f"(lang IS NOT NULL OR ext IN ({sql_list(fixed.LEAK_EXTRA_EXTS)}) OR starts_with({NAME_SQL}, '.env'))"
LINES_SQL = (
    "lines AS (SELECT f.project, f.path, f.ext, f.lang, u.line, u.n, "
    "trim(u.line, ' ' || chr(9)) AS bare, "
    "contains(f.path, '.example') OR contains(f.path, '.sample') AS sample, "
    "regexp_matches(lower(substr(f.text, 1, 500)), 'grep|gitleaks|opsec|secret\\.scan|bandit') AS script, "
    f"{IS_TEST_SQL.replace('path', 'f.path')} AS is_test "
    "FROM files f, unnest(string_split(f.text, chr(10))) WITH ORDINALITY AS u(line, n))"
)
PLACE = f"regexp_matches(line, {_s(fixed.PLACEHOLDER)})"
NULL_LINE = "CAST(NULL AS INT)"

HOME_SQL = (
    "SELECT project, path, n AS line, 'local_paths' AS category, 'high' AS severity, "
    "'Local filesystem path exposed: ' || substr(bare, 1, 80) AS message FROM lines "
    f"WHERE {SCANNABLE_SQL} AND regexp_matches(line, {_s(fixed.HOME_PATH)})"
)
VENDOR_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(line, {_s(rx)}) THEN 'Possible {label} detected'" for rx, label in fixed.VENDOR_KEYS
) + " END"
VENDOR_SQL = (
    f"SELECT * FROM (SELECT project, path, n AS line, 'secrets' AS category, 'critical' AS severity, {VENDOR_CASE} AS message FROM lines "
    f"WHERE {SCANNABLE_SQL} AND NOT sample AND NOT script AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '//') "
    f"AND NOT contains(lower(bare), 'grep') AND NOT contains(bare, 'rg ') AND NOT {PLACE}) WHERE message IS NOT NULL"
)
KEY_BLOCK_SQL = (
    f"SELECT project, path, {NULL_LINE} AS line, 'secrets' AS category, 'critical' AS severity, "
    f"'Private key material found in tracked file' AS message FROM files WHERE {SCANNABLE_SQL} AND regexp_matches(text, {_s(fixed.PRIVATE_KEY)})"
)
PASSWORD_SQL = (
    "SELECT project, path, n AS line, 'credentials' AS category, 'high' AS severity, 'Hardcoded password or secret value' AS message "
    f"FROM lines WHERE {SCANNABLE_SQL} AND NOT sample AND regexp_matches(line, {_s(fixed.PASSWORD_LITERAL)}) AND NOT {PLACE}"
)
DB_SQL = (
    "SELECT project, path, n AS line, 'credentials' AS category, 'critical' AS severity, 'Database connection string with embedded credentials' AS message "
    f"FROM lines WHERE {SCANNABLE_SQL} AND NOT sample AND regexp_matches(line, {_s(fixed.DB_URL)}) AND NOT {PLACE}"
)
TOKEN_SQL = (
    "SELECT project, path, n AS line, 'secrets' AS category, 'critical' AS severity, 'Hex token literal' AS message "
    f"FROM lines WHERE {SCANNABLE_SQL} AND regexp_matches(line, {_s(TOKEN_RULE.pattern)})"
)
STRATEGY_SQL = (
    f"SELECT project, path, {NULL_LINE} AS line, 'strategy_docs' AS category, 'high' AS severity, "
    f"'Strategy/outreach document tracked: ' || {NAME_SQL} AS message FROM files WHERE lower({NAME_SQL}) IN ({sql_list(fixed.STRATEGY_FILES)})"
)
ENV_SQL = (
    f"SELECT project, path, {NULL_LINE} AS line, 'credentials' AS category, 'critical' AS severity, "
    f"'Real .env file tracked (should be in .gitignore)' AS message FROM files WHERE path = '.env' OR path LIKE '%/.env'"
)
INTERVIEW_SQL = (
    f"SELECT project, path, {NULL_LINE} AS line, 'strategy_docs' AS category, 'low' AS severity, "
    "'Possible interview artifact (consider if repo should be private)' AS message FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY project ORDER BY {KEY_SQL}) AS r FROM files WHERE regexp_matches(lower(path), {_s(fixed.INTERVIEW)})) WHERE r = 1"
)
LEAKS_SQL = " UNION ALL ".join(
    f"({q})" for q in (HOME_SQL, VENDOR_SQL, KEY_BLOCK_SQL, PASSWORD_SQL, DB_SQL, TOKEN_SQL, STRATEGY_SQL, ENV_SQL, INTERVIEW_SQL)
)
LEAK_CTES = f"{FILES_SQL}, {LINES_SQL}, leaks AS ({LEAKS_SQL})"

MARKER_MSG = "CASE " + " ".join(
    f"WHEN regexp_matches(line, {_s(rx)}) THEN '{label}: ' || substr(bare, 1, 120)" for rx, label, _ in fixed.DEBT_MARKERS
) + " END"
MARKER_SQL = (
    "SELECT project, path, line, 'debt_markers' AS category, CASE WHEN regexp_matches(message, '^(FIXME|HACK|KLUDGE): ') THEN 'high' ELSE 'medium' END AS severity, message "
    f"FROM (SELECT project, path, n AS line, {MARKER_MSG} AS message FROM lines WHERE lang IS NOT NULL) WHERE message IS NOT NULL"
)
SECRET_SQL = (
    "SELECT project, path, n AS line, 'security' AS category, 'critical' AS severity, 'Potential hardcoded secret/credential' AS message "
    "FROM lines WHERE lang IS NOT NULL AND (" + " OR ".join(f"regexp_matches(line, {_s(rx)})" for rx in fixed.QUOTED_SECRETS) + ")"
)
# a multi-line match starts on the line after the last line that is not blank
STARTS_SQL = (
    "starts AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(line, '\\S') THEN n END) OVER (PARTITION BY project, path ORDER BY n "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_line FROM lines)"
)
PY_SQL = "ext IN ('.py', '.pyi') AND NOT is_test"
BARE_SQL = (
    "SELECT project, path, first_line AS line, 'error_handling' AS category, 'high' AS severity, "
    "'Bare `except:` catches all exceptions including SystemExit/KeyboardInterrupt' AS message "
    f"FROM starts WHERE {PY_SQL} AND regexp_matches(line, {_s(fixed.BARE_EXCEPT)})"
)
BROAD_SQL = (
    "SELECT project, path, first_line AS line, 'error_handling' AS category, 'medium' AS severity, "
    "'Broad `except Exception` — consider catching specific exceptions' AS message "
    f"FROM starts WHERE {PY_SQL} AND regexp_matches(line, {_s(fixed.BROAD_EXCEPT)})"
)
PRINT_SQL = (
    "SELECT project, path, first_line AS line, 'code_quality' AS category, 'low' AS severity, "
    "'print() in production code — use logging module' AS message "
    f"FROM starts WHERE {PY_SQL} AND regexp_matches(line, {_s(fixed.PRINT_CALL)})"
)
CONSOLE_SQL = (
    "SELECT project, path, n AS line, 'code_quality' AS category, 'low' AS severity, 'console.log() in production code' AS message "
    f"FROM (SELECT *, unnest(regexp_extract_all(line, {_s(fixed.CONSOLE_LOG)})) FROM lines WHERE ext IN ({sql_list(fixed.JS_EXTS)}) AND NOT is_test)"
)


def _functions_sql(pattern: str, exts, name: str) -> str:
    p = _s("(?m)" + pattern)
    nl = "length({0}) - length(replace({0}, chr(10), ''))"
    return (
        f"SELECT project, path, total, i, g1, {name} AS name, "
        f"CAST(1 + list_sum(list_transform(pieces[1:i], lambda s: {nl.format('s')})) + coalesce(list_sum(list_transform(g0[1:i - 1], lambda s: {nl.format('s')})), 0) AS BIGINT) AS line FROM ("
        f"SELECT *, unnest(range(1, len(g0) + 1)) AS i FROM (SELECT project, path, {nl.format('text')} + (CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END) AS total, "
        f"string_split_regex(text, {p}) AS pieces, regexp_extract_all(text, {p}, 0) AS g0, regexp_extract_all(text, {p}, 1) AS g1, regexp_extract_all(text, {p}, 2) AS g2"
        + (f", regexp_extract_all(text, {p}, 3) AS g3" if "g3" in name else "")
        + f" FROM files WHERE ext IN ({sql_list(exts)}) AND NOT {IS_TEST_SQL}))"
    )


DEFS_SQL = "defs AS (" + " UNION ALL ".join(
    f"({_functions_sql(*a)})" for a in (
        (fixed.PY_DEF, fixed.PY_EXTS, "g2[i]"),
        (fixed.JS_DEF, fixed.JS_EXTS, "coalesce(nullif(g2[i], ''), nullif(g3[i], ''), 'anonymous')"),
        (fixed.RS_DEF, (".rs",), "g2[i]"),
    )
).replace("total, i, g1,", "total, i, length(g1[i]) AS indent,") + (
    "), sized AS (SELECT *, (CASE WHEN lead(indent) OVER w <= indent THEN lead(line) OVER w - 1 ELSE total END) - (line - 1) AS size "
    "FROM defs WINDOW w AS (PARTITION BY project, path ORDER BY i))"
)
LONG_FN_SQL = (
    "SELECT project, path, line, 'complexity' AS category, 'medium' AS severity, "
    "'Function `' || name || '` is ' || size || ' lines (>50)' AS message FROM sized WHERE size > 50"
)
NEST_SQL = (
    "SELECT project, path, line, 'complexity' AS category, 'medium' AS severity, 'Deep nesting: ' || level || ' levels (>=5)' AS message FROM ("
    "SELECT project, path, level, n AS line, row_number() OVER (PARTITION BY project, path ORDER BY level DESC, n) AS r FROM ("
    "SELECT project, path, n, CAST(floor(length(regexp_replace(regexp_extract(line, '^[ \\t]*'), ' {4}| {0,3}\\t', '    ', 'g')) / 4) AS INT) AS level "
    "FROM lines WHERE lang IS NOT NULL AND NOT is_test AND regexp_matches(line, '\\S'))) WHERE r = 1 AND level >= 5"
)
NEWLINES = "length(text) - length(replace(text, chr(10), ''))"
LONG_FILE_SQL = (
    f"SELECT project, path, {NULL_LINE} AS line, 'complexity' AS category, 'high' AS severity, "
    f"'God file: ' || ({NEWLINES}) || ' lines (>500)' AS message FROM files WHERE lang IS NOT NULL AND {NEWLINES} > 500"
)
HYGIENE_SQL = f"""SELECT project, '<project>' AS path, {NULL_LINE} AS line, u.category, u.severity, u.message FROM (
SELECT project, count(*) AS n, bool_or({IS_TEST_SQL}) AS tests,
 bool_or(contains(path, '.github/workflows') OR contains(path, '.gitlab-ci') OR contains(path, 'Jenkinsfile') OR contains(path, '.circleci')) AS ci,
 bool_or({NAME_SQL} IN ({sql_list(fixed.LINTER_FILES)}) OR {NAME_SQL} = 'pyproject.toml' AND (contains(text, '[tool.ruff') OR contains(text, '[tool.pylint') OR contains(text, '[tool.flake8'))) AS linter,
 bool_or({NAME_SQL} = '.gitignore') AS ignored FROM corpus GROUP BY project) f,
 (VALUES (1, 'testing', 'critical', 'No test directory or test files found'), (2, 'infrastructure', 'medium', 'No CI/CD configuration found'),
  (3, 'infrastructure', 'medium', 'No linter configuration found'), (4, 'infrastructure', 'low', 'No .gitignore file')) u(i, category, severity, message)
WHERE (i = 1 AND NOT tests AND n > 5) OR (i = 2 AND NOT ci AND n > 10) OR (i = 3 AND NOT linter AND n > 5) OR (i = 4 AND NOT ignored AND n > 3)"""
DEBT_SQL = " UNION ALL ".join(
    f"({q})" for q in (HYGIENE_SQL, LONG_FILE_SQL, MARKER_SQL, SECRET_SQL, BARE_SQL, BROAD_SQL, PRINT_SQL, CONSOLE_SQL, LONG_FN_SQL, NEST_SQL)
)
DEBT_CTES = f"{FILES_SQL}, {LINES_SQL}, {STARTS_SQL}, {DEFS_SQL}, debt AS ({DEBT_SQL})"
COLS = "project, path, line, category, severity, message"
SCORE_SQL = (
    "SELECT p.project, count(f.project) AS n_findings, "
    + ", ".join(f"count_if(severity = '{s}') AS n_{s}" for s in fixed.SEVERITY_WEIGHT)
    + ", greatest(0, least(100, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END), 0)))::INT AS score "
    "FROM (SELECT DISTINCT project FROM corpus) p LEFT JOIN {0} f ON f.project = p.project GROUP BY p.project"
)


def _corpus(spark, sf_dir):
    return view(spark, sf_dir, "corpus")


def _leaks(spark, sf_dir):
    return detect.leak_findings(_corpus(spark, sf_dir), [token_pack()], _paths(spark, sf_dir))


def _debt(spark, sf_dir):
    return detect.debt_findings(_corpus(spark, sf_dir), _paths(spark, sf_dir))


def _paths(spark, sf_dir):
    return view(spark, sf_dir, "corpus", "project", "path")


@query("leak_home_paths", "D1 P11", f"WITH {FILES_SQL}, {LINES_SQL} {HOME_SQL}", "corpus")
def leak_home_paths(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [detect.leak_packs()["home"]])


@query("leak_vendor_keys", "D2 P8 P9 P10 P12", f"WITH {FILES_SQL}, {LINES_SQL} {VENDOR_SQL}", "corpus")
def leak_vendor_keys(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [detect.leak_packs()["vendor"]])


@query("leak_vendor_keys_everywhere", "P8 D2", f"WITH {FILES_SQL}, {LINES_SQL} {VENDOR_SQL.replace('AND NOT script ', '')}", "corpus")
def leak_vendor_keys_everywhere(spark, sf_dir):
    """Also in files whose opening names a secret scanner."""
    return detect.text_findings(_corpus(spark, sf_dir), [detect.leak_packs(scan_scripts=True)["vendor"]])


@query("leak_home_lines", "D1", f"WITH {FILES_SQL}, {LINES_SQL} {HOME_SQL.replace('substr(bare, 1, 80)', 'bare')}", "corpus")
def leak_home_lines(spark, sf_dir):
    """Home paths with their whole lines."""
    return detect.text_findings(_corpus(spark, sf_dir), [detect.leak_packs(chars=None)["home"]])


@query("leak_passwords", "D4 P9 P10", f"WITH {FILES_SQL}, {LINES_SQL} {PASSWORD_SQL}", "corpus")
def leak_passwords(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [detect.leak_packs()["password"]])


@query("leak_database_urls", "D5 P9 P10", f"WITH {FILES_SQL}, {LINES_SQL} {DB_SQL}", "corpus")
def leak_database_urls(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [detect.leak_packs()["database"]])


@query("leak_private_keys", "D3", f"WITH {FILES_SQL} {KEY_BLOCK_SQL}", "corpus")
def leak_private_keys(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [], detect.private_key_finding())


@query("leak_extra_rule_pack", "UDF4 P12", f"WITH {FILES_SQL}, {LINES_SQL} {TOKEN_SQL}", "corpus")
def leak_extra_rule_pack(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [token_pack()])


@query("leak_strategy_documents", "D6", f"WITH {FILES_SQL} {STRATEGY_SQL}", "corpus")
def leak_strategy_documents(spark, sf_dir):
    return detect.leak_path_findings(_paths(spark, sf_dir)).filter(F.col("category") == "strategy_docs")


@query("leak_env_files", "D7", f"WITH {FILES_SQL} {ENV_SQL}", "corpus")
def leak_env_files(spark, sf_dir):
    return detect.leak_path_findings(_paths(spark, sf_dir)).filter(F.col("category") == "credentials")


@query("leak_interview_artifacts", "D8", f"WITH {FILES_SQL} {INTERVIEW_SQL}", "corpus")
def leak_interview_artifacts(spark, sf_dir):
    return detect.interview_findings(_paths(spark, sf_dir))


@query("leak_findings", "U1 E9 UDF2", f"WITH {LEAK_CTES} SELECT {COLS} FROM leaks", "corpus")
def leak_findings(spark, sf_dir):
    return _leaks(spark, sf_dir)


@query("leak_report", "E9 A5", f"WITH {LEAK_CTES} {SCORE_SQL.format('leaks')}", "corpus")
def leak_report(spark, sf_dir):
    return detect.scored_projects(view(spark, sf_dir, "corpus", "project"), _leaks(spark, sf_dir))


@query("rule_pack_findings", "P12 UDF4", """WITH l AS (SELECT project, path, u.line AS text, CAST(u.n AS INT) AS line FROM corpus, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)),
h AS (SELECT project, path, line, min(ord) AS ord FROM l, rule_pack WHERE regexp_matches(l.text, pattern) GROUP BY ALL)
SELECT project, path, line, ord, category, severity, message FROM h JOIN rule_pack USING (ord)""", "corpus rule_pack")
def rule_pack_findings(spark, sf_dir):
    return rule_packs.pack_findings(view(spark, sf_dir, "corpus", "project", "path", "text"), view(spark, sf_dir, "rule_pack"))


@query("debt_markers", "D9 P11 P12", f"WITH {FILES_SQL}, {LINES_SQL} {MARKER_SQL}", "corpus")
def debt_markers(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [detect.debt_packs()["markers"]])



@query("debt_marker_lines", "D9", f"WITH {FILES_SQL}, {LINES_SQL} {MARKER_SQL.replace('substr(bare, 1, 120)', 'bare')}", "corpus")
def debt_marker_lines(spark, sf_dir):
    """Debt markers with their whole lines."""
    return detect.text_findings(_corpus(spark, sf_dir), [detect.marker_pack(F.col("_lang").isNotNull(), None)])


@query("debt_quoted_secrets", "D10 P12", f"WITH {FILES_SQL}, {LINES_SQL} {SECRET_SQL}", "corpus")
def debt_quoted_secrets(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [detect.debt_packs()["secrets"]])



@query("debt_error_handling", "D11 D12", f"WITH {FILES_SQL}, {LINES_SQL}, {STARTS_SQL} ({BARE_SQL}) UNION ALL ({BROAD_SQL})", "corpus")
def debt_error_handling(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [], detect.error_handling_findings())



@query("debt_debug_output", "D13 D14", f"WITH {FILES_SQL}, {LINES_SQL}, {STARTS_SQL} ({PRINT_SQL}) UNION ALL ({CONSOLE_SQL})", "corpus")
def debt_debug_output(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [], detect.debug_output_findings())



@query("debt_long_files", "D15", f"WITH {FILES_SQL} {LONG_FILE_SQL}", "corpus")
def debt_long_files(spark, sf_dir):
    return detect.long_file_findings(_corpus(spark, sf_dir))


@query("debt_long_functions", "D16 W3", f"WITH {FILES_SQL}, {DEFS_SQL} {LONG_FN_SQL}", "corpus")
def debt_long_functions(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [], detect.long_function_findings())



@query("debt_deep_nesting", "D17 W8", f"WITH {FILES_SQL}, {LINES_SQL} {NEST_SQL}", "corpus")
def debt_deep_nesting(spark, sf_dir):
    return detect.text_findings(_corpus(spark, sf_dir), [], detect.deep_nesting_findings())



@query("project_hygiene", "D18 D19 D20 D21 U3", HYGIENE_SQL, "corpus")
def project_hygiene(spark, sf_dir):
    return detect.hygiene_findings(_corpus(spark, sf_dir), _paths(spark, sf_dir))


@query("debt_findings", "U1 E8", f"WITH {DEBT_CTES} SELECT {COLS} FROM debt", "corpus")
def debt_findings(spark, sf_dir):
    return _debt(spark, sf_dir)


@query("debt_report", "E8 A5 F17", f"WITH {DEBT_CTES}, s AS ({SCORE_SQL.format('debt')}) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM s", "corpus")
def debt_report(spark, sf_dir):
    from corpuslens.functions.scores import grade

    scores = detect.scored_projects(view(spark, sf_dir, "corpus", "project"), _debt(spark, sf_dir))
    return scores.withColumn("grade", grade(F.col("score"), 90, 80, 70, 50))


@query("finding_counts", "A4", f"""WITH {DEBT_CTES}
SELECT project, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS kind,
 coalesce(category, severity, 'all') AS name, count(*) AS n_findings FROM debt GROUP BY GROUPING SETS ((project, category), (project, severity), (project))""", "corpus")
def finding_counts(spark, sf_dir):
    return detect.finding_counts(_debt(spark, sf_dir))


@query("categories_by_count", "O3", f"""WITH {DEBT_CTES}, c AS (SELECT project, category, count(*) AS n_findings FROM debt GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY project ORDER BY n_findings DESC, category) AS rank FROM c""", "corpus")
def categories_by_count(spark, sf_dir):
    return detect.categories_by_count(_debt(spark, sf_dir))


@query("priority_items", "P13 O4 W6", f"""WITH {DEBT_CTES}, u AS (SELECT {COLS}, row_number() OVER (PARTITION BY project ORDER BY {KEY_SQL}, line NULLS FIRST, category, message) AS item,
 greatest(count(*) OVER (PARTITION BY project) - 10, 0) AS more FROM debt WHERE severity IN ('critical', 'high')) SELECT * FROM u WHERE item <= 10""", "corpus")
def priority_items(spark, sf_dir):
    return detect.priority_items(_debt(spark, sf_dir))


@query("fleet_leak_ranking", "P14 O2 U1 A5", f"""WITH {LEAK_CTES}, markers AS ({MARKER_SQL}), both_packs AS (SELECT * FROM leaks UNION ALL SELECT * FROM markers),
s AS ({SCORE_SQL.format('both_packs')}) SELECT * FROM s ORDER BY score, project""", "corpus")
def fleet_leak_ranking(spark, sf_dir):
    """Flagship: every line, leak and marker packs, scored, clean projects kept, worst first."""
    files = _corpus(spark, sf_dir)
    packs = [token_pack(), detect.debt_packs()["markers"]]
    found = detect.leak_findings(files, packs, _paths(spark, sf_dir))
    return detect.worst_first(detect.scored_projects(view(spark, sf_dir, "corpus", "project"), found))


@query("detector_registry", "UDF2", f"""WITH {LEAK_CTES.replace(f'({TOKEN_SQL}) UNION ALL ', '')}, {STARTS_SQL}, {DEFS_SQL}, debt AS ({DEBT_SQL})
SELECT 'leaks' AS detector, count(*) AS n_findings, count(DISTINCT project) AS n_projects FROM leaks UNION ALL
SELECT 'debt', count(*), count(DISTINCT project) FROM debt""", "corpus")
def detector_registry(spark, sf_dir):
    return detect.run_detectors(_corpus(spark, sf_dir)).groupBy("detector").agg(
        F.count("*").alias("n_findings"), F.count_distinct("project").alias("n_projects"))

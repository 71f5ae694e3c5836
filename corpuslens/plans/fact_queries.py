"""Registered queries: style votes and mined vocabulary."""

from __future__ import annotations

from corpuslens.functions import fixed
from corpuslens.operators import facts, style
from corpuslens.plans.detect_queries import LINES_SQL
from corpuslens.plans.inventory_queries import FILES_SQL, KEY_SQL, sql_list
from corpuslens.plans.registry import ORACLES, query
from corpuslens.sources.bindings import view


def _corpus(spark, sf_dir):
    return view(spark, sf_dir, "corpus")


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _n(*patterns: str) -> str:
    return " + ".join(f"len(regexp_extract_all(text, {_s(p.replace('(?md)', '(?m)').replace('(?d)', ''))}))" for p in patterns)


PY = "ext IN ('.py', '.pyi')"
JS = f"ext IN ({sql_list(fixed.JS_EXTS)})"
STYLE_SQL = f"""
WITH {FILES_SQL}, pc AS (SELECT project, lang, count(*) AS n, min({KEY_SQL}) AS k FROM files
  WHERE lang IS NOT NULL AND lang NOT IN ({sql_list(fixed.CONFIG_LANGUAGES)}) GROUP BY ALL),
prim AS (SELECT project, lang FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, k) AS r FROM pc) WHERE r = 1),
c AS (SELECT project, {PY} AS py, {JS} AS js, {_n(*style.SNAKE)} AS snake, {_n(*style.CAMEL)} AS camel,
 {_n(style.DEFS)} AS defs, {_n(*style.HINTS)} AS hints, {_n(style.GOOGLE_DOC)} AS google, {_n(style.NUMPY_DOC)} AS numpy,
 {_n(style.SPHINX_DOC)} AS sphinx, {_n(style.ABSOLUTE_IMPORT)} AS absolute, {_n(style.RELATIVE_IMPORT)} AS relative,
 {_n(*style.PATHLIB)} AS pathlib, {_n(style.OS_PATH)} AS ospath, {_n(style.TRAILING_COMMA)} AS comma, {_n(style.NO_TRAILING_COMMA)} AS no_comma,
 {_n(style.TRY_BLOCK)} AS tries, regexp_matches(text, {_s(style.CUSTOM_ERROR)}) AS custom FROM files WHERE lang IS NOT NULL),
a AS (SELECT c.project, any_value(lang) AS lang, count(*) AS n, count_if(py) AS n_py, count_if(js) AS n_js,
 sum(CASE WHEN lang IN ('Python', 'Rust') AND has_py THEN (CASE WHEN py THEN snake END) WHEN lang IN ('TypeScript', 'JavaScript') AND has_js THEN (CASE WHEN js THEN snake END) ELSE snake END) AS snake,
 sum(CASE WHEN lang IN ('Python', 'Rust') AND has_py THEN (CASE WHEN py THEN camel END) WHEN lang IN ('TypeScript', 'JavaScript') AND has_js THEN (CASE WHEN js THEN camel END) ELSE camel END) AS camel,
 {', '.join(f"coalesce(sum({x}) FILTER (py), 0) AS {x}" for x in ('defs', 'hints', 'google', 'numpy', 'sphinx', 'absolute', 'relative', 'pathlib', 'ospath'))},
 sum(comma) AS comma, sum(no_comma) AS no_comma, CAST(sum(tries) AS BIGINT) AS tries, bool_or(custom) AS custom
 FROM (SELECT c.*, lang, bool_or(py) OVER (PARTITION BY c.project) AS has_py, bool_or(js) OVER (PARTITION BY c.project) AS has_js FROM c LEFT JOIN prim USING (project)) c GROUP BY c.project)
SELECT project, CASE WHEN snake > camel THEN 'snake_case' WHEN camel > snake THEN 'camelCase' ELSE 'mixed' END AS naming,
 CASE WHEN defs = 0 THEN 'n/a' WHEN hints / defs > 0.5 THEN 'present' WHEN hints / defs > 0.1 THEN 'partial' ELSE 'absent' END AS type_hints,
 CASE WHEN google > numpy AND google > sphinx THEN 'google' WHEN numpy > google AND numpy > sphinx THEN 'numpy' WHEN sphinx > google AND sphinx > numpy THEN 'sphinx' ELSE 'none' END AS docstrings,
 CASE WHEN n_py = 0 THEN 'n/a' WHEN absolute > relative * 2 THEN 'absolute' WHEN relative > absolute * 2 THEN 'relative' ELSE 'mixed' END AS imports,
 CASE WHEN n_py = 0 THEN 'n/a' WHEN pathlib > ospath THEN 'pathlib' WHEN ospath > pathlib THEN 'os.path' ELSE 'mixed' END AS path_api,
 CASE WHEN comma > no_comma THEN 'yes' WHEN no_comma > comma THEN 'no' ELSE 'mixed' END AS trailing_commas,
 tries AS try_count, custom AS custom_errors, least(1.0, n / 50) AS confidence FROM a"""


@query("style_votes", "A13 A15 A16 A17 A18 A21 A22 A23", STYLE_SQL, "corpus")
def style_votes(spark, sf_dir):
    return style.style_votes(_corpus(spark, sf_dir)).drop("quote_style")


@query("quote_style_votes", "A14")
def quote_style_votes(spark, sf_dir):
    return style.style_votes(_corpus(spark, sf_dir)).select("project", "quote_style")


@query("semicolon_votes", "A19", f"""
WITH {FILES_SQL}, {LINES_SQL}, s AS (SELECT project, regexp_replace(line, '\\s+$', '') AS s FROM lines WHERE {JS}),
k AS (SELECT project, count_if(s LIKE '%;') AS with_semi, count_if(NOT regexp_matches(s, '[;{{}}(),]$')) AS without_semi
 FROM s WHERE s <> '' AND NOT regexp_matches(s, '^(//|/\\*|\\*|import|export)') GROUP BY project)
SELECT p.project, coalesce(with_semi, 0) AS with_semi, coalesce(without_semi, 0) AS without_semi,
 CASE WHEN coalesce(with_semi, 0) > 2 * coalesce(without_semi, 0) THEN 'required' WHEN coalesce(without_semi, 0) > 2 * coalesce(with_semi, 0) THEN 'omitted' ELSE 'mixed' END AS semicolons
FROM (SELECT DISTINCT project FROM files WHERE {JS}) p LEFT JOIN k USING (project)""", "corpus")
def semicolon_votes(spark, sf_dir):
    return style.semicolon_votes(_corpus(spark, sf_dir))


@query("line_length_p95", "A20", f"""
WITH {FILES_SQL}, l AS (SELECT project, length(u.line) AS len FROM files f,
 unnest(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS u(line) WHERE lang IS NOT NULL),
r AS (SELECT project, len, row_number() OVER (PARTITION BY project ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM l)
SELECT project, len AS line_length_p95, n AS n_lines FROM r WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""", "corpus")
def line_length_p95(spark, sf_dir):
    return style.line_length_p95(_corpus(spark, sf_dir))


def _terms_sql(where: str, *lists: str, limit: int | None = None, also: str = "true", text: str = "files", ctes: str = "") -> str:
    unions = " UNION ".join(f"SELECT project, unnest({lst}) AS term FROM {text} WHERE {where}" for lst in lists)
    return (
        f"WITH {FILES_SQL}{ctes}, t AS ({unions}), r AS (SELECT project, term, row_number() OVER (PARTITION BY project ORDER BY term) AS position FROM (SELECT DISTINCT * FROM t) WHERE {also}) "
        f"SELECT * FROM r{'' if limit is None else f' WHERE position <= {limit}'}"
    )


def _x(p: str) -> str:
    return f"regexp_extract_all(text, {_s(p)}, 1)"


@query("class_names", "X10 W6", _terms_sql(
    f"ext IN ({sql_list(facts.CLASS_EXTS)})", f"list_filter({_x(facts.CLASS_NAME)}, lambda x: NOT starts_with(x, '_'))",
    _x(facts.STRUCT_NAME), also="length(term) > 2"), "corpus")
def class_names(spark, sf_dir):
    return facts.class_names(_corpus(spark, sf_dir))


@query("readme_terms", "X11 W6", _terms_sql(
    "true", f"list_filter({_x(facts.ACRONYM)}, lambda x: NOT list_contains([{sql_list(facts.COMMON_ACRONYMS)}], x))",
    f"list_transform({_x(facts.PHRASE)}, lambda x: regexp_replace(x, '\\s+', ' ', 'g'))", text="readme",
    ctes=", readme AS (SELECT project, regexp_replace(text, '[À-ÖØ-öø-ÿœŒ]', '_', 'g') AS text FROM files WHERE path = 'README.md')"), "corpus")
def readme_terms(spark, sf_dir):
    return facts.readme_terms(_corpus(spark, sf_dir))


@query("route_paths", "X12 W6", _terms_sql(f"ext IN ({sql_list(facts.ROUTE_EXTS)})", _x(facts.ROUTE)), "corpus")
def route_paths(spark, sf_dir):
    return facts.route_paths(_corpus(spark, sf_dir))


@query("constant_names", "X13 W6", f"""
WITH {FILES_SQL}, {LINES_SQL},
o AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(line, '^enum\\s+[\\p{{L}}\\p{{N}}_]+') THEN n END) OVER w, 0) AS opened,
 coalesce(max(CASE WHEN contains(line, '}}') AND NOT regexp_matches(line, '^enum\\s+[\\p{{L}}\\p{{N}}_]+') THEN n END) OVER (PARTITION BY project, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
 FROM lines WHERE ext IN ('.py', '.ts', '.rs') WINDOW w AS (PARTITION BY project, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT project, unnest(list_filter({_x(facts.CONSTANT)}, lambda x: x = upper(x) AND regexp_matches(x, '[A-Z]') AND length(x) > 2)) AS term FROM files WHERE ext IN ('.py', '.ts', '.rs')
 UNION SELECT project, unnest({_x(facts.ENUM_NAME)}) FROM files WHERE ext IN ('.py', '.ts', '.rs')
 UNION SELECT project, regexp_extract(line, '^\\s+([\\p{{L}}\\p{{N}}_]+)', 1) FROM o WHERE opened > closed AND opened > 0 AND NOT regexp_matches(line, '^enum\\s+[\\p{{L}}\\p{{N}}_]+') AND regexp_matches(regexp_extract(line, '^\\s+([\\p{{L}}\\p{{N}}_]+)', 1), '^[A-Z]')),
r AS (SELECT project, term, row_number() OVER (PARTITION BY project ORDER BY term) AS position FROM (SELECT DISTINCT * FROM t))
SELECT * FROM r""", "corpus")
def constant_names(spark, sf_dir):
    return facts.constant_names(_corpus(spark, sf_dir))


_MARK = [p.replace("(?d)", "") for p in facts.COMMENT_MARKERS]


@query("marker_comments", "X14", f"""
WITH {FILES_SQL}, m AS (""" + " UNION ALL ".join(
    f"SELECT project, path, {i} AS pass_no, unnest(range(1, len(k) + 1)) AS idx, unnest(k) AS kind, unnest(b) AS body FROM "
    f"(SELECT project, path, regexp_extract_all(text, {_s(p)}, 1) AS k, regexp_extract_all(text, {_s(p)}, 2) AS b FROM files WHERE lang IS NOT NULL)"
    for i, p in enumerate(_MARK)) + f"""),
r AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY {KEY_SQL}, pass_no, idx) AS position, kind, substr(trim(body, ' ' || chr(9)), 1, 100) AS body, path FROM m)
SELECT * FROM r""", "corpus")
def marker_comments(spark, sf_dir):
    return facts.marker_comments(_corpus(spark, sf_dir))


@query("whole_marker_comments", "X14", ORACLES["marker_comments"].replace("substr(trim(body, ' ' || chr(9)), 1, 100)", "trim(body, ' ' || chr(9))"))
def whole_marker_comments(spark, sf_dir):
    return facts.marker_comments(_corpus(spark, sf_dir), body_chars=None)

"""Registered queries: inventory of files and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.functions.text import last_segment, path_key
from corpuslens.operators import inventory as inv
from corpuslens.plans.registry import query
from corpuslens.sources.bindings import view


def sql_list(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def sql_values(rows) -> str:
    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, (int, float)):
            return str(x)
        return "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)


EXT_SQL = "lower(regexp_extract(path, '[^/](\\.[^/.]+)$', 1))"
LANGS_SQL = f"langs(ext, lang) AS (VALUES {sql_values(fixed.LANGUAGE_OF_EXT.items())})"
FILES_SQL = f"{LANGS_SQL}, files AS (SELECT c.*, {EXT_SQL} AS ext, l.lang FROM corpus c LEFT JOIN langs l ON l.ext = {EXT_SQL})"
KEY_SQL = "replace(path, '/', chr(1))"

IS_TEST_SQL = (
    "(list_contains(string_split(lower(path), '/'), 'test') OR list_contains(string_split(lower(path), '/'), 'tests') "
    "OR lower(path) LIKE '%\\_test.py' ESCAPE '\\' OR regexp_matches(lower(path), '(^|/)test_[^/]*$') "
    "OR lower(path) LIKE '%.test.ts' OR lower(path) LIKE '%.test.tsx' OR lower(path) LIKE '%.test.js' "
    "OR lower(path) LIKE '%.spec.ts' OR lower(path) LIKE '%.spec.js')"
)
EXCLUDED_SQL = (
    "(list_has_any(string_split(path, '/'), [" + sql_list(g for g in fixed.EXCLUDE_GLOBS if "*" not in g)
    + "]) OR regexp_matches(path, '\\.(egg-info|pyc|pyo)(/|$)'))"
)
NAME_SQL = "regexp_extract(path, '[^/]*$')"


@query("file_facts", "S1 S2 P1", f"""
WITH {FILES_SQL}
SELECT project, path, ext, lang, strlen(text) AS size_bytes, false AS is_binary,
  length(text) - length(replace(text, chr(10), '')) AS newline_count FROM files""", "corpus")
def file_facts(spark, sf_dir):
    return inv.with_file_facts(view(spark, sf_dir, "corpus")).drop("text")


@query("path_flags", "P2 P5 P6 P7 P8 P10 P16", f"""
WITH {FILES_SQL}
SELECT project, path, {EXCLUDED_SQL} AS excluded,
  regexp_matches(path, '^(src|lib|app|packages|pkg|cmd|internal)(/|$)') AS in_roots,
  coalesce(lang IS NOT NULL OR ext IN ({sql_list(fixed.LEAK_EXTRA_EXTS)}) OR starts_with({NAME_SQL}, '.env'), false) AS scannable,
  {IS_TEST_SQL} AS is_test,
  regexp_matches(lower(substr(text, 1, 500)), 'grep|gitleaks|opsec|secret\\.scan|bandit') AS scan_script,
  contains(path, '.example') OR contains(path, '.sample') AS is_sample,
  regexp_matches({NAME_SQL}, '^(.*\\.db|.*\\.db-(journal|shm|wal)|\\.coverage|\\.env|\\.envrc)$') AS tree_hidden
FROM files""", "corpus")
def path_flags(spark, sf_dir):
    from corpuslens.functions.text import glob_regex

    return view(spark, sf_dir, "corpus").select(
        "project", "path", inv.is_excluded().alias("excluded"), inv.under_roots().alias("in_roots"),
        inv.is_leak_scannable().alias("scannable"), inv.is_test_path().alias("is_test"),
        inv.is_scan_script().alias("scan_script"), inv.is_sample_path().alias("is_sample"),
        last_segment("path").rlike(glob_regex(fixed.TREE_HIDDEN_GLOBS, anywhere=False)).alias("tree_hidden"),
    )


@query("kept_files", "P2 P3", f"""
SELECT project, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM corpus
WHERE NOT {EXCLUDED_SQL} AND strlen(text) <= 500 * 1024 GROUP BY project""", "corpus")
def kept_files(spark, sf_dir):
    files = inv.drop_oversize(inv.drop_excluded(view(spark, sf_dir, "corpus")))
    return files.groupBy("project").agg(
        F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("first_files_in_walk_order", "P4 O1", """
SELECT project, path FROM (SELECT project, path,
  row_number() OVER (PARTITION BY project ORDER BY string_split(path, '/')) AS n FROM corpus) WHERE n <= 25""", "corpus")
def first_files_in_walk_order(spark, sf_dir):
    return inv.first_files(view(spark, sf_dir, "corpus", "project", "path").select("project", "path"), 25)


@query("files_in_walk_order", "P4 O1", """
SELECT project, path, CAST(row_number() OVER (PARTITION BY project ORDER BY string_split(path, '/')) AS INT) AS rank FROM corpus""", "corpus")
def files_in_walk_order(spark, sf_dir):
    return inv.files_in_walk_order(view(spark, sf_dir, "corpus", "project", "path"))


@query("files_by_path_parts", "O1", """
SELECT project, path, row_number() OVER (ORDER BY project, string_split(path, '/')) - 1 AS position FROM corpus""", "corpus")
def files_by_path_parts(spark, sf_dir):
    """Global order by path segments. ``orderBy`` range-partitions; the position comes from
    per-partition counts, not from one global window task."""
    from corpuslens.operators.ranking import global_position

    files = view(spark, sf_dir, "corpus", "project", "path").select("project", "path", path_key("path").alias("_key"))
    return global_position(files, ["project", "_key"], "position").drop("_key")


@query("language_counts", "A1", f"""
WITH {FILES_SQL} SELECT project, lang, count(*) AS n_files FROM files WHERE lang IS NOT NULL GROUP BY ALL""", "corpus")
def language_counts(spark, sf_dir):
    return inv.language_counts(view(spark, sf_dir, "corpus", "project", "path")).drop("first_key")


@query("primary_language", "A2", f"""
WITH {FILES_SQL}, c AS (SELECT project, lang, count(*) AS n, min({KEY_SQL}) AS k FROM files
  WHERE lang IS NOT NULL AND lang NOT IN ({sql_list(fixed.CONFIG_LANGUAGES)}) GROUP BY ALL)
SELECT project, lang AS primary_language FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, k) AS r FROM c) WHERE r = 1""", "corpus")
def primary_language(spark, sf_dir):
    return inv.primary_language(inv.language_counts(view(spark, sf_dir, "corpus", "project", "path")))


@query("top_languages", "O7 W6", f"""
WITH {FILES_SQL}, c AS (SELECT project, lang, count(*) AS n_files, min({KEY_SQL}) AS k FROM files WHERE lang IS NOT NULL GROUP BY ALL)
SELECT project, rank, lang, n_files FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n_files DESC, k) AS rank FROM c) WHERE rank <= 5""", "corpus")
def top_languages(spark, sf_dir):
    return inv.top_languages(inv.language_counts(view(spark, sf_dir, "corpus", "project", "path")))


@query("project_totals", "A3", f"""
WITH {FILES_SQL}
SELECT project, count(*) AS total_files, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS total_lines,
  count(DISTINCT lang) AS n_languages, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM files GROUP BY project""", "corpus")
def project_totals(spark, sf_dir):
    return inv.project_totals(view(spark, sf_dir, "corpus"))


DIRS_SQL = """dirs AS (SELECT DISTINCT project, array_to_string(parts[1:n], '/') AS path FROM
  (SELECT project, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS n FROM corpus))"""


@query("known_paths", "U2", f"""
WITH {DIRS_SQL} SELECT project, path FROM dirs UNION SELECT project, path FROM corpus""", "corpus")
def known_paths(spark, sf_dir):
    return inv.known_paths(view(spark, sf_dir, "corpus", "project", "path"))


@query("directory_tree", "X21 P16", f"""
WITH {DIRS_SQL},
second AS (SELECT project, split_part(path, '/', 1) AS name, split_part(path, '/', 2) AS child FROM dirs WHERE len(string_split(path, '/')) = 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY child) AS r, count(*) OVER (PARTITION BY project, name) AS n FROM second),
listed AS (SELECT project, name, string_agg(child, ',' ORDER BY child) AS children, max(n) AS n FROM ranked WHERE r <= 10 GROUP BY ALL)
SELECT d.project, d.path AS name, 'dir' AS kind, coalesce(children, '') AS children, greatest(coalesce(n, 0) - 10, 0) AS more
FROM dirs d LEFT JOIN listed l ON l.project = d.project AND l.name = d.path WHERE NOT contains(d.path, '/')
UNION ALL SELECT DISTINCT project, path, 'file', '', 0 FROM corpus WHERE NOT contains(path, '/')
AND NOT regexp_matches(path, '^(.*\\.db|.*\\.db-(journal|shm|wal)|\\.coverage|\\.env|\\.envrc)$')""", "corpus")
def directory_tree(spark, sf_dir):
    return inv.directory_tree(view(spark, sf_dir, "corpus", "project", "path"))


@query("component_list", "X22", f"""
WITH {DIRS_SQL}, entries AS (
  SELECT project, path, 0 AS f FROM dirs UNION ALL SELECT DISTINCT project, path, 1 FROM corpus),
keyed AS (SELECT *, string_split(path, '/') AS parts FROM entries WHERE NOT regexp_matches(path, '(^|/)(\\.[^/]*|node_modules)(/|$)')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY
  list_concat(list_transform(parts[1:len(parts) - 1], lambda s: '0' || s), [f || parts[len(parts)]])) AS entry_no
  FROM keyed WHERE len(parts) <= 4)
SELECT project, entry_no, len(parts) - 1 AS depth, parts[len(parts)] || (CASE f WHEN 0 THEN '/' ELSE '' END) AS entry FROM ranked WHERE entry_no <= 100""", "corpus")
def component_list(spark, sf_dir):
    return inv.component_list(view(spark, sf_dir, "corpus", "project", "path"))


@query("project_skills", "X23", """
SELECT DISTINCT project, replace(replace(replace(path, '.claude/', ''), '/SKILL.md', ''), '.md', '') AS skill
FROM corpus WHERE starts_with(path, '.claude/commands/') OR starts_with(path, '.claude/agents/') OR starts_with(path, '.claude/skills/')""", "corpus")
def project_skills(spark, sf_dir):
    return inv.project_skills(view(spark, sf_dir, "corpus", "project", "path"))


CHECKLIST_SQL = "checklist AS (" + " UNION ALL ".join(
    f"SELECT project, '{n}' AS name, '{lb}' AS label, '{w}' AS weight, bool_or(regexp_matches(path, '{rx}')) AS found FROM corpus GROUP BY project"
    for n, lb, w, rx in fixed.STANDARD_CHECKS) + ")"


@query("standards_checklist", "D22", f"WITH {CHECKLIST_SQL} SELECT * FROM checklist", "corpus")
def standards_checklist(spark, sf_dir):
    return inv.standards_checklist(view(spark, sf_dir, "corpus", "project", "path"))


@query("standards_score", "A9", f"""
WITH {CHECKLIST_SQL} SELECT project, count_if(found) AS passed, count(*) AS total,
  CAST(round_even(100.0 * count_if(found) / count(*), 0) AS INT) AS score FROM checklist GROUP BY project""", "corpus")
def standards_score(spark, sf_dir):
    return inv.standards_score(inv.standards_checklist(view(spark, sf_dir, "corpus", "project", "path")))

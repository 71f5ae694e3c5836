"""Registered queries: document audit, claim verification, fleet report."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.operators import audit, claims
from corpuslens.operators import manifests as man
from corpuslens.operators import stack
from corpuslens.plans.inventory_queries import sql_list, sql_values
from corpuslens.plans.registry import query
from corpuslens.plans.stack_queries import ALL_DEPS_SQL, MAN_SQL, TOOLS_SQL, _section
from corpuslens.session import cut_lineage
from corpuslens.sources.bindings import table, view

LINES = "(length(text) - length(replace(text, chr(10), '')) + (CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END))"
FENCES = "CAST((length(text) - length(replace(text, repeat(chr(96), 3), ''))) / 3 AS INT)"
OUT = "project, path, severity, category, message, suggestion"


def _s(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _ctx(spark, sf_dir):
    return view(spark, sf_dir, "contexts")


def _corpus(spark, sf_dir):
    return view(spark, sf_dir, "corpus")


COVERAGE_SQL = f"""SELECT project, path, severity, 'coverage' AS category, 'Missing "' || name || '" section' AS message, 'Add a ## ' || name || ' section with relevant content' AS suggestion
FROM contexts, (VALUES {sql_values(fixed.REQUIRED_SECTIONS)}) r(name, severity) WHERE NOT contains(text, '## ' || name) AND NOT contains(lower(text), lower(name))"""
ANTI_SQL = f"""SELECT project, path, 'warning' AS severity, 'anti_pattern' AS category, 'CLAUDE.md is ' || {LINES} || ' lines — too long, agents lose context' AS message, 'Trim to under 300 lines, focus on essentials' AS suggestion FROM contexts WHERE {LINES} > 500
UNION ALL SELECT project, path, 'warning', 'anti_pattern', 'CLAUDE.md is only ' || {LINES} || ' lines — too short for useful context', 'Add more sections: overview, commands, coding standards' FROM contexts WHERE {LINES} < 20
UNION ALL SELECT project, path, 'warning', 'anti_pattern', 'Contains TODO/FIXME items (stale planning artifacts)', 'Resolve or remove TODO items from CLAUDE.md' FROM contexts WHERE regexp_matches(text, '\\bTODO\\b|\\bFIXME\\b')
UNION ALL SELECT project, path, 'warning', 'anti_pattern', 'Contains conversation fragments (copy-paste from AI chat)', 'Use declarative style, not conversational prompts' FROM contexts WHERE {' OR '.join(f"contains(lower(text), {_s(m)})" for m in fixed.CHAT_MARKERS)}
UNION ALL SELECT project, path, 'info', 'anti_pattern', 'Uses first-person language instead of declarative style', 'Use declarative: "Use pytest" instead of "We use pytest"' FROM contexts WHERE regexp_matches(text, {_s(fixed.FIRST_PERSON)})
UNION ALL SELECT project, path, 'info', 'anti_pattern', 'Contains unclosed code block (odd number of ``` markers)', 'Close all code blocks with matching ```' FROM contexts WHERE {FENCES} % 2 = 1"""
SPECIFIC_SQL = f"""SELECT project, path, 'warning' AS severity, 'specificity' AS category, 'Contains vague phrase: "' || p || '"' AS message, 'Replace with specific, actionable instructions' AS suggestion
FROM contexts, (VALUES {sql_values([(p,) for p in fixed.VAGUE_PHRASES])}) v(p) WHERE contains(lower(text), p)
UNION ALL SELECT project, path, 'info', 'specificity', 'Anti-patterns section lacks code examples', 'Add inline code or code blocks showing what NOT to do' FROM contexts
 WHERE regexp_matches(text, '## Anti-[Pp]atterns') AND NOT contains(split_part(substr(text, strpos(lower(text), '## anti-pattern')), chr(10) || '## ', 1), chr(96))
UNION ALL SELECT project, path, 'info', 'specificity', 'Commands section lacks actual command strings', 'Add code blocks with runnable commands' FROM contexts
 WHERE contains(text, '## Common Commands') AND NOT contains(split_part(substr(text, strpos(lower(text), '## common command')), chr(10) || '## ', 1), repeat(chr(96), 3))"""
ACCURACY_SQL = f"""SELECT c.project, path, 'error' AS severity, 'accuracy' AS category, 'Says "greenfield" but project has ' || n || ' source files' AS message, 'Update the project phase description' AS suggestion
FROM contexts c JOIN (SELECT project, count(*) AS n FROM corpus GROUP BY project) s USING (project) WHERE contains(lower(text), 'greenfield') AND n > 50
UNION ALL SELECT c.project, path, 'error', 'accuracy', 'Lists "' || w || '" but it was not detected in dependencies', 'Remove ' || w || ' reference or add it to dependencies'
FROM contexts c, (VALUES {sql_values([(w,) for w in fixed.AUDITED_FRAMEWORKS])}) v(w) WHERE contains(lower(text), w)
 AND NOT EXISTS (SELECT 1 FROM tools t WHERE t.project = c.project AND t.kind = 'framework' AND t.tool = w)"""
REFS_SQL = f"""refs AS (SELECT project, path, n - 1 AS ref_no, ref, rtrim(ref, '/') AS target FROM contexts, unnest(regexp_extract_all(text, {_s(fixed.PATH_REFERENCE)}, 1)) WITH ORDINALITY AS u(ref, n)
WHERE contains(ref, '/') AND NOT starts_with(ref, '/') AND NOT regexp_matches(ref, '^(pip|npm|cargo|make|git)') AND (contains(regexp_extract(rtrim(ref, '/'), '[^/]*$'), '.') OR ref LIKE '%/'))"""
STALE_SQL = """SELECT project, path, 'warning' AS severity, 'freshness' AS category, 'References path `' || ref || '` which doesn''t exist in the project' AS message, 'Update or remove stale file references' AS suggestion
FROM refs r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project = r.project AND k.path = r.target)"""
AUDIT_CTES = f"{TOOLS_SQL}, {REFS_SQL}, audit AS (({COVERAGE_SQL}) UNION ALL ({ANTI_SQL}) UNION ALL ({SPECIFIC_SQL}) UNION ALL ({ACCURACY_SQL}) UNION ALL ({STALE_SQL}))"


@query("missing_sections", "C1", COVERAGE_SQL, "contexts")
def missing_sections(spark, sf_dir):
    return audit.text_check_findings(_ctx(spark, sf_dir), audit.coverage_checks())


@query("document_anti_patterns", "C4 C5 C6 C7 C8", ANTI_SQL, "contexts")
def document_anti_patterns(spark, sf_dir):
    return audit.text_check_findings(_ctx(spark, sf_dir), audit.anti_pattern_checks())


@query("document_specificity", "C9 C10 C11", SPECIFIC_SQL, "contexts")
def document_specificity(spark, sf_dir):
    return audit.text_check_findings(_ctx(spark, sf_dir), audit.specificity_checks())


@query("document_accuracy", "C2 C3 J7", f"WITH {TOOLS_SQL} {ACCURACY_SQL}", "corpus contexts")
def document_accuracy(spark, sf_dir):
    names = view(spark, sf_dir, "corpus", "project", "path")
    return audit.accuracy_findings(_ctx(spark, sf_dir), names, stack.detected_tools(_corpus(spark, sf_dir)))


@query("path_references", "X18", f"WITH {REFS_SQL} SELECT * FROM refs", "contexts")
def path_references(spark, sf_dir):
    return audit.path_references(_ctx(spark, sf_dir))


@query("stale_references", "C12 J4 U2", f"WITH {TOOLS_SQL}, {REFS_SQL} {STALE_SQL}", "corpus contexts")
def stale_references(spark, sf_dir):
    return audit.stale_reference_findings(_ctx(spark, sf_dir), view(spark, sf_dir, "corpus", "project", "path"))


def _facts(spark, sf_dir):
    """(facts of documents, facts of files): each text is read once, all checks run on what is written."""
    return (cut_lineage(claims.document_facts(_ctx(spark, sf_dir)), "document-facts"),
            cut_lineage(stack.file_facts(_corpus(spark, sf_dir)), "file-facts"))


def _audit(docs, files):
    return audit.audit_findings(docs, files, stack.detected_tools(files))


@query("audit_findings", "U1 E2", f"WITH {AUDIT_CTES} SELECT {OUT} FROM audit", "corpus contexts")
def audit_findings(spark, sf_dir):
    return _audit(*_facts(spark, sf_dir))


_PRESENT = " + ".join(f"CAST(contains(text, '## {n}') AS INT)" for n, _ in fixed.REQUIRED_SECTIONS)
_MISSING = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '## {n}') THEN '' ELSE '{n}' END" for n, _ in fixed.REQUIRED_SECTIONS) + "], lambda x: x <> ''), ', ')"
_CRIT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '## {n}') THEN '' ELSE '{n}' END" for n, s in fixed.REQUIRED_SECTIONS if s == "error") + "], lambda x: x <> ''), ', ')"
REPORT_SQL = f"""report AS (SELECT c.project, c.path, greatest(0, least(100, 100 - 15 * coalesce(e, 0) - 5 * coalesce(w, 0) - coalesce(i, 0) + CAST(floor(({_PRESENT}) / 8 * 20) AS INT)))::INT AS score,
 coalesce(e, 0) AS n_error, coalesce(w, 0) AS n_warning, coalesce(i, 0) AS n_info, {_MISSING} AS missing_sections,
 coalesce(nullif(concat_ws(' | ', CASE WHEN {_CRIT} <> '' THEN 'Add missing critical sections: ' || {_CRIT} END, CASE WHEN acc > 0 THEN 'Fix accuracy issues — CLAUDE.md doesn''t match actual codebase' END,
  CASE WHEN n_anti > 0 THEN 'Clean up CLAUDE.md anti-patterns (TODOs, conversation fragments, etc.)' END, CASE WHEN vague > 0 THEN 'Replace vague instructions with specific, actionable guidance' END), ''), 'CLAUDE.md is in good shape!') AS recommendations
FROM contexts c LEFT JOIN (SELECT project, path, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w, count_if(severity = 'info') AS i,
 count_if(severity = 'error' AND category = 'accuracy') AS acc, count_if(category = 'anti_pattern') AS n_anti, count_if(category = 'specificity') AS vague FROM audit GROUP BY ALL) f ON f.project = c.project AND f.path = c.path)"""


@query("audit_report", "E2 A6 C16 P15", f"WITH {AUDIT_CTES}, {REPORT_SQL} SELECT *, score < 70 AS below_gate FROM report", "corpus contexts")
def audit_report(spark, sf_dir):
    docs, files = _facts(spark, sf_dir)
    return audit.audit_report(docs, _audit(docs, files), gate=70)


CLAIMS_SQL = f"""fclaims AS (SELECT DISTINCT project, path, unnest(regexp_extract_all(text, {_s(claims.claimed_path_pattern())}, 1)) AS claim FROM contexts)"""
VCLAIM_SQL = f"vclaims AS (SELECT project, path, nullif(regexp_extract(text, {_s(fixed.CLAIMED_VERSION)}, 1), '') AS claim FROM contexts)"
ACTUAL_SQL = f"actual AS (SELECT project, coalesce(nullif(regexp_extract({_section('[project]')}, '\\nversion = \"([^\"]+)\"', 1), ''), json_extract_string(package, '$.version')) AS actual FROM man)"
DCLAIM_SQL = f"""dclaims AS (SELECT DISTINCT project, path, regexp_replace(d, '\\[.*?\\]', '', 'g') AS claim FROM (SELECT project, path, lower(unnest(regexp_extract_all(
 split_part(substr(chr(10) || text, strpos(chr(10) || text, chr(10) || '## Dependencies') + 15), chr(10) || '## ', 1), {_s(fixed.CLAIMED_DEP)}, 1))) AS d FROM contexts WHERE contains(text, '## Dependencies')) WHERE d NOT IN ({sql_list(fixed.NOT_DEPS)}) AND NOT contains(d, '.'))"""
CHECKS_SQL = f"""{MAN_SQL}, {ALL_DEPS_SQL}, {TOOLS_SQL}, {CLAIMS_SQL}, {VCLAIM_SQL}, {ACTUAL_SQL}, {DCLAIM_SQL},
checks AS (SELECT project, path, 'missing_file' AS kind, claim, CAST(NULL AS VARCHAR) AS actual, EXISTS (SELECT 1 FROM known k WHERE k.project = c.project AND k.path = c.claim) AS passed FROM fclaims c
UNION ALL SELECT v.project, path, 'version_mismatch', claim, actual, claim = actual FROM vclaims v JOIN actual a USING (project) WHERE claim IS NOT NULL AND actual IS NOT NULL
UNION ALL SELECT project, path, 'unknown_dep', claim, NULL, EXISTS (SELECT 1 FROM alldeps a WHERE a.project = d.project AND a.name = d.claim) FROM dclaims d WHERE project IN (SELECT project FROM alldeps))"""


def _checks(docs, files):
    rows = man.manifest_rows(files)
    return claims.claim_checks(docs, files, rows, man.all_dependency_names(rows))


@query("claimed_files", "X15", f"WITH {CLAIMS_SQL} SELECT * FROM fclaims", "contexts")
def claimed_files(spark, sf_dir):
    return claims.claimed_files(_ctx(spark, sf_dir))


@query("claimed_versions", "X16", f"WITH {VCLAIM_SQL} SELECT * FROM vclaims", "contexts")
def claimed_versions(spark, sf_dir):
    return _ctx(spark, sf_dir).select("project", "path", claims.claimed_version().alias("claim"))


@query("claimed_dependencies", "X17", f"WITH {DCLAIM_SQL} SELECT * FROM dclaims", "contexts")
def claimed_dependencies(spark, sf_dir):
    return claims.claimed_dependencies(_ctx(spark, sf_dir))


@query("missing_claimed_files", "C13 J3", f"WITH {CHECKS_SQL} SELECT project, path, claim FROM checks WHERE kind = 'missing_file' AND NOT passed", "corpus contexts")
def missing_claimed_files(spark, sf_dir):
    return claims.missing_files(_ctx(spark, sf_dir), view(spark, sf_dir, "corpus", "project", "path"))


@query("version_mismatches", "C14 J5", f"WITH {CHECKS_SQL} SELECT project, path, claim, actual FROM checks WHERE kind = 'version_mismatch' AND NOT passed", "corpus contexts")
def version_mismatches(spark, sf_dir):
    return claims.version_mismatches(_ctx(spark, sf_dir), man.manifest_rows(_corpus(spark, sf_dir)))


@query("unknown_dependencies", "C15 J6", f"WITH {CHECKS_SQL} SELECT project, path, claim FROM checks WHERE kind = 'unknown_dep' AND NOT passed", "corpus contexts")
def unknown_dependencies(spark, sf_dir):
    declared = man.all_dependency_names(man.manifest_rows(_corpus(spark, sf_dir)))
    return claims.unknown_dependencies(_ctx(spark, sf_dir), declared)


@query("claim_findings", "E3 C13 C14 C15", f"""WITH {CHECKS_SQL} SELECT project, path, CASE kind WHEN 'version_mismatch' THEN 'error' ELSE 'warning' END AS severity, kind AS category, claim,
 CASE kind WHEN 'missing_file' THEN 'Claimed file not found: ' || claim WHEN 'unknown_dep' THEN 'Dependency ''' || claim || ''' not in pyproject/package.json' ELSE 'CLAUDE.md says v' || claim || ', project is v' || actual END AS message,
 CASE kind WHEN 'missing_file' THEN 'Remove reference or update path (' || claim || ')' WHEN 'unknown_dep' THEN 'Remove ''' || claim || ''' from Dependencies or add to manifest' ELSE 'Update Current State → Version to ' || actual END AS suggestion
FROM checks WHERE NOT passed""", "corpus contexts")
def claim_findings(spark, sf_dir):
    return claims.claim_findings(_checks(*_facts(spark, sf_dir)))


REALITY_SQL = """reality AS (SELECT c.project, c.path, count(k.kind) AS checks_run, count_if(k.passed) AS checks_passed,
 CAST(CASE WHEN count(k.kind) > 0 THEN round_even(100.0 * count_if(k.passed) / count(k.kind), 0) ELSE 0 END AS INT) AS reality_score FROM contexts c LEFT JOIN checks k ON k.project = c.project AND k.path = c.path GROUP BY c.project, c.path)"""


@query("reality_report", "A7 E3", f"WITH {CHECKS_SQL}, {REALITY_SQL} SELECT * FROM reality", "corpus contexts")
def reality_report(spark, sf_dir):
    docs, files = _facts(spark, sf_dir)
    return claims.reality_report(docs, _checks(docs, files))


@query("fleet_report", "E4 O2 P14", f"""WITH {CHECKS_SQL.replace(TOOLS_SQL, TOOLS_SQL)}, {AUDIT_CTES.replace(TOOLS_SQL + ', ', '')}, {REPORT_SQL}, {REALITY_SQL}
SELECT project, path, score, missing_sections, reality_score FROM report JOIN reality USING (project, path) ORDER BY score, project, path""", "corpus contexts")
def fleet_report(spark, sf_dir):
    docs, files = _facts(spark, sf_dir)
    report = audit.audit_report(docs, _audit(docs, files))
    reality = claims.reality_report(docs, _checks(docs, files))
    joined = report.select("project", "path", "score", "missing_sections").join(
        reality.select("project", "path", "reality_score"), ["project", "path"])
    return joined.orderBy("score", "project", "path")


@query("fleet_summary", "A37", f"WITH {AUDIT_CTES}, {REPORT_SQL} SELECT count(*) AS documents, avg(score) AS mean_score, count_if(score < 70) AS below_70 FROM report", "corpus contexts")
def fleet_summary(spark, sf_dir):
    docs, files = _facts(spark, sf_dir)
    return audit.fleet_summary(audit.audit_report(docs, _audit(docs, files)))


_QP = " + ".join(f"CAST(contains(text, '## {h}') AS INT)" for h in fixed.QUALITY_HEADINGS)
_BOLD = "len(regexp_extract_all(text, '- \\*\\*[\\p{L}\\p{N}_]+'))"
QUALITY_SQL = f"q AS (SELECT project, path, text, {_QP} AS n_present, {LINES} AS line_count, {FENCES} AS fences, {_BOLD} AS bold_bullets FROM contexts)"
_DEPTH = "(CASE WHEN line_count > 150 THEN 20 WHEN line_count > 100 THEN 15 WHEN line_count > 50 THEN 10 ELSE 0 END)"
_SPEC = "(CASE WHEN bold_bullets > 5 THEN 10 WHEN bold_bullets > 2 THEN 5 ELSE 0 END)"


@query("quality_scores", "A10", f"""WITH {QUALITY_SQL} SELECT project, path, n_present, line_count, fences, bold_bullets,
 CAST(least(100, floor(n_present / 9 * 60) + {_DEPTH} + (CASE WHEN fences >= 2 THEN 10 WHEN fences = 1 THEN 5 ELSE 0 END) + {_SPEC}) AS INT) AS quality FROM q""", "contexts")
def quality_scores(spark, sf_dir):
    return audit.quality_scores(_ctx(spark, sf_dir))


@query("gap_actions", "C17 O6", f"""WITH {QUALITY_SQL}, a AS (
SELECT project, path, n AS i, 7 AS points, 'high' AS priority, 'Add `## ' || h || '` section' AS action, 'sections' AS category FROM q, (VALUES {sql_values([(i, h) for i, h in enumerate(fixed.QUALITY_HEADINGS)])}) v(n, h) WHERE NOT contains(text, '## ' || h)
UNION ALL SELECT project, path, 20, CASE WHEN line_count <= 50 THEN 20 WHEN line_count <= 100 THEN 10 ELSE 5 END, CASE WHEN line_count <= 50 THEN 'high' WHEN line_count <= 100 THEN 'medium' ELSE 'low' END,
 CASE WHEN line_count <= 50 THEN 'Expand content to 150+ lines for full depth score (+20 pts)' WHEN line_count <= 100 THEN 'Expand content to 150+ lines (+10 pts remaining)' ELSE 'Expand content past 150 lines (+5 pts remaining)' END, 'depth' FROM q WHERE line_count <= 150
UNION ALL SELECT project, path, 21, 10 - (CASE WHEN fences >= 2 THEN 5 ELSE 0 END), 'medium', 'Add code blocks (need ' || (2 - fences // 2) || ' more) for full code score', 'code_blocks' FROM q WHERE fences // 2 < 2
UNION ALL SELECT project, path, 22, 10 - {_SPEC}, 'medium', 'Add bold-label bullets (`- **Key**: value`) — need ' || (6 - bold_bullets) || ' more', 'specificity' FROM q WHERE bold_bullets <= 5)
SELECT project, path, row_number() OVER (PARTITION BY project, path ORDER BY points DESC, i) AS rank, points, priority, action, category FROM a""", "contexts")
def gap_actions(spark, sf_dir):
    return audit.gap_actions(_ctx(spark, sf_dir))


VULNS = ("SELECT 'src' || (s_suppkey % 20) AS project, (CASE s_nationkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' "
         "WHEN 2 THEN 'low' ELSE 'unknown' END) AS severity FROM supplier WHERE s_acctbal > 5000")


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def _pts(base: int, *rules: tuple[str, int]) -> str:
    return str(base) + "".join(f" + (CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in rules)


def _clamp(e: str) -> str:
    return f"CAST(greatest(0, least(100, {e})) AS INT)"


_HAS = lambda h: f"contains(text, '{h}')"
_GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END AS {0}_grade"
_NAMES = ("structure", "security", "ci", "deps", "testing", "overall")


@query("category_scores", "A11 A44 F17", f"""WITH v AS (SELECT project, count_if(severity IN ('critical', 'high')) AS crit, count_if(severity = 'medium') AS med, count(*) AS n FROM ({VULNS}) GROUP BY project),
t AS (SELECT c.project, c.path, c.text, coalesce(crit, 0) AS crit, coalesce(med, 0) AS med, coalesce(n, 0) AS n FROM contexts c LEFT JOIN v USING (project)),
s AS (SELECT project, path,
 {_clamp(_pts(40, (_HAS('## Architecture') + ' OR ' + _HAS('## Project'), 20), (f"contains(text, repeat(chr(96), 3)) AND ({_HAS('├')} OR {_HAS('└')} OR {_any('directory')})", 15), (_HAS('## Coding Standards') + ' OR ' + _HAS('## Code Style'), 15), (_HAS('## Anti-Patterns'), 10)))} AS structure,
 {_clamp(_pts(50, (_any('security'), 15), (_any('credential', 'secret', 'api key'), 10), (_any('validation', 'sanitiz'), 10), (_any('env'), 10)) + ' - 15 * crit - 5 * med')} AS security,
 {_clamp(_pts(30, (_HAS('## CI') + ' OR ' + _any('ci/cd', 'workflow'), 25), (_any('github actions', '.github/workflows'), 20), (_any('deploy'), 15), (_any('lint', 'format'), 10)))} AS ci,
 {_clamp(_pts(50, (_HAS('## Dependencies') + ' OR ' + _HAS('## Tech Stack'), 20), (_any('requirements', 'package.json', 'pyproject'), 15), ('n = 0', 15)) + ' - 20 * crit - 8 * med')} AS deps,
 {_clamp(_pts(30, (_any('test'), 20), (_any('pytest', 'jest', 'vitest'), 15), (_any('coverage'), 15), (_any('mock', 'fixture'), 10), (_any('e2e', 'integration'), 10)))} AS testing FROM t),
o AS (SELECT *, CAST(round_even(CAST(structure * 25 + security * 25 + ci * 15 + deps * 20 + testing * 15 AS DECIMAL(18, 2)) / 100, 0) AS INT) AS overall FROM s)
SELECT *, {', '.join(_GRADE.format(n) for n in _NAMES)} FROM o""", "contexts")
def category_scores(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return audit.category_scores(_ctx(spark, sf_dir), spark.sql(VULNS))


@query("hygiene_grades", "A12", f"WITH {AUDIT_CTES}, n AS (SELECT c.project, c.path, count(a.path) AS n_issues FROM contexts c LEFT JOIN audit a ON a.project = c.project AND a.path = c.path AND a.category IN ('freshness', 'anti_pattern') GROUP BY ALL) SELECT *, CASE WHEN n_issues = 0 THEN 'A' WHEN n_issues <= 2 THEN 'B' WHEN n_issues <= 5 THEN 'C' ELSE 'D' END AS grade FROM n", "corpus contexts")
def hygiene_grades(spark, sf_dir):
    contexts = _ctx(spark, sf_dir)
    names = view(spark, sf_dir, "corpus", "project", "path")
    issues = audit.text_check_findings(contexts, audit.anti_pattern_checks()).unionByName(
        audit.stale_reference_findings(contexts, names))
    counts = issues.groupBy("project", "path").agg(F.count("*").alias("n_issues"))
    rows = contexts.select("project", "path").join(counts, ["project", "path"], "left").fillna(0)
    return rows.withColumn("grade", audit.hygiene_grade(F.col("n_issues")))


@query("section_split", "X19", "SELECT project, path, n - 1 AS section_no, (CASE WHEN n = 1 THEN '' ELSE '## ' END) || part AS content, len(list_filter(string_split_regex((CASE WHEN n = 1 THEN '' ELSE '## ' END) || part, '\\s+'), lambda w: w <> '')) AS words FROM contexts, unnest(string_split(text, chr(10) || '## ')) WITH ORDINALITY AS u(part, n)", "contexts")
def section_split(spark, sf_dir):
    return audit.section_split(_ctx(spark, sf_dir))


@query("headed_sections", "X20", """WITH l AS (SELECT project, path, n, line, regexp_matches(line, '^##\\s+.+') AS head FROM contexts, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)),
g AS (SELECT *, count_if(head) OVER (PARTITION BY project, path ORDER BY n) AS h FROM l)
SELECT project, path, h - 1 AS heading_no, any_value(CASE WHEN head THEN regexp_extract(line, '^##\\s+(.+?)\\s*$', 1) END) AS title,
 length(regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY n), ''), '\\s', '', 'g')) AS body_chars FROM g WHERE h > 0 GROUP BY project, path, h""", "contexts")
def headed_sections(spark, sf_dir):
    sections = audit.headed_sections(_ctx(spark, sf_dir))
    return sections.select("project", "path", "heading_no", "title",
                           F.length(F.regexp_replace("body", r"\s", "")).alias("body_chars"))


NEW_VERSION = "SELECT project, path, replace(replace(text, '- **Language**: Python', '- **Language**: Rust'), 'Refs ', 'See ') || chr(10) || 'extra line' || chr(10) || 'extra line' AS text FROM {0}"


@query("line_difference", "U6 E7", f"""WITH newer AS ({NEW_VERSION.format('contexts')}),
o AS (SELECT project, path, line, count(*) AS n FROM contexts, unnest(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS u(line) GROUP BY ALL),
w AS (SELECT project, path, line, count(*) AS n FROM newer, unnest(string_split(text, chr(10))) AS u(line) GROUP BY ALL),
j AS (SELECT coalesce(o.project, w.project) AS project, coalesce(o.path, w.path) AS path, coalesce(o.line, w.line) AS line, coalesce(w.n, 0) - coalesce(o.n, 0) AS d FROM o FULL JOIN w ON o.project = w.project AND o.path = w.path AND o.line = w.line)
SELECT project, path, line, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change, abs(d) AS times FROM j WHERE d <> 0""", "contexts")
def line_difference(spark, sf_dir):
    old = _ctx(spark, sf_dir)
    old.createOrReplaceTempView("contexts_now")
    return audit.line_difference(old, spark.sql(NEW_VERSION.format("contexts_now")))

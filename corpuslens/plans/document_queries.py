"""Registered queries: composed documents, exports, reports, end-to-end records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.operators import audit, detect, documents, inventory, repo_health, stack
from corpuslens.operators import manifests as man
from corpuslens.plans.audit_queries import VULNS
from corpuslens.plans.inventory_queries import FILES_SQL, sql_values
from corpuslens.plans.detect_queries import LEAK_CTES, TOKEN_SQL
from corpuslens.plans.registry import ORACLES, query
from corpuslens.plans.service_queries import _as_of
from corpuslens.plans.stack_queries import INSTALLED, MAN_SQL, TOOLS_SQL, VERSION_SQL
from corpuslens.session import cut_lineage
from corpuslens.sources.bindings import table, view


def _corpus(spark, sf_dir):
    return view(spark, sf_dir, "corpus")


def _installed(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(INSTALLED)


@query("state_sections", "F20", f"""WITH {FILES_SQL}, {MAN_SQL},
t AS (SELECT project, count(*) AS n, count(DISTINCT lang) AS k, sum(length(text) - length(replace(text, chr(10), ''))) AS l FROM files GROUP BY project),
c AS (SELECT project, lang, count(*) AS n, min(replace(path, '/', chr(1))) AS f FROM files WHERE lang IS NOT NULL AND lang NOT IN ('HTML', 'CSS', 'SCSS', 'SASS', 'LESS', 'SQL', 'Shell', 'Markdown') GROUP BY ALL),
p AS (SELECT project, lang FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, f) AS r FROM c) WHERE r = 1),
v AS (SELECT project, {VERSION_SQL} AS version FROM man)
SELECT t.project, 'current_state' AS name, '## Current State' || chr(10) || chr(10) || coalesce('- **Version**: ' || version || chr(10), '') || '- **Language**: ' || coalesce(lang, 'Unknown') || chr(10)
 || '- **Files**: ' || n || ' across ' || k || ' languages' || chr(10) || '- **Lines**: ' || format('{{:,}}', CAST(l AS BIGINT)) || chr(10) AS content FROM t LEFT JOIN p USING (project) LEFT JOIN v USING (project)""", "corpus")
def state_sections(spark, sf_dir):
    files = _corpus(spark, sf_dir)
    rows = inventory.project_facts(files).join(man.project_metadata(man.manifest_rows(files)), "project", "left")
    return documents.state_sections(rows).drop("ord")


def _composed(spark, sf_dir):
    return documents.composed(documents.document_sections(_corpus(spark, sf_dir), _installed(spark, sf_dir)))


@query("composed_documents", "E1 F19 F20 A10")
def composed_documents(spark, sf_dir):
    """The generated document of every project with its quality estimate."""
    docs = cut_lineage(_composed(spark, sf_dir).withColumn("path", F.lit("CLAUDE.md")), "documents")
    return docs.join(audit.quality_scores(docs), ["project", "path"])


@query("assembled_sections", "F19", """WITH s AS (SELECT project, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') AS text, path FROM contexts)
SELECT project || ' ' || path AS project, regexp_replace(text, '\\s+$', '') || chr(10) AS text FROM s""", "contexts")
def assembled_sections(spark, sf_dir):
    """Every document taken apart at its headings and put together again."""
    parts = audit.section_split(view(spark, sf_dir, "contexts"))
    rows = parts.select(F.concat_ws(" ", "project", "path").alias("project"), F.col("section_no").alias("ord"), "content")
    return documents.composed(rows)


@query("preset_sections", "F27", f"""WITH p AS (SELECT DISTINCT project FROM corpus) SELECT project, name FROM p, (VALUES {sql_values([(n,) for n in next(k for n, k, _ in fixed.PRESETS if n == 'minimal') if n in ('header',)] + [('git_conventions',), ('Workspace Structure',), ('Package Dependencies',)])}) v(name)""", "corpus")
def preset_sections(spark, sf_dir):
    projects = view(spark, sf_dir, "corpus", "project").distinct()
    rows = documents.header_sections(projects).unionByName(documents.git_sections(projects))
    return documents.preset_sections(rows, "monorepo").select("project", "name")


FRAMEWORK_PRESETS = (
    ("react", ["Small components", "Typed props"], ["No class state"], {"dev": "npm run dev"}),
    ("fastapi", ["Async handlers"], ["No blocking calls"], {"serve": "uvicorn app:app", "test": "pytest"}),
    ("rust", ["Errors as values"], [], {"build": "cargo build"}),
)


_PRESET_ROWS = [
    (f, "\n".join(f"- {x}" for x in s), "\n".join(f"- {x}" for x in a), "\n".join(f"# {k}\n{v}" for k, v in c.items()))
    for f, s, a, c in FRAMEWORK_PRESETS
]


@query("framework_preset_text", "F28", f"WITH {TOOLS_SQL}, pre(framework, standards, avoid, commands) AS (VALUES {sql_values(_PRESET_ROWS)}) SELECT project, framework, standards, avoid, commands FROM tools JOIN pre ON framework = tool WHERE kind = 'framework'", "corpus")
def framework_preset_text(spark, sf_dir):
    presets = spark.createDataFrame(
        [(f, f.title(), "", s, a, c) for f, s, a, c in FRAMEWORK_PRESETS], documents.PRESET_SCHEMA)
    return documents.framework_preset_text(stack.detected_tools(_corpus(spark, sf_dir)), presets)


def _q(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _export_sql() -> str:
    bare = "regexp_replace(text, '^# CLAUDE\\.md — [^\\n]+\\n*', '')"
    renamed = bare
    for old, new in documents.EXPORT_RENAMES:
        renamed = f"replace({renamed}, {_q(old)}, {_q(new)})"
    return " UNION ALL ".join(
        f"SELECT project, path, {_q(t)} AS target, {_q(f)} AS filename, {_q(title)} || project || chr(10) || chr(10) || {_q(pre)} || chr(10) || chr(10) || trim({renamed if ren else bare}, ' ' || chr(9) || chr(10)) || chr(10) AS content FROM contexts"
        for t, f, title, pre, ren in documents.EXPORT_TARGETS)


@query("exported_documents", "F24", _export_sql(), "contexts")
def exported_documents(spark, sf_dir):
    return documents.exported(view(spark, sf_dir, "contexts"))


def _lines_sql(*parts: str) -> str:
    """Lines joined by newlines, nulls left out."""
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_GAP_SQL = f"""WITH q AS ({ORACLES['quality_scores']}), a AS ({ORACLES['gap_actions']}),
t AS (SELECT project, path, string_agg(rank || '. **[' || (CASE priority WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MED' ELSE 'LOW' END) || ']** ' || action || ' (+' || points || ' pts)', chr(10) ORDER BY rank) AS actions,
 string_agg(CASE WHEN category = 'sections' THEN regexp_extract(action, '## (.*)`', 1) END, ', ' ORDER BY rank) AS absent FROM a GROUP BY ALL)
SELECT q.project, q.path, quality, {_lines_sql(
    "'# Fix Report: ' || q.project", "''", "'**Current Score**: ' || quality || '/100'", "'**Points to 100**: ' || (100 - quality)", "''",
    "'## Score Breakdown'", "''", "'| Category | Score | Max | Status |'", "'|----------|-------|-----|--------|'",
    "'| Section Coverage | ' || CAST(floor(n_present / 9 * 60) AS INT) || ' | 60 | ' || n_present || '/9 sections |'",
    "'| Content Depth | ' || (CASE WHEN line_count > 150 THEN 20 WHEN line_count > 100 THEN 15 WHEN line_count > 50 THEN 10 ELSE 0 END) || ' | 20 | ' || line_count || ' lines |'",
    "'| Code Blocks | ' || (CASE WHEN fences // 2 >= 2 THEN 10 WHEN fences // 2 >= 1 THEN 5 ELSE 0 END) || ' | 10 | ' || (fences // 2) || ' blocks |'",
    "'| Specificity | ' || (CASE WHEN bold_bullets > 5 THEN 10 WHEN bold_bullets > 2 THEN 5 ELSE 0 END) || ' | 10 | ' || bold_bullets || ' bold bullets |'", "''",
    "'## Priority Actions' || chr(10) || chr(10) || actions || chr(10)", "'Missing sections: ' || absent || chr(10)")} AS report FROM q LEFT JOIN t USING (project, path)"""


@query("gap_reports", "F25", _GAP_SQL)
def gap_reports(spark, sf_dir):
    return documents.gap_reports(view(spark, sf_dir, "contexts"))


_DEBT_TEXT_SQL = f"""WITH r AS ({ORACLES['debt_report']}), c AS ({ORACLES['categories_by_count']}), p AS ({ORACLES['priority_items']}),
ct AS (SELECT project, string_agg('- **' || array_to_string(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || '**: ' || n_findings || ' issues', chr(10) ORDER BY rank) AS cats FROM c GROUP BY project),
pt AS (SELECT project, string_agg('- [' || upper(severity) || '] `' || path || coalesce(':' || line, '') || '` — ' || message, chr(10) ORDER BY item) AS items, max(more) AS more FROM p GROUP BY project)
SELECT project, {_lines_sql("'## Technical Debt'", "''", "'**Debt Score**: ' || score || '/100'", "'**Total Signals**: ' || n_findings", "''", "'### Categories'", "cats", "''",
    "'### Priority Items' || chr(10) || items || (CASE WHEN more > 0 THEN chr(10) || '- ... and ' || more || ' more' ELSE '' END) || chr(10)")} AS content
FROM r JOIN ct USING (project) LEFT JOIN pt USING (project) WHERE n_findings > 0"""


@query("debt_report_sections", "F21 E8", _DEBT_TEXT_SQL)
def debt_report_sections(spark, sf_dir):
    files, names = _corpus(spark, sf_dir), view(spark, sf_dir, "corpus", "project", "path")
    findings = cut_lineage(detect.debt_findings(files, names), "debt")
    return documents.debt_report_sections(names, findings)


_LEAK_TEXT_SQL = f"""WITH {LEAK_CTES.replace(f'({TOKEN_SQL}) UNION ALL ', '')},
n AS (SELECT *, row_number() OVER (PARTITION BY project, severity ORDER BY path, line NULLS FIRST, message) AS r, path || coalesce(':' || line, '') AS place FROM leaks WHERE severity IN ('critical', 'high'))
SELECT project, severity, (r - 1) // 100 + 1 AS page,
 CASE WHEN min(r) > 1 THEN '' WHEN severity = 'critical' THEN '### Critical Issues' || chr(10) || chr(10) ELSE '### High Priority' || chr(10) || chr(10) END ||
 string_agg(CASE severity WHEN 'critical' THEN '- **' || message || '** (`' || place || '`)' ELSE '- ' || message || ' (`' || place || '`)' END, chr(10) ORDER BY r) AS content
FROM n GROUP BY project, severity, (r - 1) // 100"""


@query("leak_report_sections", "F21 E9", _LEAK_TEXT_SQL, "corpus")
def leak_report_sections(spark, sf_dir):
    names = view(spark, sf_dir, "corpus", "project", "path")
    findings = cut_lineage(detect.leak_findings(_corpus(spark, sf_dir), names=names), "leaks")
    return documents.leak_report_pages(findings)


_HEALTH_TEXT_SQL = f"""WITH h AS ({ORACLES['health_report']}), w AS ({ORACLES['workflow_state']}), l AS ({ORACLES['release_state']})
SELECT h.project, {_lines_sql("'## GitHub Health'", "''", "'**Health Score**: ' || health || '/100'", "'**Repository**: ' || h.project", "''",
    "CASE WHEN dependency_alerts + code_alerts > 0 THEN '### Security Alerts' || chr(10) || concat_ws(chr(10), CASE WHEN dependency_alerts > 0 THEN '- **Dependabot**: ' || dependency_alerts || ' open alerts' END, CASE WHEN code_alerts > 0 THEN '- **Code Scanning**: ' || code_alerts || ' open alerts' END) || chr(10) END",
    "'### Activity'", "'- **Open Issues**: ' || open_issues", "CASE WHEN stale_90d > 0 THEN '  - Stale (>90 days): ' || stale_90d END", "'- **Open PRs**: ' || open_prs",
    "CASE WHEN draft_prs > 0 THEN '  - Draft: ' || draft_prs END", "CASE WHEN stale_prs > 0 THEN '  - Stale (>30 days): ' || stale_prs END", "''",
    "CASE WHEN failing <> '' THEN '### CI Status' || chr(10) || '- **FAILING**: ' || replace(failing, ',', chr(10) || '- **FAILING**: ') || chr(10) END",
    "CASE WHEN NOT protected THEN '**Warning**: Default branch has no branch protection rules.' || chr(10) END", "'**Latest Release**: ' || latest || chr(10)")} AS content
FROM h LEFT JOIN w USING (project) LEFT JOIN l USING (project)"""


@query("health_sections", "F21 E10", _HEALTH_TEXT_SQL)
def health_sections(spark, sf_dir):
    t = {n: view(spark, sf_dir, n) for n in ("repos", "issues", "pull_requests", "workflow_runs", "alerts", "releases")}
    health = repo_health.health_report(t["repos"], t["issues"], t["pull_requests"], t["workflow_runs"], t["alerts"], _as_of())
    return documents.health_sections(health, repo_health.workflow_state(t["workflow_runs"]), repo_health.release_state(t["releases"]))


@query("regenerated_difference", "E7 U6")
def regenerated_difference(spark, sf_dir):
    """Lines by which the generated document differs from the project's first own document."""
    new = _composed(spark, sf_dir)
    old = view(spark, sf_dir, "contexts").groupBy("project").agg(F.min_by("text", "path").alias("text"))
    return audit.line_difference(old, new, ["project"])


_DEEP_SQL = f"""WITH t AS ({ORACLES['project_totals']}), d AS ({ORACLES['versioned_dependencies']}), s AS ({ORACLES['standards_score']}), c AS ({ORACLES['category_scores']}), r AS ({ORACLES['stale_references']}), v AS ({VULNS})
SELECT t.*, coalesce(dn, 0) AS packages, coalesce(vn, 0) AS vulnerabilities, coalesce(vu, 0) AS urgent, s.score AS standards, o AS overall, coalesce(rn, 0) AS issues, true AS is_json FROM t
LEFT JOIN (SELECT project, count(*) AS dn FROM d GROUP BY project) USING (project) LEFT JOIN (SELECT project, count(*) AS vn, count_if(severity IN ('critical', 'high')) AS vu FROM v GROUP BY project) USING (project)
LEFT JOIN s USING (project) LEFT JOIN (SELECT project, round_even(avg(overall), 1) AS o FROM c GROUP BY project) USING (project) LEFT JOIN (SELECT project, count(*) AS rn FROM r GROUP BY project) USING (project)"""


@query("deep_scan_records", "E15", _DEEP_SQL)
def deep_scan_records(spark, sf_dir):
    files, contexts = _corpus(spark, sf_dir), view(spark, sf_dir, "contexts")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    vulns = spark.sql(VULNS)
    stale = audit.stale_reference_findings(contexts, view(spark, sf_dir, "corpus", "project", "path")).groupBy("project").agg(F.count("*").alias("n_issues"))
    records = documents.deep_scan_records(
        files, man.versioned_dependencies(man.manifest_rows(files)), vulns, audit.category_scores(contexts, vulns), stale)
    return records.withColumn("is_json", F.try_parse_json("report").isNotNull()).drop("report")

"""Instruction documents made from fact tables: section texts, assembly, export, reports.

A section is one row (project, ord, name, content) built from per-project rows. Lists that a
section shows are cut to their display length before they are collected.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.scores import grade  # noqa: F401  (re-exported for report users)
from corpuslens.functions.text import count_of, strip
from corpuslens.operators import audit, detect, facts, inventory, stack
from corpuslens.operators import manifests as man
from corpuslens.operators import style
from corpuslens.operators.ranking import ranged_rank
from corpuslens.session import cut_lineage

ORD = {name: i for i, name in enumerate(fixed.SECTION_ORDER)}
TITLE = fixed.DOC_TITLE


def _section(rows: DataFrame, name: str, content: Column) -> DataFrame:
    return rows.select("project", F.lit(ORD[name]).alias("ord"), F.lit(name).alias("name"), content.alias("content"))


def _text(*lines: Column | str) -> Column:
    """Lines that are not null, joined by newlines."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _line(label: str, value: Column) -> Column:
    """A bullet that disappears when the value is null."""
    return F.concat(F.lit(f"- **{label}**: "), value.cast("string"))


def listed(rows: DataFrame, name: str, order: Sequence[str], item: Column, shown: int | None = None) -> DataFrame:
    """(project, name): the first ``shown`` items of a project, one per line."""
    if shown is not None:
        w = Window.partitionBy("project").orderBy(*order)
        rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= shown)
    packed = F.array_sort(F.collect_list(F.struct(*order, item.alias("_item"))))
    return rows.groupBy("project").agg(F.array_join(F.transform(packed, lambda s: s["_item"]), "\n").alias(name))


def header_sections(projects: DataFrame, title: str = TITLE) -> DataFrame:
    return _section(projects, "header", _text(F.concat(F.lit(f"# {title} — "), "project"), ""))


def overview_sections(metadata: DataFrame) -> DataFrame:
    missing = F.concat("project", F.lit(" — TODO: Add project description."))
    said = F.when(F.coalesce("description", F.lit("")) == "", missing).otherwise(F.col("description"))
    return _section(metadata, "project_overview", _text("## Project Overview", "", said, ""))


def state_sections(facts_rows: DataFrame) -> DataFrame:
    """``facts_rows(project, version, primary_language, total_files, n_languages, total_lines)``."""
    c = F.col
    return _section(facts_rows, "current_state", _text(
        "## Current State", "", _line("Version", c("version")),
        _line("Language", F.coalesce("primary_language", F.lit("Unknown"))),
        _line("Files", F.concat(c("total_files").cast("string"), F.lit(" across "), c("n_languages").cast("string"), F.lit(" languages"))),
        _line("Lines", F.format_number("total_lines", 0)), ""))


def architecture_sections(files: DataFrame, shown: int = 10) -> DataFrame:
    tree = inventory.directory_tree(files, shown)
    children = F.split("children", ",")
    last_shown = (F.col("more") == 0)
    child_lines = F.transform(
        children,
        lambda ch, i: F.concat(
            F.when(last_shown & (i == F.size(children) - 1), "│   └── ").otherwise("│   ├── "), ch, F.lit("/")),
    )
    folder = F.concat_ws(
        "\n", F.concat(F.lit("├── "), "name", F.lit("/")),
        F.when(F.col("children") != "", F.array_join(child_lines, "\n")),
        F.when(F.col("more") > 0, F.concat(F.lit("│   └── ... ("), F.col("more").cast("string"), F.lit(" more)"))),
    )
    entry = F.when(F.col("kind") == "dir", folder).otherwise(F.concat(F.lit("├── "), "name"))
    body = listed(tree, "body", ["kind", "name"], entry)
    return _section(body, "architecture", _text(
        "## Architecture", "", "```", F.concat("project", F.lit("/")), F.col("body"), "```", ""))


def stack_sections(facts_rows: DataFrame, tools: DataFrame) -> DataFrame:
    """Languages and the tools of each kind; CI systems keep the order of the rule table."""
    ci_order = F.lit(0)
    for i, (name, _, _) in enumerate(fixed.CI_SYSTEMS):
        ci_order = F.when((F.col("kind") == "ci_cd") & (F.col("tool") == name), i).otherwise(ci_order)
    kinds = ("framework", "package_manager", "linters", "formatters", "type_checkers", "test_frameworks", "runtime", "ci_cd")
    wide = tools.withColumn("o", ci_order).groupBy("project").agg(*[
        F.nullif(F.array_join(F.transform(
            F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.struct("o", "tool")))), lambda s: s["tool"]), ", "), F.lit("")).alias(k)
        for k in kinds
    ])
    others = F.filter("languages", lambda l: l != F.col("primary_language"))
    spoken = F.when(F.col("primary_language").isNotNull(), F.concat_ws(", ", "primary_language", F.array_join(F.when(F.size(others) > 0, others), ", ")))
    labels = ("Framework", "Package Manager", "Linters", "Formatters", "Type Checkers", "Test Frameworks", "Runtime", "CI/CD")
    rows = facts_rows.join(wide, "project", "left")
    return _section(rows, "tech_stack", _text(
        "## Tech Stack", "", _line("Language", spoken), *[_line(lb, F.col(k)) for lb, k in zip(labels, kinds)], ""))


def standards_sections(votes: DataFrame, semicolons: DataFrame, p95: DataFrame) -> DataFrame:
    c = F.col
    rows = votes.join(semicolons.select("project", "semicolons"), "project", "left").join(p95, "project", "left")
    known = lambda name, *no: F.when(~c(name).isin(*no), c(name))
    return _section(rows, "coding_standards", _text(
        "## Coding Standards", "", _line("Naming", c("naming")),
        _line("Quote Style", F.concat(known("quote_style", "mixed"), F.lit(" quotes"))),
        _line("Type Hints", known("type_hints", "n/a")),
        _line("Docstrings", F.concat(known("docstrings", "none"), F.lit(" style"))),
        _line("Imports", known("imports", "n/a")), _line("Path Handling", known("path_api", "n/a")),
        _line("Semicolons", c("semicolons")),
        _line("Line Length (p95)", F.concat(F.nullif("line_length_p95", F.lit(0)).cast("string"), F.lit(" characters"))),
        F.when(c("custom_errors"), "- **Error Handling**: Custom exception classes present"), ""))


def command_sections(commands: DataFrame) -> DataFrame:
    """One block per source, sources and names in a fixed order."""
    src = F.col("source")
    rank = F.lit(9)
    for i, s in enumerate(("npm", "pyproject", "make", "just", "docker")):
        rank = F.when(src == s, i).otherwise(rank)
    runs = (
        F.when(src == "npm", F.concat(F.lit("npm run "), "name")).when(src == "make", F.concat(F.lit("make "), "name"))
        .when(src == "just", F.concat(F.lit("just "), "name")).otherwise(F.col("command"))
    )
    item = F.when(src == "just", runs).otherwise(F.concat(F.lit("# "), F.col("name"), F.lit("\n"), runs))
    rows = commands.withColumn("o", rank)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", item.alias("i")))), lambda s: s["i"])
    blocks = rows.groupBy("project", "o").agg(F.array_join(packed, "\n").alias("block"))
    body = blocks.groupBy("project").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "block"))), lambda s: s["block"]), "\n\n").alias("body"))
    return _section(body, "common_commands", _text("## Common Commands", "", "```bash", F.col("body"), "```", ""))


def domain_sections(files: DataFrame) -> DataFrame:
    code = F.concat(F.lit("- `"), "term", F.lit("`"))
    words = cut_lineage(facts.vocabulary(files, {"class": 15, "route": 15, "constant": 10}), "vocabulary")
    of = lambda kind, name: listed(words.filter(F.col("kind") == kind), name, ["position"], code)
    parts = (
        ("### Key Models/Classes", of("class", "classes")),
        ("### Domain Terms", listed(facts.readme_terms(files, 10), "terms", ["position"], F.concat(F.lit("- "), "term"))),
        ("### API Endpoints", of("route", "routes")),
        ("### Enums/Constants", of("constant", "enums")),
        ("### Outstanding Items", listed(
            facts.marker_comments(files, 10), "items", ["position"],
            F.concat(F.lit("- **"), "kind", F.lit("**: "), "body", F.lit(" (`"), "path", F.lit("`)")))),
    )
    rows = files.select("project").distinct()
    blocks: list[Column] = []
    for heading, part in parts:
        column = part.columns[-1]
        rows = rows.join(part, "project", "left")
        blocks.append(F.concat(F.lit(heading + "\n"), F.col(column), F.lit("\n")))
    some = rows.filter(F.coalesce(*[p.columns[-1] for _, p in parts]).isNotNull())
    return _section(some, "domain_context", _text("## Domain Context", "", *blocks))


def dependency_sections(declared: DataFrame, tools: DataFrame) -> DataFrame:
    """Declared dependencies; projects without any fall back to detected frameworks and tools."""
    item = F.concat(F.lit("- "), F.col("name"))
    core = listed(declared.filter(F.col("grp") == "core"), "core", ["position"], item, 15)
    dev = listed(declared.filter(F.col("grp") == "dev"), "dev", ["position"], item, 10)
    have = core.join(dev, "project", "full_outer")
    undeclared = tools.join(declared.select("project").distinct(), "project", "left_anti")
    tool = F.concat(F.lit("- "), F.col("tool"))
    found = undeclared.filter(F.col("kind") == "framework")
    checks = undeclared.filter(F.col("kind").isin("test_frameworks", "linters")).withColumn(
        "o", (F.col("kind") == "linters").cast("int"))
    fallback = listed(found, "core", ["tool"], tool).join(listed(checks, "dev", ["o", "tool"], tool), "project", "full_outer")
    rows = have.unionByName(fallback)
    block = lambda h, c: F.concat(F.lit(f"### {h}\n"), F.col(c), F.lit("\n"))
    return _section(rows, "dependencies", _text("## Dependencies", "", block("Core", "core"), block("Dev", "dev")))


def anti_pattern_sections(bullets: DataFrame) -> DataFrame:
    rows = listed(bullets, "body", ["position"], F.concat(F.lit("- "), "bullet"))
    return _section(rows, "anti_patterns", _text("## Anti-Patterns (Do NOT Do)", "", F.col("body"), ""))


def git_sections(projects: DataFrame) -> DataFrame:
    # fixed values: text of the git section
    return _section(projects, "git_conventions", _text(
        "## Git Conventions", "",
        "- Commit messages: Conventional commits (`feat:`, `fix:`, `docs:`, `test:`, `refactor:`)",
        "- Branch naming: `feat/description`, `fix/description`", "- Run tests before committing", ""))


def skill_sections(installed: DataFrame, local: DataFrame, recommended: DataFrame) -> DataFrame:
    """Installed (first 15 and the rest as a number), project-local and recommended skills."""
    code = F.concat(F.lit("`"), "skill", F.lit("`"))
    w = Window.partitionBy("project").orderBy("skill")
    shown = installed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 15).groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list(code)), ", ").alias("shown"))
    counts = installed.groupBy("project").agg(F.count("*").alias("n"))
    rows = (
        counts.join(shown, "project").join(listed(local, "local", ["skill"], F.concat(F.lit("- "), code)), "project", "full_outer")
        .join(listed(recommended, "wanted", ["skill"], F.concat(F.lit("- "), code), 10), "project", "full_outer")
    )
    return _section(rows, "skills", _text(
        "## AI Skills", "",
        F.concat(F.lit("**Installed**: "), F.col("n").cast("string"), F.lit(" skills\n- "), "shown",
                 F.when(F.col("n") > 15, F.concat(F.lit("\n- ... and "), (F.col("n") - 15).cast("string"), F.lit(" more"))).otherwise(""), F.lit("\n")),
        F.concat(F.lit("**Project-local skills**:\n"), "local", F.lit("\n")),
        F.concat(F.lit("**Recommended skills** (not yet installed):\n"), "wanted", F.lit("\n"))))


# ---- report sections ----------------------------------------------------------------
def debt_report_sections(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(project, content): score, counts by category, the first ten urgent findings."""
    scores = detect.scored_projects(files, findings).filter(F.col("n_findings") > 0)
    label = F.initcap(F.replace("category", F.lit("_"), F.lit(" ")))
    cats = listed(detect.categories_by_count(findings), "cats", ["rank"],
                  F.concat(F.lit("- **"), label, F.lit("**: "), F.col("n_findings").cast("string"), F.lit(" issues")))
    place = F.concat(F.lit("`"), "path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit("`"))
    top = detect.priority_items(findings, 10)
    items = listed(top, "items", ["item"], F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), place, F.lit(" — "), "message"))
    more = top.groupBy("project").agg(F.max("more").alias("more"))
    rows = scores.join(cats, "project").join(items, "project", "left").join(more, "project", "left")
    return rows.select("project", _text(
        "## Technical Debt", "", F.concat(F.lit("**Debt Score**: "), F.col("score").cast("string"), F.lit("/100")),
        F.concat(F.lit("**Total Signals**: "), F.col("n_findings").cast("string")), "", "### Categories", F.col("cats"), "",
        F.concat(F.lit("### Priority Items\n"), "items", F.when(F.col("more") > 0, F.concat(
            F.lit("\n- ... and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(""), F.lit("\n"))).alias("content"))


def leak_report_pages(findings: DataFrame, lines_per_page: int = 100) -> DataFrame:
    """(project, severity, page, content): all critical and high leaks, in pages of bounded size.

    The pages of a project, critical ones first and in order, are its security section; the first
    page of a severity begins with its heading."""
    place = F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    critical = F.col("severity") == "critical"
    item = F.when(critical, F.concat(F.lit("- **"), "message", F.lit("** (`"), place, F.lit("`)"))).otherwise(
        F.concat(F.lit("- "), "message", F.lit(" (`"), place, F.lit("`)")))
    rows = ranged_rank(findings.filter(F.col("severity").isin("critical", "high")), ["project", "severity"], ["path", "line", "message"], "rank")
    rows = rows.withColumn("page", F.floor((F.col("rank") - 1) / lines_per_page) + 1)
    pages = rows.groupBy("project", "severity", "page").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
    heading = F.when(F.col("page") > 1, "").when(critical, "### Critical Issues\n\n").otherwise("### High Priority\n\n")
    return pages.select("project", "severity", "page", F.concat(heading, F.array_join(F.transform("items", lambda i: i["item"]), "\n")).alias("content"))


def health_sections(health: DataFrame, workflows: DataFrame, releases: DataFrame) -> DataFrame:
    rows = health.join(workflows.select("project", "failing"), "project", "left").join(
        releases.select("project", "latest"), "project", "left")
    n = lambda c: F.col(c).cast("string")
    some = lambda c, text: F.when(F.col(c) > 0, text)
    alerts = F.concat_ws("\n", some("dependency_alerts", F.concat(F.lit("- **Dependabot**: "), n("dependency_alerts"), F.lit(" open alerts"))),
                         some("code_alerts", F.concat(F.lit("- **Code Scanning**: "), n("code_alerts"), F.lit(" open alerts"))))
    failing = F.array_join(F.transform(F.split("failing", ","), lambda w: F.concat(F.lit("- **FAILING**: "), w)), "\n")
    return rows.select("project", _text(
        "## GitHub Health", "", F.concat(F.lit("**Health Score**: "), n("health"), F.lit("/100")),
        F.concat(F.lit("**Repository**: "), "project"), "",
        F.when(alerts != "", F.concat(F.lit("### Security Alerts\n"), alerts, F.lit("\n"))),
        "### Activity", F.concat(F.lit("- **Open Issues**: "), n("open_issues")),
        some("stale_90d", F.concat(F.lit("  - Stale (>90 days): "), n("stale_90d"))),
        F.concat(F.lit("- **Open PRs**: "), n("open_prs")), some("draft_prs", F.concat(F.lit("  - Draft: "), n("draft_prs"))),
        some("stale_prs", F.concat(F.lit("  - Stale (>30 days): "), n("stale_prs"))), "",
        F.when(F.col("failing") != "", F.concat(F.lit("### CI Status\n"), failing, F.lit("\n"))),
        F.when(~F.col("protected"), "**Warning**: Default branch has no branch protection rules.\n"),
        F.concat(F.lit("**Latest Release**: "), "latest", F.lit("\n"))).alias("content"))


# ---- assembly -----------------------------------------------------------------------
def composed(sections: DataFrame) -> DataFrame:
    """(project, text): sections in order, runs of blank lines collapsed, one final newline."""
    some = sections.filter(F.length(strip("content")) > 0)
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda s: s["content"]), "\n")
    clean = F.concat(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"\s+\z", ""), F.lit("\n"))
    return some.groupBy("project").agg(clean.alias("text"))


def document_sections(files: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """All sections of all projects from ``files(project, path, text)``.

    Facts that several sections use have one or few rows per project; they are written once to
    the shared folder, so that no text is read again for the next section.
    """
    names = files.select("project", "path")
    manifests = cut_lineage(man.manifest_rows(files), "manifests")
    meta = man.project_metadata(manifests)
    tools = cut_lineage(stack.detected_tools(files), "tools")
    counts = cut_lineage(inventory.language_counts(names), "languages")
    rows = cut_lineage(inventory.project_facts(files).join(meta, "project", "left"), "facts")
    projects = rows.select("project")
    votes = style.style_votes(files)
    parts = [
        header_sections(projects), overview_sections(rows), state_sections(rows), architecture_sections(names),
        stack_sections(rows, tools), standards_sections(votes, style.semicolon_votes(files), style.line_length_p95(files)),
        command_sections(man.all_commands(manifests)),
        anti_pattern_sections(stack.applicable_anti_patterns(stack.project_signals(names, tools, counts))),
        dependency_sections(man.declared_dependencies(manifests), tools), domain_sections(files), git_sections(projects),
    ]
    if installed is not None:
        parts.append(skill_sections(
            installed, inventory.project_skills(names), stack.recommended_skills(files, installed)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preset_sections(sections: DataFrame, preset: str = "default") -> DataFrame:
    """Section subset and extra empty headings of a preset."""
    kept, extra = next((k, e) for n, k, e in fixed.PRESETS if n == preset)
    rows = sections if kept is None else sections.filter(F.col("name").isin(*kept))
    if not extra:
        return rows
    added = F.array(*[
        F.struct(F.lit(len(ORD) + i).alias("ord"), F.lit(t).alias("name"), F.lit(f"## {t}\n").alias("content"))
        for i, t in enumerate(extra)
    ])
    more = sections.select("project").distinct().select("project", F.inline(added))
    return rows.unionByName(more)


PRESET_SCHEMA = (
    "framework string, name string, description string, coding_standards array<string>, "
    "anti_patterns array<string>, common_commands map<string,string>"
)


def read_framework_presets(spark: SparkSession, path: str) -> DataFrame:
    """A team's preset texts per framework, as JSON rows."""
    return spark.read.schema(PRESET_SCHEMA).json(path)


def framework_preset_text(tools: DataFrame, presets: DataFrame) -> DataFrame:
    """(project, framework, standards, avoid, commands) for the detected frameworks; commands are
    ordered by name."""
    found = tools.filter(F.col("kind") == "framework").select("project", F.col("tool").alias("framework"))
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    cmds = F.array_join(F.transform(F.array_sort(F.map_entries("common_commands")), lambda e: F.concat(F.lit("# "), e["key"], F.lit("\n"), e["value"])), "\n")
    return found.join(presets, "framework").select(
        "project", "framework", lines(F.col("coding_standards")).alias("standards"),
        lines(F.col("anti_patterns")).alias("avoid"), cmds.alias("commands"))


# ---- export -------------------------------------------------------------------------
# Fixed values: (target, file name, title, preamble, headings renamed)
EXPORT_TARGETS = (
    ("cursor", ".cursorrules", "# Cursor Rules — ",
     "You are an expert developer working on this project. Follow these rules strictly.", True),
    ("copilot", ".github/copilot-instructions.md", "# Copilot Instructions — ",
     "These are project instructions for GitHub Copilot. "
     "Apply them to every code suggestion, completion, and chat response in this repository.", False),
    ("windsurf", ".windsurfrules", "# Windsurf Rules — ",
     "You are Cascade, an agentic AI coding assistant working on this project. "
     "Follow these rules strictly.", True),
    ("agents", "AGENTS.md", "# AGENTS.md — ",
     "Instructions for AI coding agents working in this repository. "
     "Tool-agnostic: applies to Cursor, OpenAI Codex, Claude Code, Copilot, "
     "Windsurf, and any agent that honors AGENTS.md.", False),
    ("codex", "AGENTS.md", "# AGENTS.md — ",
     "You are OpenAI Codex operating on this repository. "
     "Follow these instructions for every edit, completion, and task. "
     "Prefer minimal diffs, stay within the conventions below, and run the "
     "project's test and lint commands before reporting work complete.", False),
)
EXPORT_RENAMES = (
    ("## Project Overview", "## Project Context"), ("## Anti-Patterns", "## Avoid"),
    ("## Common Commands", "## Commands"), ("## Git Conventions", "## Git"),
)


def exported(documents: DataFrame, targets: Sequence[str] = ()) -> DataFrame:
    """One row per document and target: (…, target, filename, content)."""
    bare = F.regexp_replace("text", r"\A# CLAUDE\.md — [^\n]+\n*", "")
    renamed = bare
    for old, new in EXPORT_RENAMES:
        renamed = F.replace(renamed, F.lit(old), F.lit(new))
    rows = documents.withColumn("_plain", F.btrim(bare, F.lit(" \t\n\r"))).withColumn("_renamed", F.btrim(renamed, F.lit(" \t\n\r")))
    made = F.array(*[
        F.struct(
            F.lit(target).alias("target"), F.lit(filename).alias("filename"),
            F.concat(F.lit(title), "project", F.lit(f"\n\n{preamble}\n\n"), F.col("_renamed" if rename else "_plain"), F.lit("\n")).alias("content"))
        for target, filename, title, preamble, rename in EXPORT_TARGETS
        if not targets or target in targets
    ])
    rest = [c for c in documents.columns if c != "text"]
    return rows.select(*rest, F.inline(made))


def gap_reports(contexts: DataFrame) -> DataFrame:
    """Markdown gap report of every document: score table, ordered actions, what is in place."""
    quality = audit.quality_scores(contexts)
    parts = audit.quality_parts(contexts).select("project", "path", "section_score", "depth_score", "spec_score", "_absent")
    badge = F.when(F.col("priority") == "high", "HIGH").when(F.col("priority") == "medium", "MED").otherwise("LOW")
    item = F.concat(F.col("rank").cast("string"), F.lit(". **["), badge, F.lit("]** "), "action", F.lit(" (+"), F.col("points").cast("string"), F.lit(" pts)"))
    actions = audit.gap_actions(contexts).groupBy("project", "path").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))), lambda s: s["i"]), "\n").alias("actions"))
    rows = quality.join(parts, ["project", "path"]).join(actions, ["project", "path"], "left")
    n = lambda c: F.col(c).cast("string")
    blocks = F.floor(F.col("fences") / 2).cast("int")
    code = F.when(blocks >= 2, "10").when(blocks >= 1, "5").otherwise("0")
    row = lambda label, score, top, status: F.concat(F.lit(f"| {label} | "), score, F.lit(f" | {top} | "), status, F.lit(" |"))
    return rows.select("project", "path", "quality", _text(
        F.concat(F.lit("# Fix Report: "), "project"), "", F.concat(F.lit("**Current Score**: "), n("quality"), F.lit("/100")),
        F.concat(F.lit("**Points to 100**: "), (100 - F.col("quality")).cast("string")), "", "## Score Breakdown", "",
        "| Category | Score | Max | Status |", "|----------|-------|-----|--------|",
        row("Section Coverage", n("section_score"), 60, F.concat(n("n_present"), F.lit("/9 sections"))),
        row("Content Depth", n("depth_score"), 20, F.concat(n("line_count"), F.lit(" lines"))),
        row("Code Blocks", code, 10, F.concat(blocks.cast("string"), F.lit(" blocks"))),
        row("Specificity", n("spec_score"), 10, F.concat(n("bold_bullets"), F.lit(" bold bullets"))), "",
        F.concat(F.lit("## Priority Actions\n\n"), "actions", F.lit("\n")),
        F.when(F.size("_absent") > 0, F.concat(F.lit("Missing sections: "), F.array_join("_absent", ", "), F.lit("\n")))).alias("report"))


def deep_scan_records(
    files: DataFrame, dependencies: DataFrame, vulnerabilities: DataFrame, categories: DataFrame, hygiene: DataFrame
) -> DataFrame:
    """One record per project: totals, dependency audit, standards, scores and hygiene as JSON."""
    totals = inventory.project_totals(files)
    deps = dependencies.groupBy("project").agg(F.count("*").alias("packages"))
    vulns = vulnerabilities.groupBy("project").agg(
        F.count("*").alias("vulnerabilities"), F.count_if(F.col("severity").isin("critical", "high")).alias("urgent"))
    standards = inventory.standards_score(inventory.standards_checklist(files.select("project", "path")))
    mean = categories.groupBy("project").agg(F.bround(F.avg("overall"), 1).alias("overall"))
    issues = hygiene.groupBy("project").agg(F.sum("n_issues").alias("issues"))
    rows = totals
    for part in (deps, vulns, standards.select("project", F.col("score").alias("standards")), mean, issues):
        rows = rows.join(part, "project", "left")
    rows = rows.fillna(0, ["packages", "vulnerabilities", "urgent", "issues"])
    names = [c for c in rows.columns if c != "project"]
    return rows.withColumn("report", F.to_json(F.struct(*names)))

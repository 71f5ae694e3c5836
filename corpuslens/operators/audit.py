"""Audit of instruction documents: ``contexts(project, path, text)``.

Checks that need only the text build one array per document, so they are narrow. Checks that
need the project join on ``project``; stale references are an equi anti join against every
path and every folder of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.scores import clamp, grade
from corpuslens.functions.text import (
    contains_any, count_of, explode_lines, line_total, section_has, split_lines, strip,
)
from corpuslens.operators import inventory as inv

DOC = ["project", "path"]
FINDING = [*DOC, "severity", "category", "message", "suggestion"]
FENCE = "```"
GREENFIELD = "greenfield"  #: a claim that a project of more than 50 files contradicts


def _f(severity: str, category: str, message: Column | str, suggestion: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"),
        as_col(message).alias("message"), as_col(suggestion).alias("suggestion"),
    )


def _has(needle: str) -> Column:
    return F.contains(F.col("text"), F.lit(needle))


def _low(needle: str) -> Column:
    return F.contains(F.col("_low"), F.lit(needle))


def _says(pattern: str, literals: tuple[str, ...]) -> Column:
    """Whether a pattern matches the text; it runs only where one of the literals that every match holds occurs."""
    return contains_any(F.col("text"), literals) & F.col("text").rlike(pattern)


def with_text_facts(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("_low", F.lower("text")).withColumn("_lines", line_total("text"))


def coverage_checks() -> list[Column]:
    return [
        F.when(
            ~_low(name.lower()),
            _f(sev, "coverage", f'Missing "{name}" section', f"Add a ## {name} section with relevant content"),
        )
        for name, sev in fixed.REQUIRED_SECTIONS
    ]


def anti_pattern_checks(title: str = fixed.DOC_TITLE) -> list[Column]:
    n = F.col("_lines").cast("string")
    markers = F.lit(False)
    for m in fixed.CHAT_MARKERS:
        markers = markers | _low(m)
    cat = "anti_pattern"
    return [
        F.when(F.col("_lines") > 500, _f(
            "warning", cat, F.concat(F.lit(f"{title} is "), n, F.lit(" lines — too long, agents lose context")),
            "Trim to under 300 lines, focus on essentials")),
        F.when(F.col("_lines") < 20, _f(
            "warning", cat, F.concat(F.lit(f"{title} is only "), n, F.lit(" lines — too short for useful context")),
            "Add more sections: overview, commands, coding standards")),
        F.when(_says(r"\bTODO\b|\bFIXME\b", ("TODO", "FIXME")), _f(
            "warning", cat, "Contains TODO/FIXME items (stale planning artifacts)",
            f"Resolve or remove TODO items from {title}")),
        F.when(markers, _f(
            "warning", cat, "Contains conversation fragments (copy-paste from AI chat)",
            "Use declarative style, not conversational prompts")),
        F.when(_says(fixed.FIRST_PERSON, fixed.FIRST_PERSON_PHRASES), _f(
            "info", cat, "Uses first-person language instead of declarative style",
            'Use declarative: "Use pytest" instead of "We use pytest"')),
        F.when(count_of(F.col("text"), FENCE) % 2 != 0, _f(
            "info", cat, f"Contains unclosed code block (odd number of {FENCE} markers)",
            f"Close all code blocks with matching {FENCE}")),
    ]


def specificity_checks() -> list[Column]:
    vague = [
        F.when(_low(p), _f("warning", "specificity", f'Contains vague phrase: "{p}"',
                           "Replace with specific, actionable instructions"))
        for p in fixed.VAGUE_PHRASES
    ]
    text, low = F.col("text"), F.col("_low")
    code = section_has(text, low, "`", "## anti-pattern")
    commands = section_has(text, low, FENCE, "## common command", "## command")
    return vague + [
        F.when((_has("## Anti-Patterns") | _has("## Anti-patterns")) & ~code,
               _f("info", "specificity", "Anti-patterns section lacks code examples",
                  "Add inline code or code blocks showing what NOT to do")),
        F.when((_has("## Common Commands") | _has("## Commands")) & ~commands,
               _f("info", "specificity", "Commands section lacks actual command strings",
                  "Add code blocks with runnable commands")),
    ]


# A document's text is read once where its facts are written first (``claims.document_facts``): the
# functions below take a fact from its column where there is one, else from the text.
def _fact(contexts: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in contexts.columns else otherwise


def text_checks() -> Column:
    """Array of the findings of all text-only checks; for ``with_text_facts``."""
    return F.array_compact(F.array(*coverage_checks(), *anti_pattern_checks(), *specificity_checks()))


def said_words() -> Column:
    """The words of a text that the corpus may contradict; for ``with_text_facts``."""
    return F.array_compact(F.array(*[F.when(_low(w), F.lit(w)) for w in (GREENFIELD, *fixed.AUDITED_FRAMEWORKS)]))


def references() -> Column:
    return F.regexp_extract_all("text", F.lit(fixed.PATH_REFERENCE), F.lit(1))


def text_check_findings(contexts: DataFrame, checks: list[Column] | None = None) -> DataFrame:
    """Findings of all text-only checks: one array per document, then exploded."""
    if checks is None and "_findings" in contexts.columns:
        return contexts.select(*DOC, F.inline("_findings")).select(*FINDING)
    every = checks or [*coverage_checks(), *anti_pattern_checks(), *specificity_checks()]
    rows = with_text_facts(contexts)
    return rows.select(*DOC, F.inline(F.array_compact(F.array(*every)))).select(*FINDING)


def accuracy_findings(contexts: DataFrame, files: DataFrame, tools: DataFrame) -> DataFrame:
    """Greenfield claims on large projects; frameworks named but not detected.

    One pass over the documents explodes the words they hold; one left join meets them with what
    is known per (project, word): a detected framework excuses its word, more than 50 files
    contradict ``greenfield``.
    """
    claim = GREENFIELD
    rows = contexts if "_said" in contexts.columns else with_text_facts(contexts)
    said = rows.select(*DOC, F.explode(_fact(rows, "_said", said_words())).alias("word"))
    detected = tools.filter(F.col("kind") == "framework").select(
        "project", F.col("tool").alias("word"), F.lit(None).cast("bigint").alias("n_files"), F.lit(True).alias("_known"))
    large = files.groupBy("project").agg(F.count("*").alias("n_files")).filter(F.col("n_files") > 50).select(
        "project", F.lit(claim).alias("word"), "n_files", F.lit(True).alias("_known"))
    met = said.join(detected.unionByName(large), ["project", "word"], "left")
    green, known = F.col("word") == claim, F.col("_known").isNotNull()
    return met.filter((green & known) | (~green & ~known)).select(
        *DOC, F.lit("error").alias("severity"), F.lit("accuracy").alias("category"),
        F.when(green, F.concat(F.lit('Says "greenfield" but project has '), F.col("n_files").cast("string"), F.lit(" source files")))
        .otherwise(F.concat(F.lit('Lists "'), "word", F.lit('" but it was not detected in dependencies'))).alias("message"),
        F.when(green, "Update the project phase description")
        .otherwise(F.concat(F.lit("Remove "), "word", F.lit(" reference or add it to dependencies"))).alias("suggestion"),
    )


def path_references(contexts: DataFrame) -> DataFrame:
    """Back-ticked relative paths, one row per occurrence: (project, path, ref, ref_no)."""
    refs = _fact(contexts, "_refs", references())
    bare = F.regexp_replace("ref", "/+$", "")
    is_path = (
        F.contains("ref", F.lit("/")) & ~F.startswith("ref", F.lit("/"))
        & ~F.col("ref").rlike("^(" + "|".join(fixed.COMMAND_WORDS) + ")")
        & (F.contains(F.substring_index(bare, "/", -1), F.lit(".")) | F.endswith("ref", F.lit("/")))
    )
    return (
        contexts.select(*DOC, F.posexplode(refs).alias("ref_no", "ref")).filter(is_path)
        .withColumn("target", bare)
    )


def stale_reference_findings(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """References that name no file and no folder with files: anti join on the path itself,
    because every ancestor of every path is already a row of ``known_paths``."""
    known = inv.known_paths(files).withColumnRenamed("path", "target")
    return (
        path_references(contexts).join(known, ["project", "target"], "left_anti")
        .select(
            *DOC, F.lit("warning").alias("severity"), F.lit("freshness").alias("category"),
            F.concat(F.lit("References path `"), "ref", F.lit("` which doesn't exist in the project")).alias("message"),
            F.lit("Update or remove stale file references").alias("suggestion"),
        )
    )


def audit_findings(contexts: DataFrame, files: DataFrame, tools: DataFrame) -> DataFrame:
    """All checks; ``files`` is only asked for project and path."""
    names = files.select("project", "path")
    return (
        text_check_findings(contexts)
        .unionByName(accuracy_findings(contexts, names, tools))
        .unionByName(stale_reference_findings(contexts, names))
    )


def missing_sections() -> Column:
    return F.array_compact(F.array(*[
        F.when(~_has(f"## {n}"), F.lit(n)) for n, _ in fixed.REQUIRED_SECTIONS
    ]))


def audit_report(contexts: DataFrame, findings: DataFrame, gate: int | None = None, title: str = fixed.DOC_TITLE) -> DataFrame:
    """Score, finding counts, missing sections and recommendations, one row per document.

    Findings are reduced to counts per document before the join.
    """
    of = lambda **kw: F.count_if(
        F.lit(True) if not kw else eval_and(*[F.col(k) == v for k, v in kw.items()]))
    counts = findings.groupBy(*DOC).agg(
        of(severity="error").alias("n_error"), of(severity="warning").alias("n_warning"),
        of(severity="info").alias("n_info"), of(severity="error", category="accuracy").alias("_accuracy"),
        of(category="anti_pattern").alias("_anti"), of(category="specificity").alias("_vague"),
    )
    n = ["n_error", "n_warning", "n_info", "_accuracy", "_anti", "_vague"]
    rows = contexts.select(*DOC, _fact(contexts, "_missing", missing_sections()).alias("missing")).join(counts, DOC, "left").fillna(0, n)
    total = len(fixed.REQUIRED_SECTIONS)
    bonus = F.floor((total - F.size("missing")) / F.lit(total) * 20).cast("int")
    lost = F.col("n_error") * 15 + F.col("n_warning") * 5 + F.col("n_info")
    critical = F.filter("missing", lambda m: m.isin(*[s for s, sev in fixed.REQUIRED_SECTIONS if sev == "error"]))
    advice = F.array_compact(F.array(
        F.when(F.size(critical) > 0, F.concat(F.lit("Add missing critical sections: "), F.array_join(critical, ", "))),
        F.when(F.col("_accuracy") > 0, F.lit(f"Fix accuracy issues — {title} doesn't match actual codebase")),
        F.when(F.col("_anti") > 0, F.lit(f"Clean up {title} anti-patterns (TODOs, conversation fragments, etc.)")),
        F.when(F.col("_vague") > 0, F.lit("Replace vague instructions with specific, actionable guidance")),
    ))
    out = rows.select(
        *DOC, clamp(100 - lost + bonus).cast("int").alias("score"), "n_error", "n_warning", "n_info",
        F.array_join("missing", ", ").alias("missing_sections"),
        F.array_join(F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(f"{title} is in good shape!"))), " | ").alias("recommendations"),
    )
    return out if gate is None else out.withColumn("below_gate", F.col("score") < gate)


def eval_and(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# ---- quality estimate, gap actions, category scores ---------------------------------
def _quality_parts() -> dict[str, Column]:
    c = F.col
    present = F.array(*[F.when(_has(f"## {h}"), F.lit(h)) for h in fixed.QUALITY_HEADINGS])
    absent = F.array_compact(F.array(*[F.when(~_has(f"## {h}"), F.lit(h)) for h in fixed.QUALITY_HEADINGS]))
    n = len(fixed.QUALITY_HEADINGS)
    fences = count_of(c("text"), FENCE)
    bold = F.regexp_count("text", F.lit(r"- \*\*[\p{L}\p{N}_]+"))
    return {
        "n_present": F.size(F.array_compact(present)),
        "_absent": absent,
        "line_count": line_total("text"),
        "fences": fences,
        "bold_bullets": bold,
        "section_score": F.floor(F.size(F.array_compact(present)) / F.lit(n) * 60).cast("int"),
    }


def quality_parts(contexts: DataFrame) -> DataFrame:
    c = F.col
    rows = contexts.select(*DOC, *[v.alias(k) for k, v in _quality_parts().items()])
    depth = (
        F.when(c("line_count") > 50, 10).otherwise(0) + F.when(c("line_count") > 100, 5).otherwise(0)
        + F.when(c("line_count") > 150, 5).otherwise(0)
    )
    return rows.withColumn("depth_score", depth).withColumn(
        "spec_score", F.when(c("bold_bullets") > 5, 10).when(c("bold_bullets") > 2, 5).otherwise(0)
    )


def quality_scores(contexts: DataFrame) -> DataFrame:
    """60 for sections, 20 for depth, 10 for code, 10 for bold bullets."""
    code = F.when(F.col("fences") >= 2, 10).when(F.col("fences") >= 1, 5).otherwise(0)
    total = F.col("section_score") + F.col("depth_score") + code + F.col("spec_score")
    return quality_parts(contexts).select(
        *DOC, "n_present", "line_count", "fences", "bold_bullets",
        F.least(F.lit(100), total).cast("int").alias("quality"),
    )


def gap_actions(contexts: DataFrame) -> DataFrame:
    """What to add to reach 100, most points first: one array per document, sorted in the row."""
    c = F.col
    blocks = F.floor(c("fences") / 2).cast("int")
    code = F.when(blocks >= 2, 10).when(blocks >= 1, 5).otherwise(0)

    def act(priority: str, action: Column | str, points: Column | int, category: str) -> Column:
        return F.struct(
            (F.lit(points) if isinstance(points, int) else points).cast("int").alias("points"),
            F.lit(priority).alias("priority"),
            (F.lit(action) if isinstance(action, str) else action).alias("action"),
            F.lit(category).alias("category"),
        )

    per_heading = round(60 / len(fixed.QUALITY_HEADINGS))
    sections = F.transform(
        "_absent", lambda h: act("high" if per_heading >= 6 else "medium",
                                 F.concat(F.lit("Add `## "), h, F.lit("` section")), per_heading, "sections"))
    others = F.array_compact(F.array(
        F.when(c("line_count") <= 50, act("high", "Expand content to 150+ lines for full depth score (+20 pts)", 20, "depth"))
        .when(c("line_count") <= 100, act("medium", "Expand content to 150+ lines (+10 pts remaining)", 10, "depth"))
        .when(c("line_count") <= 150, act("low", "Expand content past 150 lines (+5 pts remaining)", 5, "depth")),
        F.when(blocks < 2, act("medium", F.concat(F.lit("Add code blocks (need "), (2 - blocks).cast("string"), F.lit(" more) for full code score")), 10 - code, "code_blocks")),
        F.when(c("bold_bullets") <= 5, act("medium", F.concat(
            F.lit("Add bold-label bullets (`- **Key**: value`) — need "), (6 - c("bold_bullets")).cast("string"), F.lit(" more")),
            10 - c("spec_score"), "specificity")),
    ))
    ranked = F.array_sort(F.transform(
        F.concat(sections, others),
        lambda a, i: F.struct((-a["points"]).alias("o"), i.alias("i"), a.alias("a")),
    ))
    return (
        quality_parts(contexts).select(*DOC, F.posexplode(ranked).alias("_p", "r"))
        .select(*DOC, (c("_p") + 1).alias("rank"), "r.a.*")
    )


def category_scores(contexts: DataFrame, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """Five category scores with letters and the weighted overall score.

    ``vulnerabilities(project, severity)`` lowers security and dependency scores; without the
    table every document counts as clean.
    """
    rows = contexts.withColumn("_low", F.lower("text"))
    if vulnerabilities is None:
        rows = rows.select("*", *[F.lit(0).alias(n) for n in ("_crit", "_med", "_all")])
    else:
        counts = vulnerabilities.groupBy("project").agg(
            F.count_if(F.col("severity").isin("critical", "high")).alias("_crit"),
            F.count_if(F.col("severity") == "medium").alias("_med"), F.count("*").alias("_all"))
        rows = rows.join(counts, "project", "left").fillna(0, ["_crit", "_med", "_all"])

    def points(base: int, *rules: tuple[Column, int]) -> Column:
        out = F.lit(base)
        for condition, value in rules:
            out = out + F.when(condition, value).otherwise(0)
        return out

    def low(*words: str) -> Column:
        out = _low(words[0])
        for w in words[1:]:
            out = out | _low(w)
        return out

    # fixed values: base points and bonuses of the five categories
    structure = points(
        40, (_has("## Architecture") | _has("## Project"), 20),
        (_has(FENCE) & (_has("├") | _has("└") | low("directory")), 15),
        (_has("## Coding Standards") | _has("## Code Style"), 15), (_has("## Anti-Patterns"), 10))
    security = points(
        50, (low("security"), 15), (low("credential", "secret", "api key"), 10),
        (low("validation", "sanitiz"), 10), (low("env"), 10)) - F.col("_crit") * 15 - F.col("_med") * 5
    ci = points(
        30, (_has("## CI") | low("ci/cd", "workflow"), 25), (low("github actions", ".github/workflows"), 20),
        (low("deploy"), 15), (low("lint", "format"), 10))
    deps = points(
        50, (_has("## Dependencies") | _has("## Tech Stack"), 20),
        (low("requirements", "package.json", "pyproject"), 15), (F.col("_all") == 0, 15),
    ) - F.col("_crit") * 20 - F.col("_med") * 8
    testing = points(
        30, (low("test"), 20), (low("pytest", "jest", "vitest"), 15), (low("coverage"), 15),
        (low("mock", "fixture"), 10), (low("e2e", "integration"), 10))
    scored = rows.select(
        *DOC, clamp(structure).cast("int").alias("structure"), clamp(security).cast("int").alias("security"),
        clamp(ci).cast("int").alias("ci"), clamp(deps).cast("int").alias("deps"), clamp(testing).cast("int").alias("testing"),
    )
    c = F.col
    # whole hundredths, so that a half is exactly a half before rounding
    hundredths = c("structure") * 25 + c("security") * 25 + c("ci") * 15 + c("deps") * 20 + c("testing") * 15
    out = scored.withColumn("overall", F.bround(hundredths / F.lit(100).cast("decimal(5,0)")).cast("int"))
    for name in ("structure", "security", "ci", "deps", "testing", "overall"):
        out = out.withColumn(f"{name}_grade", grade(c(name)))
    return out


def hygiene_grade(n_issues: Column) -> Column:
    return F.when(n_issues == 0, "A").when(n_issues <= 2, "B").when(n_issues <= 5, "C").otherwise("D")


# ---- sections -----------------------------------------------------------------------
def section_split(contexts: DataFrame) -> DataFrame:
    """(section_no, content, words): the text in front of the first ``## `` is section 0."""
    parts = F.split(F.col("text"), "\n## ", -1)
    whole = F.when(F.col("section_no") == 0, F.col("part")).otherwise(F.concat(F.lit("## "), "part"))
    return (
        contexts.select(*DOC, F.posexplode(parts).alias("section_no", "part"))
        .select(*DOC, "section_no", whole.alias("content"))
        .withColumn("words", F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")))
    )


def headed_sections(contexts: DataFrame) -> DataFrame:
    """Level-2 headings with their body up to the next one: (title, heading_no, body).

    The text is cut at the headings inside the row, so no window over lines is needed.
    """
    heading = r"(?md)^##\s+(.+?)\s*$"
    titles = F.regexp_extract_all("text", F.lit(heading), F.lit(1))
    bodies = F.slice(F.split(F.col("text"), heading, -1), F.lit(2), F.greatest(F.size(titles), F.lit(1)))
    return contexts.select(
        *DOC, F.posexplode(F.arrays_zip(titles.alias("title"), bodies.alias("body"))).alias("heading_no", "s")
    ).select(*DOC, "heading_no", "s.title", "s.body")


# ---- fleet --------------------------------------------------------------------------
def fleet_summary(report: DataFrame, score: str = "score") -> DataFrame:
    return report.agg(
        F.count("*").alias("documents"), F.avg(score).alias("mean_score"),
        F.count_if(F.col(score) < 70).alias("below_70"),
    )


# ---- line difference ----------------------------------------------------------------
def line_difference(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lines that only one of two document versions has, with multiplicity.

    Lines of both versions are counted in one aggregate, old ones negatively, so that a line is
    shuffled once and no join is needed.
    """
    keys = keys or DOC

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return explode_lines(df.select(*keys, "text"), *keys).select(*keys, "line", F.lit(sign).cast("bigint").alias("sign"))

    delta = F.col("delta")
    counted = signed(old, -1).unionByName(signed(new, 1)).groupBy(*keys, "line").agg(F.sum("sign").alias("delta"))
    return counted.filter(delta != 0).select(
        *keys, "line", F.when(delta > 0, "added").otherwise("removed").alias("change"), F.abs(delta).alias("times")
    )

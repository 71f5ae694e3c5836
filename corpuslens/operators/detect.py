"""Leak, debt and hygiene detectors over all files of all projects.

Findings table: (project, path, line, category, severity, message). Text detectors are one
narrow projection per pack: the text is read once, rules run inside the row, and only
findings are exploded. Project checks aggregate booleans over paths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.rules import Rule, finding, first_match, kept, no_findings
from corpuslens.functions.scores import clamp, severity_weight
from corpuslens.functions.text import (
    first_chars,
    last_segment, line_total, matches_with_line, newline_count, path_key, split_lines, strip,
    suffix, without_final_break,
)
from corpuslens.operators import inventory as inv
from corpuslens.session import cut_lineage

FINDING_COLUMNS = ["project", "path", "line", "category", "severity", "message"]
PROJECT_PATH = "<project>"


# ---- packs over lines ----------------------------------------------------------------
@dataclass(frozen=True)
class LinePack:
    """Rules that run on single lines.

    ``needles`` are lower-case literals of which a line must hold at least one before a rule
    can match: plain substring searches that spare clean lines and clean files every regex.
    ``only`` restricts the pack to some files.
    """

    find: Callable[[Column, Column], Column]
    needles: tuple[str, ...]
    only: Column | None = None

    def near(self, low: Column) -> Column:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in self.needles])
        return hit if self.only is None else self.only & hit


def line_findings(text: Column, packs: Sequence[LinePack]) -> Column:
    """Findings of every pack on every line, as one array. The text is split once, and only
    when some pack may match somewhere."""
    numbered = F.transform(
        split_lines(without_final_break(text)),
        lambda l, i: F.struct((i + 1).alias("n"), l.alias("l"), F.lower(l).alias("low")),
    )
    words = tuple(dict.fromkeys(w for p in packs for w in p.needles))
    anywhere = LinePack(packs[0].find, words)
    hits = F.filter(numbered, lambda x: anywhere.near(x["low"]))
    found = F.flatten(
        F.transform(
            hits, lambda x: kept(*[F.when(p.near(x["low"]), p.find(x["l"], x["n"])) for p in packs])
        )
    )
    low = F.lower(text)
    return F.when(reduce(lambda a, b: a | b, [p.near(low) for p in packs]), found).otherwise(no_findings())


def marker_pack(only: Column | None = None, chars: int | None = 120) -> LinePack:
    """Debt markers, first marker per line; a message holds the first ``chars`` of the line (None: all)."""
    def find(line: Column, n: Column) -> Column:
        bare = first_chars(strip(line), chars)
        return first_match(line, n, [
            Rule(rx, "debt_markers", sev, F.concat(F.lit(f"{label}: "), bare))
            for rx, label, sev in fixed.DEBT_MARKERS
        ])

    return LinePack(find, tuple(label.lower() for _, label, _ in fixed.DEBT_MARKERS), only)


def quoted_secret_pack(only: Column | None = None) -> LinePack:
    rules = [
        Rule(rx, "security", "critical", "Potential hardcoded secret/credential")
        for rx in fixed.QUOTED_SECRETS
    ]
    return LinePack(lambda line, n: first_match(line, n, rules), fixed.QUOTED_SECRET_WORDS, only)


def home_path_pack(only: Column | None = None, chars: int | None = 80) -> LinePack:
    """Paths of home folders; a message holds the first ``chars`` of the line (None: all)."""
    def find(line: Column, n: Column) -> Column:
        message = F.concat(F.lit("Local filesystem path exposed: "), first_chars(strip(line), chars))
        return first_match(line, n, [Rule(fixed.HOME_PATH, "local_paths", "high", message)])

    return LinePack(find, ("/home/", "/users/", "c:\\users\\"), only)


def suppressed_key_line(line: Column) -> Column:
    """Comment, search-command and placeholder lines."""
    bare = strip(line)
    return (
        F.startswith(bare, F.lit("#")) | F.startswith(bare, F.lit("//"))
        | F.contains(F.lower(bare), F.lit("grep")) | F.contains(bare, F.lit("rg "))
        | line.rlike(fixed.PLACEHOLDER)
    )


def vendor_key_pack(only: Column | None = None) -> LinePack:
    rules = [
        Rule(rx, "secrets", "critical", f"Possible {label} detected")
        for rx, label in fixed.VENDOR_KEYS
    ]
    return LinePack(
        lambda line, n: F.when(~suppressed_key_line(line), first_match(line, n, rules)),
        ("sk-", "ghp_", "gho_", "akia", "xai-", "xoxb-", "xoxp-"), only,
    )


def literal_pack(pattern: str, severity: str, message: str, needles: tuple[str, ...], only: Column) -> LinePack:
    def find(line: Column, n: Column) -> Column:
        hit = first_match(line, n, [Rule(pattern, "credentials", severity, message)])
        return F.when(~line.rlike(fixed.PLACEHOLDER), hit)

    return LinePack(find, needles, only)


def custom_pack(rules: Sequence[Rule], needles: tuple[str, ...], only: Column | None = None) -> LinePack:
    """A user's own ordered rules."""
    return LinePack(lambda line, n: first_match(line, n, list(rules)), needles, only)


# ---- leak detectors ------------------------------------------------------------------
def leak_packs(scan_scripts: bool = False, chars: int | None = 80) -> dict[str, LinePack]:
    """The leak detectors over lines. Vendor keys are not looked for in files whose opening names a secret
    scanner, unless ``scan_scripts``; ``chars`` of a line go into the message of a home path (None: all)."""
    scannable, sample = F.col("_scannable"), F.col("_sample")
    usable = scannable & ~sample
    return {
        "home": home_path_pack(scannable, chars),
        "vendor": vendor_key_pack(usable if scan_scripts else usable & ~F.col("_script")),
        "password": literal_pack(
            fixed.PASSWORD_LITERAL, "high", "Hardcoded password or secret value",
            ("password", "passwd", "pwd", "secret"), usable),
        "database": literal_pack(
            fixed.DB_URL, "critical", "Database connection string with embedded credentials",
            ("postgres://", "mysql://", "mongodb://", "redis://"), usable),
    }


def _may_define() -> Column:
    """Files whose functions are measured and that hold a word of a definition: others spare the split into lines."""
    text, ext = F.col("text"), suffix("path")
    held = lambda *words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return ~inv.is_test_path() & (
        ext.isin(*fixed.PY_EXTS) & held("def") | ext.isin(*fixed.JS_EXTS) & held("function", "const", "let") | (ext == ".rs") & held("fn"))


def text_findings(files: DataFrame, packs: Sequence[LinePack], *per_file: Column) -> DataFrame:
    """One pass over the texts: line packs plus arrays of findings per file, then only the
    findings are exploded. File flags are available as ``_scannable``, ``_sample``,
    ``_script``, ``_ext``, ``_lang``, ``_test`` and ``_lines`` (0 where no function is defined)."""
    rows = files.filter(F.col("text").isNotNull()).select(
        "project", "path", "text", suffix("path").alias("_ext"), inv.is_test_path().alias("_test"),
        inv.is_sample_path().alias("_sample"), inv.is_scan_script().alias("_script"),
        inv.is_leak_scannable().alias("_scannable"), F.when(_may_define(), line_total("text")).otherwise(0).alias("_lines"),
        inv.language_of(suffix("path")).alias("_lang"),
    )
    parts = list(per_file)
    if packs:
        parts.append(line_findings(F.col("text"), packs))
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    return rows.select("project", "path", F.inline(every))


def private_key_finding() -> Column:
    found = finding(None, "secrets", "critical", "Private key material found in tracked file")
    near = F.contains(F.col("text"), F.lit("PRIVATE KEY-----"))
    return kept(F.when(F.col("_scannable") & near, F.when(F.col("text").rlike(fixed.PRIVATE_KEY), found)))


def leak_text_findings(files: DataFrame, extra: Sequence[LinePack] = ()) -> DataFrame:
    """Home paths, vendor keys, private keys, password literals and database URLs; ``extra``
    packs run in the same pass."""
    return text_findings(files, [*leak_packs().values(), *extra], private_key_finding())


def leak_path_findings(files: DataFrame) -> DataFrame:
    """Strategy documents and tracked .env files; reads paths only."""
    name = last_segment("path")
    strategy = F.when(
        F.lower(name).isin(*fixed.STRATEGY_FILES),
        finding(None, "strategy_docs", "high",
                F.concat(F.lit("Strategy/outreach document tracked: "), name)),
    )
    env = F.when(
        F.col("path").rlike(fixed.REAL_ENV),
        finding(None, "credentials", "critical", "Real .env file tracked (should be in .gitignore)"),
    )
    return (
        files.select("project", "path").select("project", "path", F.inline(kept(strategy, env)))
        .select(*FINDING_COLUMNS)
    )


def interview_findings(files: DataFrame) -> DataFrame:
    """At most one per project: the first path, by segments, that looks like an interview task."""
    hits = files.select("project", "path").filter(F.lower("path").rlike(fixed.INTERVIEW))
    first = hits.groupBy("project").agg(F.min(path_key("path")).alias("_k"))
    return first.select(
        "project", F.translate("_k", "\x01", "/").alias("path"),
        F.lit(None).cast("int").alias("line"), F.lit("strategy_docs").alias("category"),
        F.lit("low").alias("severity"),
        F.lit("Possible interview artifact (consider if repo should be private)").alias("message"),
    )


def leak_findings(
    files: DataFrame, extra: Sequence[LinePack] = (), names: DataFrame | None = None
) -> DataFrame:
    """All leak detectors. ``names(project, path)`` serves the path checks where the caller has
    a listing that is cheaper to read than ``files``."""
    names = files if names is None else names
    return (
        leak_text_findings(files, extra)
        .unionByName(leak_path_findings(names))
        .unionByName(interview_findings(names))
    )


# ---- debt detectors ------------------------------------------------------------------
def _at_matches(text: Column, word: str, pattern: str, category: str, severity: str, message: str) -> Column:
    """One finding per match of a multi-line pattern; texts without ``word`` cost one search."""
    hits = F.transform(
        matches_with_line(text, pattern, groups=()),
        lambda m: finding(m["line"], category, severity, message),
    )
    return F.when(F.contains(text, F.lit(word)), hits).otherwise(no_findings())


def long_functions(text: Column, pattern: str, name_groups: tuple[int, ...], lines: Column) -> Column:
    """Functions over the length limit.

    A function ends where the next definition starts if that one is not deeper, else at the
    end of the file.
    """
    defs = F.transform(
        matches_with_line(text, pattern, groups=(1, *name_groups)),
        lambda m: F.struct(
            m["line"].alias("line"), F.length(m["g1"]).alias("indent"),
            F.coalesce(
                *[F.nullif(m[f"g{g}"], F.lit("")) for g in name_groups], F.lit("anonymous")
            ).alias("name"),
        ),
    )
    none = F.lit(None).cast("struct<line:int,indent:int,name:string>")
    following = F.concat(F.slice(defs, 2, F.greatest(F.size(defs), F.lit(1))), F.array(none))
    sized = F.zip_with(
        defs, following,
        lambda d, n: F.struct(
            d["line"].alias("line"), d["name"].alias("name"),
            (F.when(n["indent"] <= d["indent"], n["line"] - 1).otherwise(lines) - (d["line"] - 1))
            .alias("length"),
        ),
    )
    limit = fixed.LONG_FUNCTION_LINES
    return F.transform(
        F.filter(sized, lambda s: s["length"] > limit),
        lambda s: finding(
            s["line"], "complexity", "medium",
            F.concat(F.lit("Function `"), s["name"], F.lit("` is "), s["length"].cast("string"),
                     F.lit(f" lines (>{limit})")),
        ),
    )


def deepest_line(text: Column) -> Column:
    """(level, line) of the first line at the largest indentation; tabs stop every 4 columns."""
    def level(line: Column) -> Column:
        lead = F.regexp_extract(line, r"^[ \t]*(?=\S)", 0)
        return F.floor(F.length(F.regexp_replace(lead, r" {4}| {0,3}\t", "    ")) / 4).cast("int")

    ranked = F.transform(
        split_lines(without_final_break(text)),
        lambda l, i: F.struct(level(l).alias("level"), (-(i + 1)).alias("neg_line")),
    )
    best = F.array_max(ranked)
    return F.struct(best["level"].alias("level"), (-best["neg_line"]).alias("line"))


def nesting_finding(text: Column) -> Column:
    limit = fixed.DEEP_NESTING
    best = deepest_line(text)
    hit = F.when(
        best["level"] >= limit,
        finding(best["line"], "complexity", "medium",
                F.concat(F.lit("Deep nesting: "), best["level"].cast("string"), F.lit(f" levels (>={limit})"))),
    )
    # a line can only be that deep behind this many leading columns
    return F.when(text.rlike(r"(?m)^(?: {0,3}\t| {4}){%d}" % limit), hit)


def error_handling_findings() -> Column:
    text, m = F.col("text"), "(?md)"
    both = F.concat(
        _at_matches(text, "except", m + fixed.BARE_EXCEPT, "error_handling", "high",
                    "Bare `except:` catches all exceptions including SystemExit/KeyboardInterrupt"),
        _at_matches(text, "except", m + fixed.BROAD_EXCEPT, "error_handling", "medium",
                    "Broad `except Exception` — consider catching specific exceptions"),
    )
    return F.when(~F.col("_test") & F.col("_ext").isin(*fixed.PY_EXTS), both).otherwise(no_findings())


def debug_output_findings() -> Column:
    text, m, ext = F.col("text"), "(?md)", F.col("_ext")
    py = _at_matches(text, "print", m + fixed.PRINT_CALL, "code_quality", "low",
                     "print() in production code — use logging module")
    js = _at_matches(text, "console.log", m + fixed.CONSOLE_LOG, "code_quality", "low",
                     "console.log() in production code")
    return (
        F.when(F.col("_test"), no_findings()).when(ext.isin(*fixed.PY_EXTS), py)
        .when(ext.isin(*fixed.JS_EXTS), js).otherwise(no_findings())
    )


def long_function_findings() -> Column:
    text, m, ext = F.col("text"), "(?md)", F.col("_ext")
    long_enough = ~F.col("_test") & (F.col("_lines") > fixed.LONG_FUNCTION_LINES)
    return (
        F.when(~long_enough, no_findings())
        .when(ext.isin(*fixed.PY_EXTS), long_functions(text, m + fixed.PY_DEF, (2,), F.col("_lines")))
        .when(ext.isin(*fixed.JS_EXTS), long_functions(text, m + fixed.JS_DEF, (2, 3), F.col("_lines")))
        .when(ext == ".rs", long_functions(text, m + fixed.RS_DEF, (2,), F.col("_lines")))
        .otherwise(no_findings())
    )


def deep_nesting_findings() -> Column:
    use = ~F.col("_test") & F.col("_lang").isNotNull()
    return F.when(use, kept(nesting_finding(F.col("text")))).otherwise(no_findings())


def debt_packs() -> dict[str, LinePack]:
    source = F.col("_lang").isNotNull()
    return {"markers": marker_pack(source), "secrets": quoted_secret_pack(source)}


def long_file_finding(count: Column) -> Column:
    limit = fixed.LONG_FILE_LINES
    return F.when(
        count > limit,
        finding(None, "complexity", "high",
                F.concat(F.lit("God file: "), count.cast("string"), F.lit(f" lines (>{limit})"))),
    )


def debt_text_findings(files: DataFrame, *more: Column) -> DataFrame:
    """Markers, quoted secrets, error handling, debug output, long functions, deep nesting.

    The first two also run on test files, the others do not. ``more`` are further findings per
    file for the same pass.
    """
    return text_findings(
        files, list(debt_packs().values()), error_handling_findings(), debug_output_findings(),
        long_function_findings(), deep_nesting_findings(), *more,
    )


def long_file_findings(files: DataFrame) -> DataFrame:
    """Files over the line limit. Uses ``newline_count`` when the table has it, so the text is
    not read; otherwise counts newlines."""
    count = F.col("newline_count") if "newline_count" in files.columns else newline_count("text")
    rows = files.filter(inv.language_of(suffix("path")).isNotNull())
    return rows.select("project", "path", count.alias("_n")).select(
        "project", "path", F.inline(kept(long_file_finding(F.col("_n")))))


def hygiene_findings(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Missing tests, CI, linter config and .gitignore.

    Path flags are one aggregation that reads no text; texts are read of pyproject files only.
    """
    names = files if names is None else names
    name = last_segment("path")
    lint_table = F.lit(False)
    for needle in fixed.LINTER_TABLES:
        lint_table = lint_table | F.contains(F.col("text"), F.lit(needle))
    ci = F.lit(False)
    for part in fixed.CI_PATH_PARTS:
        ci = ci | F.contains(F.col("path"), F.lit(part))
    flags = names.groupBy("project").agg(
        F.count("*").alias("n"),
        F.bool_or(inv.is_test_path()).alias("tests"),
        F.bool_or(ci).alias("ci"),
        F.bool_or(name.isin(*fixed.LINTER_FILES)).alias("_lint_file"),
        F.bool_or(name == ".gitignore").alias("ignore"),
    )
    tables = (
        files.filter(F.endswith("path", F.lit("pyproject.toml")) & (name == "pyproject.toml"))
        .groupBy("project").agg(F.bool_or(lint_table).alias("_lint_table"))
    )
    facts = flags.join(tables, "project", "left").withColumn(
        "linter", F.col("_lint_file") | F.coalesce("_lint_table", F.lit(False)))
    checks = kept(
        F.when(~F.col("tests") & (F.col("n") > 5),
               finding(None, "testing", "critical", "No test directory or test files found")),
        F.when(~F.col("ci") & (F.col("n") > 10),
               finding(None, "infrastructure", "medium", "No CI/CD configuration found")),
        F.when(~F.col("linter") & (F.col("n") > 5),
               finding(None, "infrastructure", "medium", "No linter configuration found")),
        F.when(~F.col("ignore") & (F.col("n") > 3),
               finding(None, "infrastructure", "low", "No .gitignore file")),
    )
    return (
        facts.select("project", F.lit(PROJECT_PATH).alias("path"), F.inline(checks))
        .select(*FINDING_COLUMNS)
    )


def debt_findings(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All debt detectors. Long files are found from ``newline_count`` where the table has it and
    in the text pass otherwise."""
    hygiene = hygiene_findings(files, names)
    if "newline_count" in files.columns:
        return hygiene.unionByName(long_file_findings(files)).unionByName(debt_text_findings(files))
    counted = F.when(F.col("_lang").isNotNull(), kept(long_file_finding(newline_count("text"))))
    return hygiene.unionByName(debt_text_findings(files, F.coalesce(counted, no_findings())))


# ---- registry of detectors -----------------------------------------------------------
Detector = Callable[[DataFrame], DataFrame]
_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, fn: Detector) -> None:
    """Adds a detector ``files -> findings``; the result must have the findings columns."""
    _DETECTORS[name] = fn


def run_detectors(files: DataFrame, *names: str) -> DataFrame:
    """Union of the named detectors (all of them by default), with the detector's name."""
    out = None
    for name in names or tuple(_DETECTORS):
        part = _DETECTORS[name](files).select(F.lit(name).alias("detector"), *FINDING_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


register_detector("leaks", leak_findings)
register_detector("debt", debt_findings)


# ---- summaries -----------------------------------------------------------------------
def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by category, by severity and overall, per project, in one grouping-sets pass over
    the pre-aggregated counts."""
    small = findings.groupBy("project", "category", "severity").agg(F.count("*").alias("n"))
    p, c, s = F.col("project"), F.col("category"), F.col("severity")
    sets = small.groupingSets([[p, c], [p, s], [p]], p, c, s).agg(
        F.sum("n").alias("n_findings"), F.grouping_id().alias("_g")
    )
    return sets.select(
        "project",
        F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "severity").otherwise("all").alias("kind"),
        F.coalesce("category", "severity", F.lit("all")).alias("name"), "n_findings",
    )


def scored_projects(files: DataFrame, findings: DataFrame) -> DataFrame:
    """100 minus the severity weights, within 0..100; clean projects stay with 100.

    Both sides are aggregated per project first, so the join is one row per project.
    """
    severities = [
        F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in fixed.SEVERITY_WEIGHT
    ]
    sums = findings.groupBy("project").agg(
        F.sum(severity_weight("severity")).alias("_lost"), F.count("*").alias("n_findings"), *severities
    )
    zero = ["_lost", "n_findings", *[f"n_{s}" for s in fixed.SEVERITY_WEIGHT]]
    return (
        files.select("project").distinct().join(sums, "project", "left").fillna(0, zero)
        .withColumn("score", clamp(100 - F.col("_lost")).cast("int"))
        .drop("_lost")
    )


def worst_first(scores: DataFrame, n: int = 0, min_score: int = 0, score: str = "score") -> DataFrame:
    """Lowest score first, project name as tie-break; ``n`` > 0 limits the report."""
    out = scores.filter(F.col(score) >= min_score).orderBy(score, "project")
    return out.limit(n) if n else out


def priority_items(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` critical and high findings per project and how many more there are. The findings are
    written once: ranks and totals are two readings, and detectors behind them would read every text twice."""
    urgent = cut_lineage(findings.filter(F.col("severity").isin("critical", "high")), "urgent")
    order = Window.partitionBy("project").orderBy(
        path_key("path"), F.col("line").asc_nulls_first(), "category", "message"
    )
    top = urgent.withColumn("item", F.row_number().over(order)).filter(F.col("item") <= n)
    totals = urgent.groupBy("project").agg(F.count("*").alias("_all"))
    return (
        top.join(totals, "project")
        .withColumn("more", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")
    )


def categories_by_count(findings: DataFrame) -> DataFrame:
    """Category counts per project, largest first."""
    counts = findings.groupBy("project", "category").agg(F.count("*").alias("n_findings"))
    order = Window.partitionBy("project").orderBy(F.desc("n_findings"), "category")
    return counts.withColumn("rank", F.row_number().over(order))

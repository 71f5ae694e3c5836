"""Coding-style votes per project: counts inside the row, one partial aggregation, a vote."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.scores import vote
from corpuslens.functions.text import BLANKS, contains_any, explode_lines, suffix
from corpuslens.operators import inventory as inv

# ---- Fixed values: patterns counted per style --------------------------------------
SNAKE = (r"\bdef [a-z][a-z0-9_]+\(", r"\bfn [a-z][a-z0-9_]+\(")
CAMEL = (r"\bfunction [a-z][a-zA-Z0-9]+\(", r"\bconst [a-z][a-zA-Z0-9]+ =")
SINGLE_QUOTED = r"""(?<!["\\])'[^']*'"""
DOUBLE_QUOTED = r"""(?<!['\\])"[^"]*\""""
DEFS = r"\bdef [\p{L}\p{N}_]+\("
HINTS = (r"\bdef [\p{L}\p{N}_]+\([^)]*:[^)]*\)", r"-> [\p{L}\p{N}_]")
GOOGLE_DOC = r"(?md)^\s+(?:Args|Returns|Raises|Example):"
NUMPY_DOC = r"(?md)^\s+(?:Parameters|Returns)\s*\n\s+-+"
SPHINX_DOC = r"(?md)^\s+:param\s"
ABSOLUTE_IMPORT, RELATIVE_IMPORT = r"(?md)^from [a-zA-Z]", r"(?md)^from \."
PATHLIB, OS_PATH = (r"\bPath\(", r"from pathlib"), r"\bos\.path\."
TRAILING_COMMA, NO_TRAILING_COMMA = r",\s*[\]\)\}]", r"[^,\s]\s*[\]\)\}]"
TRY_BLOCK, CUSTOM_ERROR = r"\btry:", r"class [\p{L}\p{N}_]+(?:Error|Exception)\("
# one of these occurs in every match of the pattern: a text without them is not searched
HELD = {
    SNAKE[0]: ("def ",), SNAKE[1]: ("fn ",), CAMEL[0]: ("function ",), CAMEL[1]: ("const ",), SINGLE_QUOTED: ("'",),
    DOUBLE_QUOTED: ('"',), DEFS: ("def ",), HINTS[0]: ("def ",), HINTS[1]: ("-> ",),
    GOOGLE_DOC: ("Args:", "Returns:", "Raises:", "Example:"), NUMPY_DOC: ("Parameters", "Returns"), SPHINX_DOC: (":param",),
    ABSOLUTE_IMPORT: ("from ",), RELATIVE_IMPORT: ("from .",), PATHLIB[0]: ("Path(",), PATHLIB[1]: ("from pathlib",),
    OS_PATH: ("os.path.",), TRAILING_COMMA: ("]", ")", "}"), NO_TRAILING_COMMA: ("]", ")", "}"), TRY_BLOCK: ("try:",),
    CUSTOM_ERROR: ("Error(", "Exception("),
}


def _may_match(pattern: str) -> Column:
    return contains_any(F.col("text"), HELD[pattern])


def hits(*patterns: str) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.when(_may_match(p), F.regexp_count("text", F.lit(p))).otherwise(0)
    return out


def style_counts(files: DataFrame) -> DataFrame:
    """All counters of one project in one aggregation. ``_py``/``_js`` are language scopes."""
    ext = suffix("path")
    rows = files.select("project", "path", "text", ext.alias("_ext")).filter(
        inv.language_of(F.col("_ext")).isNotNull()
    )
    py, js = F.col("_ext").isin(*fixed.PY_EXTS), F.col("_ext").isin(*fixed.JS_EXTS)
    counted = rows.select(
        "project", py.alias("py"), js.alias("js"),
        hits(*SNAKE).alias("snake"), hits(*CAMEL).alias("camel"),
        F.when(py | js, hits(SINGLE_QUOTED)).alias("single"),
        F.when(py | js, hits(DOUBLE_QUOTED)).alias("double"),
        F.when(py, hits(DEFS)).alias("defs"), F.when(py, hits(*HINTS)).alias("hints"),
        F.when(py, hits(GOOGLE_DOC)).alias("google"), F.when(py, hits(NUMPY_DOC)).alias("numpy"),
        F.when(py, hits(SPHINX_DOC)).alias("sphinx"),
        F.when(py, hits(ABSOLUTE_IMPORT)).alias("absolute"),
        F.when(py, hits(RELATIVE_IMPORT)).alias("relative"),
        F.when(py, hits(*PATHLIB)).alias("pathlib"), F.when(py, hits(OS_PATH)).alias("ospath"),
        hits(TRAILING_COMMA).alias("comma"), hits(NO_TRAILING_COMMA).alias("no_comma"),
        hits(TRY_BLOCK).alias("tries"), (_may_match(CUSTOM_ERROR) & F.col("text").rlike(CUSTOM_ERROR)).alias("custom"),
    )

    def total(name: str, where: Column | None = None) -> Column:
        c = F.col(name) if where is None else F.when(where, F.col(name))
        return F.coalesce(F.sum(c), F.lit(0))

    scoped = [
        total(n, w).alias(f"{n}_{s}")
        for n in ("snake", "camel", "single", "double")
        for s, w in (("py", F.col("py")), ("js", F.col("js")), ("all", None))
    ]
    plain = [
        total(n).alias(n)
        for n in ("defs", "hints", "google", "numpy", "sphinx", "absolute", "relative", "pathlib",
                  "ospath", "comma", "no_comma", "tries")
    ]
    return counted.groupBy("project").agg(
        F.count("*").alias("n_files"), F.count_if("py").alias("n_py"), F.count_if("js").alias("n_js"),
        *scoped, *plain, F.bool_or("custom").alias("custom"),
    )


def style_votes(files: DataFrame) -> DataFrame:
    """Naming, quotes, type hints, docstrings, imports, paths, trailing commas, error handling."""
    counts = style_counts(files).join(
        inv.primary_language(inv.language_counts(files)), "project", "left"
    )
    c = F.col
    has_py, has_js = c("n_py") > 0, c("n_js") > 0
    use_py = c("primary_language").isin("Python", "Rust") & has_py
    use_js = c("primary_language").isin("TypeScript", "JavaScript") & has_js
    scope = lambda n: F.when(use_py, c(f"{n}_py")).when(use_js, c(f"{n}_js")).otherwise(c(f"{n}_all"))
    quote = lambda n: F.when(has_py, c(f"{n}_py")).otherwise(c(f"{n}_js"))
    ratio = c("hints") / F.greatest(c("defs"), F.lit(1))
    best = F.greatest("google", "numpy", "sphinx")
    alone = (
        (c("google") == best).cast("int") + (c("numpy") == best).cast("int") + (c("sphinx") == best).cast("int")
    ) == 1
    return counts.select(
        "project",
        vote(scope("snake"), scope("camel"), "snake_case", "camelCase").alias("naming"),
        vote(quote("double"), quote("single"), "double", "single", 1.5).alias("quote_style"),
        F.when(c("defs") == 0, "n/a").when(ratio > 0.5, "present").when(ratio > 0.1, "partial")
        .otherwise("absent").alias("type_hints"),
        F.when((best == 0) | ~alone, "none").when(c("google") == best, "google")
        .when(c("numpy") == best, "numpy").otherwise("sphinx").alias("docstrings"),
        F.when(~has_py, "n/a").otherwise(vote(c("absolute"), c("relative"), "absolute", "relative", 2.0))
        .alias("imports"),
        F.when(~has_py, "n/a").otherwise(vote(c("pathlib"), c("ospath"), "pathlib", "os.path"))
        .alias("path_api"),
        F.when(c("comma") > c("no_comma"), "yes").when(c("no_comma") > c("comma"), "no")
        .otherwise("mixed").alias("trailing_commas"),
        c("tries").alias("try_count"), c("custom").alias("custom_errors"),
        F.least(F.lit(1.0), c("n_files") / 50).alias("confidence"),
    )


def _any(test: Callable[[Column, Column], Column], name: str, *literals: str) -> Column:
    return reduce(or_, [test(F.col(name), F.lit(x)) for x in literals])


def _ends(name: str, *literals: str) -> Column:
    return _any(F.endswith, name, *literals)


def semicolon_votes(files: DataFrame) -> DataFrame:
    """JS/TS statement lines that end with a semicolon against those that do not."""
    rows = files.filter(suffix("path").isin(*fixed.JS_EXTS)).select("project", "path", "text")
    blank = _ends("line", *BLANKS)
    end = F.when(blank, F.rtrim("line", F.lit(BLANKS))).otherwise(F.col("line"))
    lines = explode_lines(rows, "project").select("project", end.alias("s")).filter(
        (F.col("s") != "") & ~_any(F.startswith, "s", "//", "/*", "*", "import", "export")
    )
    semi = _ends("s", ";")
    counts = lines.groupBy("project").agg(
        F.count_if(semi).alias("with_semi"),
        F.count_if(~semi & ~_ends("s", *"{}(),")).alias("without_semi"),
    )
    return (
        rows.select("project").distinct().join(counts, "project", "left").fillna(0)
        .withColumn("semicolons", vote(F.col("with_semi"), F.col("without_semi"), "required", "omitted", 2.0))
    )


def line_length_p95(files: DataFrame) -> DataFrame:
    """Element number ``int(n * 0.95)`` of the sorted line lengths, from counts per length.

    Lengths are counted with map-side partial sums; the window runs over distinct lengths, not
    over lines, so a huge project stays small.
    """
    rows = files.filter(inv.language_of(suffix("path")).isNotNull())
    counts = (
        explode_lines(rows, "project").groupBy("project", F.length("line").alias("len"))
        .agg(F.count("*").alias("n"))
    )
    upto = Window.partitionBy("project").orderBy("len")
    every = Window.partitionBy("project")
    ranked = counts.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    index = F.least(F.floor(F.col("total") * F.lit(0.95)), F.col("total") - 1)
    return (
        ranked.filter(F.col("cum") > index).groupBy("project")
        .agg(F.min("len").alias("line_length_p95"), F.first("total").alias("n_lines"))
    )

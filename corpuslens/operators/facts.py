"""Domain vocabulary mined from texts: class names, terms, routes, constants, marker comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.text import contains_any, first_chars, path_key, split_lines, strip, suffix, without_final_break
from corpuslens.operators import inventory as inv
from corpuslens.operators.ranking import ranged_rank

# ---- Fixed values: what is mined ----------------------------------------------------
CLASS_EXTS = (".py", ".ts", ".tsx", ".js", ".jsx", ".rs")
ROUTE_EXTS = (".py", ".ts", ".js")
ENUM_EXTS = (".py", ".ts", ".rs")
CLASS_NAME = r"\bclass\s+([\p{L}\p{N}_]+)"
STRUCT_NAME = r"\b(?:struct|enum)\s+([\p{L}\p{N}_]+)"
ROUTE = r"""(?:app|router)\.\s*(?:get|post|put|patch|delete)\s*\(\s*["']([^"']+)"""
CONSTANT = r"""([\p{L}\p{N}_]+)\s*=\s*(?:auto\(\)|['"])"""
# the same matches, found without trying every letter of a word as their start
CONSTANT_BY_WORD = r"""(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)\s*+=\s*+(?:auto\(\)|['"])"""
ENUM_NAME = r"\benum\s+([\p{L}\p{N}_]+)"
ACRONYM = r"\b([A-Z]{2,})\b"
PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
COMMON_ACRONYMS = ("README", "TODO", "NOTE", "API", "URL", "HTTP", "CLI")
README_NAMES = ("README.md", "README.rst", "README.txt", "README")
BODY_CHARS = 100
COMMENT_MARKERS = (
    r"(?d)#\s*(TODO|FIXME|HACK|NOTE|XXX)[\s:]+(.+)",
    r"(?d)//\s*(TODO|FIXME|HACK|NOTE|XXX)[\s:]+(.+)",
)


# one of these occurs in every match of the pattern: a text without them is not searched
HELD = {
    CLASS_NAME: ("class",), STRUCT_NAME: ("struct", "enum"), ROUTE: ("app.", "router."), CONSTANT_BY_WORD: ("=",),
    ENUM_NAME: ("enum",), **{p: ("TODO", "FIXME", "HACK", "NOTE", "XXX") for p in COMMENT_MARKERS},
}


def _all(pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    if pattern not in HELD:
        return found
    return F.when(contains_any(F.col("text"), HELD[pattern]), found).otherwise(F.array().cast("array<string>"))


def alphabetical_top(terms: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct terms per project with their position by name; ``n`` keeps the first of a display."""
    if n is None:
        return ranged_rank(terms.distinct(), ["project"], ["term"], "position")
    order = Window.partitionBy("project").orderBy("term")
    return terms.distinct().withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def class_terms() -> Column:
    names = F.concat(
        F.filter(_all(CLASS_NAME), lambda x: ~F.startswith(x, F.lit("_"))), _all(STRUCT_NAME)
    )
    return F.filter(F.array_distinct(names), lambda x: F.length(x) > 2)


def class_names(files: DataFrame, n: int | None = None) -> DataFrame:
    rows = files.filter(suffix("path").isin(*CLASS_EXTS))
    return alphabetical_top(rows.select("project", F.explode(class_terms()).alias("term")), n)


def first_readme(files: DataFrame) -> DataFrame:
    """(project, text) of the first README by name order at the top of the project."""
    rank = F.array_position(F.array(*[F.lit(x) for x in README_NAMES]), F.col("path"))
    return (
        files.filter(F.col("path").isin(*README_NAMES))
        .groupBy("project").agg(F.min_by("text", rank).alias("text"))
    )


def readme_terms(files: DataFrame, n: int | None = None) -> DataFrame:
    acronyms = F.filter(_all(ACRONYM), lambda x: ~x.isin(*COMMON_ACRONYMS))
    phrases = F.transform(_all(PHRASE), lambda x: F.regexp_replace(x, r"\s+", " "))
    terms = first_readme(files).select("project", F.explode(F.concat(acronyms, phrases)).alias("term"))
    return alphabetical_top(terms, n)


def route_paths(files: DataFrame, n: int | None = None) -> DataFrame:
    rows = files.filter(suffix("path").isin(*ROUTE_EXTS))
    return alphabetical_top(rows.select("project", F.explode(_all(ROUTE)).alias("term")), n)


def enum_variants(text: Column) -> Column:
    """Capitalised names at the start of indented lines inside ``enum`` blocks."""
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, line: Column) -> Column:
        opens = line.rlike(r"^enum\s+[\p{L}\p{N}_]+")
        word = F.regexp_extract(line, r"^\s+([\p{L}\p{N}_]+)", 1)
        add = acc["inside"] & ~opens & word.rlike(r"^[A-Z]")
        return F.struct(
            F.when(opens, F.lit(True)).when(acc["inside"] & F.contains(line, F.lit("}")), F.lit(False))
            .otherwise(acc["inside"]).alias("inside"),
            F.when(add, F.concat(acc["names"], F.array(word))).otherwise(acc["names"]).alias("names"),
        )

    found = F.aggregate(split_lines(without_final_break(text)), state, step, lambda acc: acc["names"])
    return F.when(F.contains(text, F.lit("enum")) & text.rlike(r"(?md)^enum\s"), found).otherwise(F.array().cast("array<string>"))


def constant_terms() -> Column:
    constants = F.filter(
        _all(CONSTANT_BY_WORD), lambda x: (x == F.upper(x)) & x.rlike("[A-Z]") & (F.length(x) > 2)
    )
    return F.array_distinct(F.concat(constants, _all(ENUM_NAME), enum_variants(F.col("text"))))


def constant_names(files: DataFrame, n: int | None = None) -> DataFrame:
    rows = files.filter(suffix("path").isin(*ENUM_EXTS))
    return alphabetical_top(rows.select("project", F.explode(constant_terms()).alias("term")), n)


def vocabulary(files: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Class names, routes and constants in one pass over the texts: (project, kind, term,
    position), the first ``limits[kind]`` by name."""
    ext = F.col("_ext")
    sources = {"class": (CLASS_EXTS, class_terms()), "route": (ROUTE_EXTS, _all(ROUTE)), "constant": (ENUM_EXTS, constant_terms())}
    none = F.array().cast("array<string>")

    def tag(kind: str):
        return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))

    tagged = [
        F.transform(F.when(ext.isin(*exts), terms).otherwise(none), tag(kind))
        for kind, (exts, terms) in sources.items()
    ]
    rows = files.withColumn("_ext", suffix("path")).filter(ext.isin(*CLASS_EXTS))
    terms = rows.select("project", F.inline(F.concat(*tagged))).distinct()
    order = Window.partitionBy("project", "kind").orderBy("term")
    limit = F.lit(0)
    for kind, n in limits.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    top = max(limits.values())
    return (
        terms.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top).filter(F.col("position") <= limit)
    )


def marker_comments(files: DataFrame, n: int | None = None, body_chars: int | None = BODY_CHARS) -> DataFrame:
    """Marker comments with type, text (its first ``body_chars``, None: all) and file: ``#`` comments of a file
    first, then ``//``. ``n`` keeps the first of a display."""
    rows = files.filter(inv.language_of(suffix("path")).isNotNull())

    def found(i: int, pattern: str) -> Column:
        pairs = F.arrays_zip(_all(pattern, 1).alias("kind"), _all(pattern, 2).alias("body"))
        return F.transform(
            pairs,
            lambda p, j: F.struct(
                F.lit(i).alias("pass_no"), j.alias("at"), p["kind"].alias("kind"),
                first_chars(strip(p["body"]), body_chars).alias("body"),
            ),
        )

    every = F.concat(*[found(i, p) for i, p in enumerate(COMMENT_MARKERS)])
    comments = rows.select("project", "path", F.inline(every)).withColumn("_key", path_key("path"))
    order = ["_key", "pass_no", "at"]
    if n is None:
        kept = ranged_rank(comments, ["project"], order, "position")
    else:
        position = F.row_number().over(Window.partitionBy("project").orderBy(*order))
        kept = comments.withColumn("position", position).filter(F.col("position") <= n)
    return kept.select("project", "position", "kind", "body", "path")

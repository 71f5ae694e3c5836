"""File inventory: attributes, filters, language and directory facts per project.

Input: ``files(project, path, text)``. Filters and flags are narrow columns; only the
per-project facts aggregate, on few small columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.rules import any_of
from corpuslens.functions.text import (
    first_chars,
    glob_regex, last_segment, newline_count, parent_dirs, path_key, suffix,
)
from corpuslens.operators.ranking import ranged_rank


def language_of(ext: Column) -> Column:
    """Language of a lower-cased extension; null when unknown. A literal map, no join."""
    pairs = [F.lit(x) for item in fixed.LANGUAGE_OF_EXT.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), ext)


def with_file_facts(files: DataFrame) -> DataFrame:
    """Adds ext, lang, size_bytes, is_binary, newline_count."""
    head = F.substring(F.encode("text", "UTF-8"), 1, 8192)
    is_binary = F.contains(head, F.lit(bytearray(b"\x00")))
    return (
        files.withColumn("ext", suffix("path"))
        .withColumn("lang", language_of(F.col("ext")))
        .withColumn("size_bytes", F.octet_length("text").cast("bigint"))
        .withColumn("is_binary", is_binary)
        .withColumn(
            "newline_count", F.when(~F.col("is_binary"), newline_count("text")).cast("bigint")
        )
    )


def is_excluded(path: Column | str = "path", globs=fixed.EXCLUDE_GLOBS) -> Column:
    """True when any segment of the path matches one of the globs."""
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(glob_regex(tuple(globs)))


def drop_excluded(files: DataFrame, globs=fixed.EXCLUDE_GLOBS) -> DataFrame:
    return files.filter(~is_excluded("path", globs))


def drop_oversize(files: DataFrame, max_kb: int = 500) -> DataFrame:
    """Keeps files of at most ``max_kb`` KB."""
    return files.filter(F.octet_length("text") <= max_kb * 1024)


def first_files(files: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` files of each project in walk order (optional; off in every job).

    ``row_number <= cap`` lets Spark cut each group before the shuffle, so one huge project
    moves at most ``cap`` rows per input partition.
    """
    order = Window.partitionBy("project").orderBy(path_key("path"))
    return files.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def files_in_walk_order(files: DataFrame) -> DataFrame:
    """All files of each project with their rank in walk order; no project is ranked by one task."""
    return ranged_rank(files.select("project", "path", path_key("path").alias("_key")), ["project"], ["_key"], "rank").drop("_key")



def under_roots(path: Column | str = "path", roots=fixed.SOURCE_ROOTS) -> Column:
    """True below (or at) one of the source roots."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for root in roots:
        clean = root.strip("/").replace("\\", "/")
        if clean:
            out = out | (path == clean) | F.startswith(path, F.lit(clean + "/"))
    return out


def is_test_path(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    # fixed values: folder names, name prefix and name endings of test files
    return F.lower(path).rlike(
        any_of((
            r"(^|/)tests?(/|$)", r"_test\.py$", r"(^|/)test_[^/]*$",
            r"\.test\.(ts|tsx|js)$", r"\.spec\.(ts|js)$",
        ))
    )


def is_leak_scannable(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    known = tuple(fixed.LANGUAGE_OF_EXT) + fixed.LEAK_EXTRA_EXTS
    return suffix(path).isin(*known) | F.startswith(last_segment(path), F.lit(".env"))


def is_scan_script(text: Column | str = "text", chars: int | None = fixed.SCAN_SCRIPT_CHARS) -> Column:
    """Files whose opening (None: whole text) names a secret scanner."""
    text = F.col(text) if isinstance(text, str) else text
    head = F.lower(first_chars(text, chars))
    return head.rlike(fixed.SCAN_SCRIPT)


def is_sample_path(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.contains(path, F.lit(".example")) | F.contains(path, F.lit(".sample"))


def language_counts(files: DataFrame) -> DataFrame:
    """(project, lang, n_files, first_key) for known languages."""
    return (
        files.select("project", "path", language_of(suffix("path")).alias("lang"))
        .filter(F.col("lang").isNotNull())
        .groupBy("project", "lang")
        .agg(F.count("*").alias("n_files"), F.min(path_key("path")).alias("first_key"))
    )


def primary_language(counts: DataFrame) -> DataFrame:
    """Most files wins; config languages never do; ties go to the earliest path."""
    return (
        counts.filter(~F.col("lang").isin(*fixed.CONFIG_LANGUAGES))
        .groupBy("project")
        .agg(F.min_by("lang", F.struct(-F.col("n_files"), F.col("first_key"))).alias("primary_language"))
    )


def top_languages(counts: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("project").orderBy(F.desc("n_files"), "first_key")
    return (
        counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        .select("project", "rank", "lang", "n_files")
    )


def project_totals(files: DataFrame) -> DataFrame:
    """(project, total_files, total_lines, n_languages, total_bytes)."""
    return (
        with_file_facts(files).groupBy("project").agg(
            F.count("*").alias("total_files"),
            F.sum("newline_count").alias("total_lines"),
            F.count_distinct("lang").alias("n_languages"),
            F.sum("size_bytes").alias("total_bytes"),
        )
    )


def project_facts(files: DataFrame) -> DataFrame:
    """Totals plus primary language and the language list, one row per project."""
    counts = language_counts(files)
    langs = counts.groupBy("project").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("n_files")).alias("o"), "first_key", "lang", "n_files"))
        ).alias("_langs")
    )
    return (
        project_totals(files)
        .join(primary_language(counts), "project", "left")
        .join(langs, "project", "left")
        .withColumn("languages", F.transform("_langs", lambda s: s["lang"]))
        .withColumn(
            "language_json",
            F.to_json(F.map_from_entries(F.transform("_langs", lambda s: F.struct(s["lang"], s["n_files"])))),
        )
        .drop("_langs")
    )


def directories(files: DataFrame) -> DataFrame:
    """Every directory that holds a file, directly or below: distinct (project, path)."""
    return files.select("project", F.explode(parent_dirs("path")).alias("path")).distinct()


def known_paths(files: DataFrame) -> DataFrame:
    """File paths and directories of every project, distinct."""
    every = F.concat(F.array("path"), parent_dirs("path"))
    return files.select("project", F.explode(every).alias("path")).distinct()


def directory_tree(files: DataFrame, shown: int = 10) -> DataFrame:
    """Two-level tree: top directories with up to ``shown`` children and the number left out,
    and top-level files without runtime artifacts. Rows: (project, name, kind, children, more)."""
    parts = F.split("path", "/")
    dirs = directories(files).withColumn("parts", parts)
    second = (
        dirs.filter(F.size("parts") == 2)
        .select("project", F.col("parts")[0].alias("name"), F.col("parts")[1].alias("child"))
    )
    order = Window.partitionBy("project", "name").orderBy("child")
    counted = second.groupBy("project", "name").agg(F.count("*").alias("n_children"))
    listed = (
        second.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= shown)
        .groupBy("project", "name")
        .agg(F.array_join(F.array_sort(F.collect_list("child")), ",").alias("children"))
    )
    tops = dirs.filter(F.size("parts") == 1).select("project", F.col("path").alias("name"))
    folder_rows = (
        tops.join(listed, ["project", "name"], "left").join(counted, ["project", "name"], "left")
        .select(
            "project", "name", F.lit("dir").alias("kind"),
            F.coalesce("children", F.lit("")).alias("children"),
            F.greatest(F.coalesce("n_children", F.lit(0)) - shown, F.lit(0)).cast("bigint").alias("more"),
        )
    )
    hidden = glob_regex(fixed.TREE_HIDDEN_GLOBS, anywhere=False)
    file_rows = (
        files.filter(~F.contains("path", F.lit("/")) & ~F.col("path").rlike(hidden))
        .select("project", F.col("path").alias("name")).distinct()
        .select("project", "name", F.lit("file").alias("kind"), F.lit("").alias("children"),
                F.lit(0).cast("bigint").alias("more"))
    )
    return folder_rows.unionByName(file_rows)


def component_list(files: DataFrame, max_depth: int = 3, max_entries: int = 100) -> DataFrame:
    """Entries in walk order (folders before files on each level) down to ``max_depth`` levels
    below the top, hidden names and ``node_modules`` left out, first ``max_entries`` per project.

    The sort key marks every segment as folder (0) or file (1), so that one window gives the
    order a recursive walk has.
    """
    shown = ~F.col("path").rlike(r"(^|/)(\.[^/]*|node_modules)(/|$)")
    folder = directories(files).select("project", "path", F.lit(True).alias("is_dir"))
    plain = files.select("project", "path", F.lit(False).alias("is_dir")).distinct()
    rows = folder.unionByName(plain).filter(shown & (F.size(F.split("path", "/")) <= max_depth + 1))
    parts = F.split("path", "/")
    key = F.concat(
        F.array_join(
            F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.concat(F.lit("\x010"), s)), ""
        ),
        F.when(F.col("is_dir"), "\x010").otherwise("\x011"),
        last_segment("path"),
    )
    order = Window.partitionBy("project").orderBy("_key")
    return (
        rows.withColumn("_key", key).withColumn("entry_no", F.row_number().over(order))
        .filter(F.col("entry_no") <= max_entries)
        .select(
            "project", "entry_no", (F.size(parts) - 1).alias("depth"),
            F.concat(last_segment("path"), F.when(F.col("is_dir"), "/").otherwise("")).alias("entry"),
        )
    )


def project_skills(files: DataFrame) -> DataFrame:
    """Skills kept inside a project: Markdown files and SKILL.md folders below .claude/."""
    rx = r"^\.claude/(commands|agents|skills)/(?:([^/]+)\.md|([^/]+)/SKILL\.md)$"
    return (
        files.select("project", "path").filter(F.col("path").rlike(rx))
        .select(
            "project",
            F.concat(
                F.regexp_extract("path", rx, 1), F.lit("/"),
                F.regexp_extract("path", rx, 2), F.regexp_extract("path", rx, 3),
            ).alias("skill"),
        ).distinct()
    )


def standards_checklist(files: DataFrame) -> DataFrame:
    """Ten presence checks per project from paths alone, in one aggregation, then unpivoted:
    (project, name, label, weight, found)."""
    flags = [
        F.bool_or(F.col("path").rlike(rx)).alias(f"c{i}")
        for i, (_, _, _, rx) in enumerate(fixed.STANDARD_CHECKS)
    ]
    wide = files.groupBy("project").agg(*flags)
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(lb).alias("label"), F.lit(w).alias("weight"),
                 F.col(f"c{i}").alias("found"))
        for i, (n, lb, w, _) in enumerate(fixed.STANDARD_CHECKS)
    ])
    return wide.select("project", F.inline(rows))


def standards_score(checklist: DataFrame) -> DataFrame:
    return checklist.groupBy("project").agg(
        F.count_if("found").alias("passed"),
        F.count("*").alias("total"),
        F.bround(100 * F.avg(F.col("found").cast("int"))).cast("int").alias("score"),
    )

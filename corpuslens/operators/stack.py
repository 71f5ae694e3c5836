"""Technology stack of every project: indicator rules joined to files, skills, bullet rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.text import last_segment, parent_dirs, path_key
from corpuslens.operators.manifests import MANIFESTS
from corpuslens.session import local_rows


def _rules(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A rule table. These are fixed lists of at most a few dozen rows, hence the broadcast."""
    return F.broadcast(local_rows(spark, rows, schema))


def file_rules() -> list[tuple[str, str, str, str | None]]:
    """(kind, tool, path, needle or None): what the presence of a root file, or of a text in it, says."""
    rows: list[tuple[str, str, str, str | None]] = []
    for tool, indicators in fixed.FRAMEWORK_INDICATORS:
        for i in indicators:
            path, _, needle = i.partition(":")
            rows.append(("framework", tool, path, needle.lower() or None))
    for tool, path in fixed.PACKAGE_MANAGERS:
        rows.append(("package_manager", tool, path, None))
    for kind, tool, paths, quoted in fixed.TOOLCHAINS:
        rows += [(kind, tool, p, None) for p in paths]
        rows.append((kind, tool, "pyproject.toml", f"[tool.{tool}"))
        rows += [(kind, tool, p, f'"{tool}"') for p in quoted]
    rows += [(kind, tool, p, None) for kind, tool, p in fixed.IMPLIED_TOOLS]
    for word in fixed.TEST_FRAMEWORK_WORDS:
        rows += [("test_frameworks", word, p, word) for p in ("pyproject.toml", "package.json")]
    for tool, paths in fixed.RUNTIMES:
        rows += [("runtime", tool, p, None) for p in paths]
    rows += [("ci_cd", tool, p, None) for tool, p, _ in fixed.CI_SYSTEMS]
    return rows


def file_facts(files: DataFrame) -> DataFrame:
    """project, path and text of all files, the text only of those that tool rules or manifests read: a
    small table that, written once, serves every check against the corpus."""
    needed = {path for _, _, path, needle in file_rules() if needle} | {"pyproject.toml"} | set(MANIFESTS.values())
    return files.select("project", "path", F.when(F.col("path").isin(*sorted(needed)), F.col("text")).alias("text"))


def detected_tools(files: DataFrame) -> DataFrame:
    """(project, kind, tool), distinct, in one pass over the files.

    The rules, a few dozen, are literal maps from a path to what its presence says and to the
    needles that are looked up in its text; framework words in lower case, tool words as written.
    """
    rules = file_rules()
    present: dict[str, list[Column]] = {}
    needles: dict[str, list[Column]] = {}
    for kind, tool, path, needle in rules:
        if needle is None:
            present.setdefault(path, []).append(_tool(kind, tool))
        else:
            needles.setdefault(path, []).append(F.struct(F.lit(kind).alias("kind"), F.lit(tool).alias("tool"), F.lit(needle).alias("needle")))

    def of_path(found: dict[str, list[Column]], path: Column) -> Column:
        return F.try_element_at(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), F.array(*v))]), path)

    above = F.filter(F.concat(F.array("path"), parent_dirs("path")), lambda x: x.isin(*present))
    by_path = F.flatten(F.transform(above, lambda x: of_path(present, x)))
    text = F.col("text")
    said = F.filter(of_path(needles, F.col("path")), lambda r: F.contains(F.when(r["kind"] == "framework", F.lower(text)).otherwise(text), r["needle"]))
    by_text = F.transform(said, lambda r: F.struct(r["kind"].alias("kind"), r["tool"].alias("tool")))
    backend = F.lit(False)
    for word in fixed.PIP_BACKENDS:
        backend = backend | F.contains(text, F.lit(word))
    none = F.expr("CAST(array() AS array<struct<kind: string, tool: string>>)")
    assumed = F.when((F.col("path") == "pyproject.toml") & backend, F.array(_tool(_ASSUMED, "pip")))
    every = F.concat(*[F.coalesce(x, none) for x in (by_path, by_text, assumed)])
    found = files.select("project", F.inline(every)).distinct()
    tools = found.filter(F.col("kind") != _ASSUMED)
    # pip is assumed from a build backend when neither pip nor poetry was found
    have = tools.filter((F.col("kind") == "package_manager") & F.col("tool").isin("pip", "poetry")).select("project")
    pip = found.filter(F.col("kind") == _ASSUMED).join(have, "project", "left_anti")
    return tools.unionByName(pip.select("project", F.lit("package_manager").alias("kind"), "tool"))


_ASSUMED = "assumed"


def _tool(kind: str, tool: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(tool).alias("tool"))


def tools_by_kind(tools: DataFrame) -> DataFrame:
    """One row per project and kind with the sorted tool names (bounded by the rule table)."""
    return tools.groupBy("project", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("tool")), ", ").alias("tools")
    )


def nested_frameworks(files: DataFrame) -> DataFrame:
    """Frameworks by file name anywhere in the tree: (project, framework).

    A text indicator looks into the first file of that name, in path order.
    """
    spark = files.sparkSession
    rules = [r[1:] for r in file_rules() if r[0] == "framework"]
    names = sorted({p for _, p, _ in rules})
    rows = files.withColumn("name", last_segment("path")).filter(F.col("name").isin(*names))
    first = rows.groupBy("project", "name").agg(F.min_by("text", path_key("path")).alias("text"))
    table = _rules(spark, [(f, p, fixed_needle(f, p)) for f, p, _ in rules], "framework string, name string, needle string")
    return (
        first.join(table, "name")
        .filter(F.col("needle").isNull() | F.contains(F.col("text"), F.col("needle")))
        .select("project", "framework").distinct()
    )


def fixed_needle(framework: str, path: str) -> str | None:
    """The needle of an indicator as written (this lookup is case-sensitive)."""
    for name, indicators in fixed.FRAMEWORK_INDICATORS:
        if name == framework:
            for i in indicators:
                p, _, needle = i.partition(":")
                if p == path:
                    return needle or None
    return None


def recommended_skills(files: DataFrame, installed: DataFrame) -> DataFrame:
    """Skill bundles for the frameworks and patterns of a project, minus the installed ones."""
    spark = files.sparkSession
    bundles = [(f, s) for f, skills in fixed.FRAMEWORK_BUNDLES for s in skills]
    by_framework = nested_frameworks(files).join(
        _rules(spark, bundles, "framework string, skill string"), "framework"
    ).select("project", "skill")
    name = last_segment("path")
    flags = files.select("project", "path").groupBy("project").agg(
        F.bool_or(name.isin("ci.yml", "test.yml", ".github") | F.startswith("path", F.lit(".github/workflows"))).alias("has_ci"),
        F.bool_or(name.isin("Dockerfile", "docker-compose.yml")).alias("has_docker"),
        F.bool_or(F.contains(name, F.lit("test"))).alias("has_tests"),
    )
    rows = F.concat(*[
        F.when(F.col(flag), F.array(*[F.lit(s) for s in skills])).otherwise(F.array().cast("array<string>"))
        for flag, skills in fixed.PATTERN_SKILLS
    ])
    by_pattern = flags.select("project", F.explode(rows).alias("skill"))
    wanted = by_framework.unionByName(by_pattern).distinct()
    return wanted.join(installed.select("project", "skill").distinct(), ["project", "skill"], "left_anti")


def applicable_anti_patterns(signals: DataFrame) -> DataFrame:
    """Bullets for the signals (project, signal) of a project, first occurrence kept, in the
    order of the rule table."""
    spark = signals.sparkSession
    rows = [
        (signal, n, bullet)
        for n, (signal, bullet) in enumerate(
            (s, b) for s, bullets in fixed.ANTI_PATTERNS for b in bullets
        )
    ]
    table = _rules(spark, rows, "signal string, rule_no int, bullet string")
    always = signals.select("project").distinct().withColumn("signal", F.lit("_always"))
    hits = signals.select("project", "signal").unionByName(always).distinct().join(table, "signal")
    first = hits.groupBy("project", "bullet").agg(F.min("rule_no").alias("rule_no"))
    order = Window.partitionBy("project").orderBy("rule_no")
    return first.select("project", F.row_number().over(order).alias("position"), "bullet")


def project_signals(files: DataFrame, tools: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages, frameworks and runtimes of a project as (project, signal)."""
    named = tools.filter(F.col("kind").isin("framework", "runtime")).select("project", F.col("tool").alias("signal"))
    spoken = languages.select("project", F.col("lang").alias("signal"))
    every = files.select("project").distinct().select("project", F.lit("_always").alias("signal"))
    return named.unionByName(spoken).unionByName(every).distinct()

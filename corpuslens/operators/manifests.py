"""Manifest mining: version, description, dependencies and commands of every project.

``manifest_rows`` brings the few root files of a project into one row (one column per file
name), after a filter on the path that reaches the scan. Everything else is column work on
that small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.text import split_lines, strip, without_final_break

MANIFESTS = {
    "pyproject": "pyproject.toml", "package": "package.json", "cargo": "Cargo.toml",
    "requirements": "requirements.txt", "makefile": "Makefile", "makefile_low": "makefile",
    "justfile": "justfile", "justfile_up": "Justfile", "dockerfile": "Dockerfile",
    "tox": "tox.ini", "setup": "setup.cfg", "readme_md": "README.md", "readme_rst": "README.rst",
    "readme_txt": "README.txt", "readme": "README",
}
PACKAGE_SCHEMA = (
    "name string, version string, description string, scripts map<string,string>, "
    "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
)


def manifest_rows(files: DataFrame) -> DataFrame:
    """One row per project; a column holds the text of that root file or null."""
    rows = files.filter(F.col("path").isin(*MANIFESTS.values()))
    texts = [
        F.max(F.when(F.col("path") == path, F.col("text"))).alias(name)
        for name, path in MANIFESTS.items()
    ]
    return rows.groupBy("project").agg(*texts).withColumn("pkg", F.from_json("package", PACKAGE_SCHEMA))


def toml_section(text: Column, header: str) -> Column:
    """Body between a table header and the next line that opens a table; '' when absent."""
    quoted = header.replace(".", r"\.").replace("[", r"\[").replace("]", r"\]")
    return F.regexp_extract(
        text, rf"(?sd)(?:^|\n)[ \t]*{quoted}[ \t]*(?=\n|\z)(.*?)(?=\n[ \t]*\[|\z)", 1
    )


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _field(body: Column, key: str, anchored: bool = True) -> Column:
    start = r"(?m)^[ \t]*" if anchored else ""
    return _present(F.regexp_extract(body, rf'{start}{key}\s*=\s*"([^"]+)"', 1))


def project_metadata(manifests: DataFrame) -> DataFrame:
    """Version and description by precedence; a README paragraph is the last resort."""
    c = F.col
    project, poetry = toml_section(c("pyproject"), "[project]"), toml_section(c("pyproject"), "[tool.poetry]")
    version = F.coalesce(
        _field(project, "version"), _field(poetry, "version"), _present(c("pkg.version")),
        _field(c("cargo"), "version", anchored=False),
    )
    said = F.coalesce(
        _field(project, "description"), _field(poetry, "description"), _present(c("pkg.description")),
        _field(c("cargo"), "description", anchored=False),
    )

    def paragraph(text: Column) -> Column:
        paras = F.transform(F.split(text, r"\n\s*\n"), strip)
        good = F.filter(
            paras, lambda p: (p != "") & ~F.startswith(p, F.lit("#")) & ~F.startswith(p, F.lit("="))
        )
        return F.left(F.get(good, F.lit(0)), F.lit(200))

    readme = F.coalesce(*[paragraph(c(n)) for n in ("readme_md", "readme_rst", "readme_txt", "readme")])
    return manifests.select(
        "project", version.alias("version"), F.coalesce(said, readme).alias("description")
    )


def bare_dependency(spec: Column) -> Column:
    """Name in front of any version constraint, extra or marker."""
    return strip(F.regexp_extract(spec, r"^([^><=!~;\[]*)", 1))


def toml_array(text: Column, key: str) -> Column:
    """Items of the first ``key = [...]`` array."""
    raw = F.regexp_extract(text, rf"(?s){key}\s*=\s*\[([^\]]*)\]", 1)
    items = F.transform(F.split(raw, ","), lambda s: F.btrim(F.btrim(strip(s), F.lit('"')), F.lit("'")))
    return F.filter(items, lambda s: s != "")


def toml_keys(text: Column, header: str) -> Column:
    body = toml_section(text, header)
    keys = F.transform(split_lines(body), lambda l: F.regexp_extract(l, r"^\s*(\S+)\s*=", 1))
    return F.filter(keys, lambda k: k != "")


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """(project, grp, position, name): the first manifest that declares a group wins."""
    c = F.col

    def names(items: Column) -> Column:
        return F.transform(items, bare_dependency)

    def first(*arrays: Column) -> Column:
        return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])

    core = first(
        names(toml_array(c("pyproject"), "dependencies")),
        F.filter(toml_keys(c("pyproject"), "[tool.poetry.dependencies]"), lambda d: d != "python"),
        F.map_keys(c("pkg.dependencies")), toml_keys(c("cargo"), "[dependencies]"),
    )
    dev = first(
        names(toml_array(c("pyproject"), "dev")),
        toml_keys(c("pyproject"), "[tool.poetry.dev-dependencies]"), F.map_keys(c("pkg.devDependencies")),
    )
    tagged = lambda arr, grp: F.transform(
        F.coalesce(arr, F.array().cast("array<string>")),
        lambda n, i: F.struct(F.lit(grp).alias("grp"), i.alias("position"), n.alias("name")),
    )
    return manifests.select("project", F.inline(F.concat(tagged(core, "core"), tagged(dev, "dev"))))


def all_dependency_names(manifests: DataFrame) -> DataFrame:
    """Every lower-cased name a manifest declares, optional and peer groups included."""
    c = F.col
    optional = F.flatten(
        F.transform(
            F.regexp_extract_all(toml_section(c("pyproject"), "[project.optional-dependencies]"),
                                 F.lit(r"(?s)=\s*\[([^\]]*)\]"), F.lit(1)),
            lambda body: F.regexp_extract_all(body, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)),
        )
    )
    core = F.regexp_extract_all(
        F.regexp_extract(toml_section(c("pyproject"), "[project]"), r"(?sm)^\s*dependencies\s*=\s*\[(.*?)^?\s*\]\s*$", 1),
        F.lit("[\"']([^\"']+)[\"']"), F.lit(1),
    )
    python = F.transform(
        F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in (core, optional)]),
        lambda s: F.regexp_extract(F.lower(strip(s)), r"^([^<>=!~\[;\s]*)", 1),
    )
    node = F.concat(*[
        F.coalesce(F.map_keys(c(f"pkg.{k}")), F.array().cast("array<string>"))
        for k in ("dependencies", "devDependencies", "peerDependencies")
    ])
    every = F.array_distinct(F.concat(python, F.transform(node, F.lower)))
    return manifests.select("project", F.explode(every).alias("name")).filter(F.col("name") != "")


# ---- dependencies with versions -----------------------------------------------------
_DEP = "struct<name:string,version:string,ecosystem:string>"


def _dep(name: Column, version: Column, ecosystem: str) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"))


def _cut(spec: Column, separators: tuple[str, ...], otherwise: Column) -> Column:
    """Split at the first separator of the list that occurs; the version ends at a comma."""
    out = otherwise
    for sep in reversed(separators):
        before = F.substring_index(spec, sep, 1)
        after = F.substr(spec, F.length(before) + len(sep) + 1)
        made = _dep(strip(before), F.substring_index(strip(after), ",", 1), "PyPI")
        out = F.when(F.contains(spec, F.lit(sep)), made).otherwise(out)
    return out


def _lines_inside(text: Column, opens: str, closes: Callable[[Column], Column]) -> Column:
    """Lines between a line that matches ``opens`` and the next that ``closes``."""
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        starts, ends = line.rlike(opens), acc["inside"] & closes(line)
        return F.struct(
            F.when(starts, F.lit(True)).when(ends, F.lit(False)).otherwise(acc["inside"]).alias("inside"),
            F.when(acc["inside"] & ~starts & ~ends, F.concat(acc["out"], F.array(line)))
            .otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(split_lines(without_final_break(text)), state, step, lambda acc: acc["out"])


def versioned_dependencies(manifests: DataFrame) -> DataFrame:
    """(project, position, name, version, ecosystem) of four manifest kinds; the first
    occurrence of a (lower-cased name, ecosystem) is kept."""
    c = F.col
    lines = F.transform(split_lines(c("requirements")), strip)
    wanted = F.filter(
        lines, lambda l: (l != "") & ~F.startswith(l, F.lit("#")) & ~F.startswith(l, F.lit("-"))
    )
    none = F.lit(None).cast(_DEP)
    pinned = F.transform(
        wanted,
        lambda l: _cut(l, ("==", ">=", "<=", "~=", "!=", ">", "<"),
                       F.when(~F.startswith(l, F.lit("git+")), _dep(l, F.lit(""), "PyPI")).otherwise(none)),
    )
    quoted = F.filter(
        F.transform(
            _lines_inside(c("pyproject"), r"^dependencies\s*=\s*\[", lambda l: F.contains(l, F.lit("]"))),
            lambda l: F.regexp_extract(l, r'"([^"]+)"', 1),
        ),
        lambda d: d != "",
    )
    declared = F.transform(
        quoted,
        lambda d: _cut(d, ("==", ">=", "<=", "~=", "!="),
                       _dep(strip(F.regexp_extract(d, r"^([^<>]*)", 1)), F.lit(""), "PyPI")),
    )
    node = F.concat(*[
        F.coalesce(
            F.transform(F.map_entries(c(f"pkg.{k}")),
                        lambda e: _dep(e["key"], F.regexp_replace(e["value"], r"^[\^~>=<]+", ""), "npm")),
            F.array().cast(f"array<{_DEP}>"))
        for k in ("dependencies", "devDependencies")
    ])
    in_cargo = F.filter(
        _lines_inside(c("cargo"), r"^\[dependencies\]", lambda l: F.startswith(l, F.lit("["))),
        lambda l: F.contains(l, F.lit("=")),
    )

    def crate(l: Column) -> Column:
        name = F.substring_index(l, "=", 1)
        raw = F.btrim(F.btrim(strip(F.substr(l, F.length(name) + 2)), F.lit('"')), F.lit("'"))
        version = F.when(
            F.startswith(raw, F.lit("{")), F.regexp_extract(raw, r'version\s*=\s*"([^"]+)"', 1)
        ).otherwise(raw)
        return _dep(strip(name), version, "crates.io")

    parts = [F.coalesce(a, F.array().cast(f"array<{_DEP}>")) for a in (pinned, declared, node, F.transform(in_cargo, crate))]
    every = F.array_compact(F.concat(*parts))
    rows = manifests.select("project", F.posexplode(every).alias("_pos", "d")).select("project", "_pos", "d.*")
    first = Window.partitionBy("project", F.lower("name"), "ecosystem").orderBy("_pos")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    order = Window.partitionBy("project").orderBy("_pos")
    return kept.select(
        "project", F.row_number().over(order).alias("position"), "name", "version", "ecosystem"
    )


# ---- commands -----------------------------------------------------------------------
def npm_scripts(manifests: DataFrame) -> DataFrame:
    return manifests.select("project", F.posexplode("pkg.scripts").alias("position", "name", "command"))


def first_body_lines(text: Column, header: str, is_body: Callable[[Column], Column]) -> Column:
    """(name, command) for every header line and the first body line behind it."""
    empty = F.array().cast("array<struct<name:string,command:string>>")
    state = F.struct(F.lit(None).cast("string").alias("name"), empty.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        opens = line.rlike(header)
        takes = ~opens & acc["name"].isNotNull() & is_body(line)
        pair = F.struct(acc["name"].alias("name"), strip(line).alias("command"))
        return F.struct(
            F.when(opens, F.regexp_extract(line, header, 1)).when(takes, F.lit(None))
            .otherwise(acc["name"]).alias("name"),
            F.when(takes, F.concat(acc["out"], F.array(pair))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(split_lines(without_final_break(text)), state, step, lambda acc: acc["out"])


def _last_per_name(manifests: DataFrame, pairs: Column) -> DataFrame:
    rows = manifests.select("project", F.posexplode(pairs).alias("_pos", "p"))
    return rows.groupBy("project", F.col("p.name").alias("name")).agg(
        F.max_by("p.command", "_pos").alias("command"), F.min("_pos").alias("position")
    )


def make_targets(manifests: DataFrame) -> DataFrame:
    pairs = first_body_lines(
        F.coalesce("makefile", "makefile_low"), r"^([a-zA-Z_][a-zA-Z0-9_-]*)\s*:",
        lambda l: F.startswith(l, F.lit("\t")),
    )
    return _last_per_name(manifests, pairs)


def just_recipes(manifests: DataFrame) -> DataFrame:
    pairs = first_body_lines(
        F.coalesce("justfile", "justfile_up"), r"^([a-zA-Z_][a-zA-Z0-9_-]*)(?:\s.*)?:",
        lambda l: l.rlike(r"^[ \t]") & (strip(l) != ""),
    )
    return _last_per_name(manifests, pairs)


# Fixed values: (command name, text looked for in pyproject.toml, command), later rows replace
PYPROJECT_COMMANDS = (
    ("test", "pytest", "pytest tests/ -v"),
    ("lint", "[tool.ruff", "ruff check src/ tests/"),
    ("format", "[tool.ruff", "ruff format src/ tests/"),
    ("type check", "[tool.mypy", "mypy src/"),
    ("format", "[tool.black", "black src/ tests/"),
    ("coverage", "[tool.coverage", "pytest --cov=src/ tests/"),
    ("isort", "[tool.isort", "isort src/ tests/"),
)


def python_commands(manifests: DataFrame) -> DataFrame:
    """Commands implied by pyproject tables, script tables, tox and setup.cfg."""
    pair = lambda n, cmd: F.struct(F.lit(n).alias("name"), F.lit(cmd).alias("command"))
    py = F.col("pyproject")
    implied = F.array_compact(F.array(*[
        F.when(F.contains(py, F.lit(word)), pair(name, cmd)) for name, word, cmd in PYPROJECT_COMMANDS
    ]))
    scripts = [
        F.filter(
            F.transform(
                split_lines(toml_section(py, header)),
                lambda l: F.struct(
                    F.regexp_extract(strip(l), r'^(\S+)\s*=\s*"(.+)"', 1).alias("name"),
                    F.regexp_extract(strip(l), r'^(\S+)\s*=\s*"(.+)"', 2).alias("command"),
                ),
            ),
            lambda p: p["name"] != "",
        )
        for header in ("[project.scripts]", "[tool.poetry.scripts]")
    ]
    empty = F.array().cast("array<struct<name:string,command:string>>")
    listed = F.concat(*[F.coalesce(a, empty) for a in (implied, *scripts)])
    names = F.transform(listed, lambda p: p["name"])
    tox = F.when(F.coalesce(F.contains(py, F.lit("[tool.tox")), F.lit(False)) | F.col("tox").isNotNull(), pair("tox", "tox"))
    test = F.when(
        ~F.array_contains(names, "test") & F.contains(F.col("setup"), F.lit("[tool:pytest]")), pair("test", "pytest")
    )
    return _last_per_name(manifests, F.concat(listed, F.array_compact(F.array(tox, test))))


def container_commands(manifests: DataFrame) -> DataFrame:
    """CMD and ENTRYPOINT of the root Dockerfile, last one wins."""
    lines = F.transform(split_lines(F.col("dockerfile")), strip)
    pairs = F.array_compact(F.transform(
        lines,
        lambda l: F.when(
            F.startswith(l, F.lit("CMD ")),
            F.struct(F.lit("docker CMD").alias("name"), strip(F.substr(l, F.lit(5))).alias("command")),
        ).when(
            F.startswith(l, F.lit("ENTRYPOINT ")),
            F.struct(F.lit("docker ENTRYPOINT").alias("name"), strip(F.substr(l, F.lit(12))).alias("command")),
        ),
    ))
    return _last_per_name(manifests, pairs)


def all_commands(manifests: DataFrame) -> DataFrame:
    """(project, source, position, name, command) of every source."""
    parts = {
        "npm": npm_scripts, "pyproject": python_commands, "make": make_targets, "just": just_recipes,
        "docker": container_commands,
    }
    out = None
    for source, fn in parts.items():
        part = fn(manifests).select("project", F.lit(source).alias("source"), "position", "name", "command")
        out = part if out is None else out.unionByName(part)
    return out

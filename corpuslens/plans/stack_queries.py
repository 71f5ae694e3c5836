"""Registered queries: manifests, commands and technology stack."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed
from corpuslens.operators import inventory as inv
from corpuslens.operators import manifests as man
from corpuslens.operators import stack
from corpuslens.plans.inventory_queries import FILES_SQL, KEY_SQL, NAME_SQL, sql_list, sql_values
from corpuslens.plans.registry import query
from corpuslens.sources.bindings import table, view


def _corpus(spark, sf_dir):
    return view(spark, sf_dir, "corpus")


def _manifests(spark, sf_dir):
    return man.manifest_rows(_corpus(spark, sf_dir))


def _root(path: str, name: str) -> str:
    return f"max(CASE WHEN path = '{path}' THEN text END) AS {name}"


MAN_SQL = (
    "man AS (SELECT project, " + ", ".join(_root(p, n) for n, p in man.MANIFESTS.items())
    + f" FROM corpus WHERE path IN ({sql_list(man.MANIFESTS.values())}) GROUP BY project)"
)


def _section(header: str, col: str = "pyproject") -> str:
    """Body of a table: from behind its header to the next line that starts with a bracket."""
    h = f"(chr(10) || '{header}' || chr(10))"
    t = f"(chr(10) || {col} || chr(10))"
    after = f"substr({t}, strpos({t}, {h}) + length({h}) - 1)"
    return f"(CASE WHEN contains({t}, {h}) THEN split_part({after}, chr(10) || '[', 1) ELSE '' END)"


VERSION_SQL = (
    f"coalesce(nullif(regexp_extract({_section('[project]')}, '\\nversion = \"([^\"]+)\"', 1), ''), "
    f"nullif(regexp_extract({_section('[tool.poetry]')}, '\\nversion = \"([^\"]+)\"', 1), ''), "
    "json_extract_string(package, '$.version'), nullif(regexp_extract(cargo, 'version\\s*=\\s*\"([^\"]+)\"', 1), ''))"
)


@query("project_metadata", "X1", f"""
WITH {MAN_SQL}, p AS (SELECT project, list_filter(list_transform(string_split_regex(readme_md, '\\n\\s*\\n'), lambda s: trim(s, ' ' || chr(9) || chr(10))),
  lambda s: s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, '=')) AS paras FROM man)
SELECT man.project, {VERSION_SQL} AS version, coalesce(nullif(regexp_extract({_section('[project]')}, '\\ndescription = \"([^\"]+)\"', 1), ''),
 nullif(json_extract_string(package, '$.description'), ''), nullif(regexp_extract(cargo, 'description\\s*=\\s*\"([^\"]+)\"', 1), ''), left(paras[1], 200)) AS description FROM man JOIN p USING (project)""", "corpus")
def project_metadata(spark, sf_dir):
    return man.project_metadata(_manifests(spark, sf_dir))


_CONSTRAINT = "trim(regexp_extract(x, '^([^><=!~;\\[]*)', 1))"


def _toml_items(key: str) -> str:
    return (
        f"list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(pyproject, ''), '{key}\\s*=\\s*\\[([^\\]]*)\\]', 1), ','), "
        f"lambda x: trim(trim(x, ' ' || chr(10)), chr(34))), lambda x: x <> ''), lambda x: {_CONSTRAINT})"
    )


CARGO_KEYS = f"list_transform(regexp_extract_all({_section('[dependencies]', 'cargo')}, '\\n([^ \\n]+) = ', 1), lambda x: x)"


@query("declared_dependencies", "X2 F18", f"""
WITH {MAN_SQL}, a AS (SELECT project, {_toml_items('dependencies')} AS c1, json_keys(package, '$.dependencies') AS c2, {CARGO_KEYS} AS c3,
  {_toml_items('dev')} AS d1, json_keys(package, '$.devDependencies') AS d2 FROM man),
b AS (SELECT project, 'core' AS grp, CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 ELSE c3 END AS l FROM a
 UNION ALL SELECT project, 'dev', CASE WHEN len(d1) > 0 THEN d1 ELSE d2 END FROM a)
SELECT project, grp, unnest(range(0, len(l))) AS position, unnest(l) AS name FROM b""", "corpus")
def declared_dependencies(spark, sf_dir):
    return man.declared_dependencies(_manifests(spark, sf_dir))


ALL_DEPS_SQL = f"""alldeps AS (SELECT DISTINCT project, lower(name) AS name FROM (
 SELECT project, unnest({_toml_items('dependencies')}) AS name FROM man
 UNION ALL SELECT project, unnest({_toml_items('dev')}) FROM man
 UNION ALL SELECT project, unnest(json_keys(package, '$.dependencies')) FROM man
 UNION ALL SELECT project, unnest(json_keys(package, '$.devDependencies')) FROM man))"""


@query("all_dependency_names", "X4", f"WITH {MAN_SQL}, {ALL_DEPS_SQL} SELECT * FROM alldeps", "corpus")
def all_dependency_names(spark, sf_dir):
    return man.all_dependency_names(_manifests(spark, sf_dir))


@query("versioned_dependencies", "X3 W11 F18", f"""
WITH {MAN_SQL}, req AS (SELECT project, 0 AS src, n, trim(l) AS l FROM man, unnest(string_split(requirements, chr(10))) WITH ORDINALITY AS u(l, n)
  WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#') AND NOT starts_with(trim(l), '-')),
raw AS (SELECT project, 0 AS src, n, CASE WHEN regexp_matches(l, '[=<>!~]') THEN trim(regexp_extract(l, '^(.*?)(==|>=|~=)', 1)) ELSE l END AS name,
   CASE WHEN regexp_matches(l, '[=<>!~]') THEN split_part(trim(regexp_extract(l, '(==|>=|~=)(.*)$', 2)), ',', 1) ELSE '' END AS version, 'PyPI' AS ecosystem FROM req WHERE NOT starts_with(l, 'git+')
 UNION ALL SELECT project, 1, n, regexp_extract(d, '^(.*?)(==|>=|~=)', 1), regexp_extract(d, '(==|>=|~=)(.*)$', 2), 'PyPI'
   FROM man, unnest(regexp_extract_all(regexp_extract(coalesce(pyproject, ''), 'dependencies\\s*=\\s*\\[([^\\]]*)\\]', 1), '"([^"]+)"', 1)) WITH ORDINALITY AS u(d, n)
 UNION ALL SELECT project, 2, n, k, ltrim(json_extract_string(package, '$.dependencies.' || k), '^~>=<'), 'npm' FROM man, unnest(json_keys(package, '$.dependencies')) WITH ORDINALITY AS u(k, n)
 UNION ALL SELECT project, 3, n, k, ltrim(json_extract_string(package, '$.devDependencies.' || k), '^~>=<'), 'npm' FROM man, unnest(json_keys(package, '$.devDependencies')) WITH ORDINALITY AS u(k, n)
 UNION ALL SELECT project, 4, n, split_part(l, ' = ', 1), CASE WHEN contains(l, '{{') THEN regexp_extract(l, 'version = "([^"]+)"', 1) ELSE trim(split_part(l, ' = ', 2), '"') END, 'crates.io'
   FROM man, unnest(string_split({_section('[dependencies]', 'cargo')}, chr(10))) WITH ORDINALITY AS u(l, n) WHERE contains(l, '=')),
d AS (SELECT *, row_number() OVER (PARTITION BY project, lower(name), ecosystem ORDER BY src, n) AS r FROM raw)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY src, n) AS position, name, version, ecosystem FROM d WHERE r = 1""", "corpus")
def versioned_dependencies(spark, sf_dir):
    return man.versioned_dependencies(_manifests(spark, sf_dir))


@query("npm_scripts", "X5", f"""
WITH {MAN_SQL} SELECT project, k AS name, json_extract_string(package, '$.scripts.' || k) AS command FROM man, unnest(json_keys(package, '$.scripts')) AS u(k)""", "corpus")
def npm_scripts(spark, sf_dir):
    return man.npm_scripts(_manifests(spark, sf_dir)).drop("position")


def _body_sql(column: str, header: str, body: str) -> str:
    return f"""
WITH {MAN_SQL}, l AS (SELECT project, n, line, nullif(regexp_extract(line, '{header}', 1), '') AS head FROM man, unnest(string_split({column}, chr(10))) WITH ORDINALITY AS u(line, n)),
g AS (SELECT *, max(CASE WHEN head IS NOT NULL THEN n END) OVER (PARTITION BY project ORDER BY n) AS head_at FROM l),
f AS (SELECT g.project, h.head AS name, g.line, g.n, row_number() OVER (PARTITION BY g.project, g.head_at ORDER BY g.n) AS r FROM g JOIN l h ON h.project = g.project AND h.n = g.head_at
 WHERE g.head IS NULL AND {body}),
k AS (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY n DESC) AS latest FROM f WHERE r = 1)
SELECT project, name, trim(line, ' ' || chr(9)) AS command FROM k WHERE latest = 1"""


@query("make_targets", "X6", _body_sql("makefile", "^([a-zA-Z_][a-zA-Z0-9_-]*)\\s*:", "starts_with(g.line, chr(9))"), "corpus")
def make_targets(spark, sf_dir):
    return man.make_targets(_manifests(spark, sf_dir)).drop("position")


@query("just_recipes", "X7", _body_sql("justfile", "^([a-zA-Z_][a-zA-Z0-9_-]*)(?:\\s.*)?:", "regexp_matches(g.line, '^[ \\t]+\\S')"), "corpus")
def just_recipes(spark, sf_dir):
    return man.just_recipes(_manifests(spark, sf_dir)).drop("position")


@query("python_commands", "X8", f"""
WITH {MAN_SQL}, c AS (
 SELECT project, 'test' AS name, 'pytest tests/ -v' AS command FROM man WHERE contains(pyproject, 'pytest')
 UNION ALL SELECT project, 'lint', 'ruff check src/ tests/' FROM man WHERE contains(pyproject, '[tool.ruff')
 UNION ALL SELECT project, 'format', 'ruff format src/ tests/' FROM man WHERE contains(pyproject, '[tool.ruff')
 UNION ALL SELECT project, 'type check', 'mypy src/' FROM man WHERE contains(pyproject, '[tool.mypy')
 UNION ALL SELECT project, m[1], m[2] FROM (SELECT project, [regexp_extract(s, '\\n(\\S+) = "(.+)"', 1), regexp_extract(s, '\\n(\\S+) = "(.+)"', 2)] AS m FROM (SELECT project, {_section('[project.scripts]')} AS s FROM man WHERE pyproject IS NOT NULL))
 UNION ALL SELECT project, 'tox', 'tox' FROM man WHERE tox IS NOT NULL)
SELECT * FROM c WHERE name <> ''""", "corpus")
def python_commands(spark, sf_dir):
    return man.python_commands(_manifests(spark, sf_dir)).drop("position")


@query("container_commands", "X9", f"""
WITH {MAN_SQL}, l AS (SELECT project, n, trim(line) AS line FROM man, unnest(string_split(dockerfile, chr(10))) WITH ORDINALITY AS u(line, n)),
c AS (SELECT project, n, CASE WHEN starts_with(line, 'CMD ') THEN 'docker CMD' ELSE 'docker ENTRYPOINT' END AS name, trim(regexp_replace(line, '^(CMD|ENTRYPOINT) ', '')) AS command
 FROM l WHERE starts_with(line, 'CMD ') OR starts_with(line, 'ENTRYPOINT '))
SELECT project, name, arg_max(command, n) AS command FROM c GROUP BY project, name""", "corpus")
def container_commands(spark, sf_dir):
    return man.container_commands(_manifests(spark, sf_dir)).drop("position")


_RULES = stack.file_rules()
TOOLS_SQL = f"""rules(kind, tool, path, needle) AS (VALUES {sql_values(_RULES)}),
known AS (SELECT project, path FROM corpus UNION SELECT project, array_to_string(string_split(path, '/')[1:n], '/') FROM
  (SELECT project, path, unnest(range(1, len(string_split(path, '/')))) AS n FROM corpus)),
base AS (SELECT DISTINCT project, kind, tool FROM rules JOIN known USING (path) WHERE needle IS NULL
  UNION SELECT DISTINCT project, kind, tool FROM rules JOIN corpus USING (path) WHERE needle IS NOT NULL AND contains(CASE WHEN kind = 'framework' THEN lower(text) ELSE text END, needle)),
tools AS (SELECT * FROM base UNION SELECT project, 'package_manager', 'pip' FROM corpus c WHERE path = 'pyproject.toml' AND regexp_matches(text, 'setuptools|hatchling|flit')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.project = c.project AND kind = 'package_manager' AND tool IN ('pip', 'poetry')))"""


@query("detected_frameworks", "J8", f"WITH {TOOLS_SQL} SELECT project, tool FROM tools WHERE kind = 'framework'", "corpus")
def detected_frameworks(spark, sf_dir):
    tools = stack.detected_tools(_corpus(spark, sf_dir))
    return tools.filter(F.col("kind") == "framework").select("project", "tool")


@query("detected_tools", "J9 J10 J11", f"WITH {TOOLS_SQL} SELECT project, kind, string_agg(tool, ', ' ORDER BY tool) AS tools FROM tools WHERE kind <> 'framework' GROUP BY ALL", "corpus")
def detected_tools(spark, sf_dir):
    tools = stack.detected_tools(_corpus(spark, sf_dir))
    return stack.tools_by_kind(tools.filter(F.col("kind") != "framework"))


INSTALLED = (
    "SELECT DISTINCT 'src' || (s_suppkey % 20) AS project, (CASE s_nationkey % 4 WHEN 0 THEN 'full-stack-dev' "
    "WHEN 1 THEN 'cicd-pipeline' WHEN 2 THEN 'code-reviewer' ELSE 'web-deployer' END) AS skill FROM supplier"
)
_NESTED = [(f, p, stack.fixed_needle(f, p)) for k, f, p, _ in _RULES if k == "framework"]


@query("recommended_skills", "J16 U4", f"""
WITH nr(framework, name, needle) AS (VALUES {sql_values(_NESTED)}),
named AS (SELECT project, {NAME_SQL} AS name, text, row_number() OVER (PARTITION BY project, {NAME_SQL} ORDER BY {KEY_SQL}) AS r FROM corpus),
fw AS (SELECT DISTINCT project, framework FROM nr JOIN named USING (name) WHERE r = 1 AND (needle IS NULL OR contains(text, needle))),
bundles(framework, skill) AS (VALUES {sql_values([(f, s) for f, ss in fixed.FRAMEWORK_BUNDLES for s in ss])}),
wanted AS (SELECT project, skill FROM fw JOIN bundles USING (framework)
 UNION SELECT project, 'cicd-pipeline' FROM named WHERE name IN ('ci.yml', 'test.yml')
 UNION SELECT project, 'web-deployer' FROM named WHERE name IN ('Dockerfile', 'docker-compose.yml')
 UNION SELECT project, unnest(['testing-specialist', 'code-reviewer']) FROM named WHERE contains(name, 'test'))
SELECT project, skill FROM wanted EXCEPT ({INSTALLED})""", "corpus")
def recommended_skills(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return stack.recommended_skills(_corpus(spark, sf_dir), spark.sql(INSTALLED))


_BULLETS = [(s, n, b) for n, (s, b) in enumerate((s, b) for s, bs in fixed.ANTI_PATTERNS for b in bs)]


@query("applicable_anti_patterns", "J25 W11", f"""
WITH {FILES_SQL}, {TOOLS_SQL}, bullets(signal, rule_no, bullet) AS (VALUES {sql_values(_BULLETS)}),
sig AS (SELECT project, tool AS signal FROM tools WHERE kind IN ('framework', 'runtime') UNION SELECT project, lang FROM files WHERE lang IS NOT NULL UNION SELECT project, '_always' FROM corpus),
h AS (SELECT project, bullet, min(rule_no) AS rule_no FROM sig JOIN bullets USING (signal) GROUP BY ALL)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY rule_no) AS position, bullet FROM h""", "corpus")
def applicable_anti_patterns(spark, sf_dir):
    files = _corpus(spark, sf_dir)
    names = files.select("project", "path")
    signals = stack.project_signals(names, stack.detected_tools(files), inv.language_counts(names))
    return stack.applicable_anti_patterns(signals)


URLS_SQL = f"""(SELECT page_id, url, regexp_extract(trim(url), '^https://github\\.com/([A-Za-z0-9](?:-?[A-Za-z0-9])*)/([A-Za-z0-9._-]{{1,100}}?)(?:\\.git)?(?:/.*)?$', 1) AS owner,
 regexp_extract(trim(url), '^https://github\\.com/([A-Za-z0-9](?:-?[A-Za-z0-9])*)/([A-Za-z0-9._-]{{1,100}}?)(?:\\.git)?(?:/.*)?$', 2) AS repo FROM repo_urls)"""


@query("canonical_repo_urls", "P17", f"""
SELECT page_id, CASE WHEN owner <> '' AND lower(owner) NOT IN ({sql_list(fixed.RESERVED_OWNERS)}) THEN 'https://github.com/' || owner || '/' || repo END AS repo_url,
 CASE WHEN owner = '' THEN 'not a repository address' WHEN lower(owner) IN ({sql_list(fixed.RESERVED_OWNERS)}) THEN 'reserved owner' END AS reason FROM {URLS_SQL}""", "repo_urls")
def canonical_repo_urls(spark, sf_dir):
    from corpuslens.operators.urls import canonical_repo_url

    return canonical_repo_url(view(spark, sf_dir, "repo_urls")).drop("url")


@query("loose_repo_urls", "P18", """
WITH p AS (SELECT page_id, regexp_extract(trim(url), '^(https?)://(?:www\\.)?github\\.com(/[^?#]*)', 2) AS path FROM repo_urls),
q AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, CASE WHEN len(parts) >= 2 THEN 'https://github.com/' || parts[1] || '/' || regexp_replace(parts[2], '\\.git$', '') || '.git' END AS clone_url FROM q""", "repo_urls")
def loose_repo_urls(spark, sf_dir):
    from corpuslens.operators.urls import loose_repo_url

    return loose_repo_url(view(spark, sf_dir, "repo_urls")).select("page_id", "clone_url")

"""Claims of instruction documents against the corpus: files, version, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.scores import share_score
from corpuslens.functions.text import around
from corpuslens.operators import audit, inventory as inv
from corpuslens.operators.audit import DOC
from corpuslens.operators.manifests import _field, toml_section


def claimed_path_pattern(bounded: bool = False) -> str:
    """Path-like words with a known extension.

    The extensions are tried in the fixed order without a boundary, so ``a/b.tsx`` is read as
    ``a/b.ts``; ``bounded=True`` tries long ones first and asks for a word end.
    """
    exts = sorted(fixed.CLAIM_EXTS, key=len, reverse=True) if bounded else fixed.CLAIM_EXTS
    tail = r"\b" if bounded else ""
    return r"(?:^|[\s│├└─`(])((?:[\p{L}\p{N}_\-]+/){1,}[\p{L}\p{N}_\-]+\.(?:" + "|".join(exts) + ")" + tail + ")"


def file_claims(bounded: bool = False) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(around(F.col("text"), "/"), F.lit(claimed_path_pattern(bounded)), F.lit(1)))


def claimed_files(contexts: DataFrame, bounded: bool = False) -> DataFrame:
    return contexts.select(*DOC, F.explode(file_claims(bounded)).alias("claim"))


def claimed_version(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(text, fixed.CLAIMED_VERSION, 1), F.lit(""))


def dependency_claims() -> Column:
    """Names of the bullets in the Dependencies section."""
    body = F.regexp_extract("text", r"(?imsd)^##\s+Dependencies\b(.*?)(?=^##\s|\z)", 1)
    names = F.transform(F.regexp_extract_all(body, F.lit(fixed.CLAIMED_DEP), F.lit(1)), F.lower)
    good = F.filter(names, lambda d: ~d.isin(*fixed.NOT_DEPS) & ~F.contains(d, F.lit(".")))
    return F.array_distinct(F.transform(good, lambda d: F.regexp_replace(d, r"\[.*?\]", "")))


def claimed_dependencies(contexts: DataFrame) -> DataFrame:
    return contexts.select(*DOC, F.explode(dependency_claims()).alias("claim"))


def manifest_version(manifests: DataFrame) -> DataFrame:
    version = F.coalesce(
        _field(toml_section(F.col("pyproject"), "[project]"), "version"), F.col("pkg.version")
    )
    return manifests.select("project", version.alias("actual")).filter(F.col("actual").isNotNull())


def missing_files(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """Left anti join of claimed files with every known path and folder."""
    known = inv.known_paths(files).withColumnRenamed("path", "claim")
    return claimed_files(contexts).join(known, ["project", "claim"], "left_anti").select(*DOC, "claim")


def version_mismatches(contexts: DataFrame, manifests: DataFrame) -> DataFrame:
    said = contexts.select(*DOC, claimed_version().alias("claim")).filter(F.col("claim").isNotNull())
    return said.join(manifest_version(manifests), "project").filter(F.col("claim") != F.col("actual"))


def unknown_dependencies(contexts: DataFrame, declared: DataFrame) -> DataFrame:
    """Claimed names that no manifest declares, only where a manifest declares any at all."""
    claims = claimed_dependencies(contexts)
    guarded = claims.join(declared.select("project").distinct(), "project", "left_semi")
    names = declared.withColumnRenamed("name", "claim")
    return guarded.join(names, ["project", "claim"], "left_anti").select(*DOC, "claim")


def tagged_claims() -> Column:
    """All claims of a text: array<struct<kind, claim>>."""
    def tagged(kind: str, claims: Column) -> Column:
        return F.transform(claims, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("claim")))

    return F.concat(
        tagged("missing_file", file_claims()), tagged("version_mismatch", F.array_compact(F.array(claimed_version()))),
        tagged("unknown_dep", dependency_claims()))


def document_facts(contexts: DataFrame) -> DataFrame:
    """What audit and claim checks need of each document, from one reading of its text: findings of the
    text checks, missing sections, words that may be contradicted, path references and claims. Written
    once, the rows serve ``audit_findings``, ``audit_report``, ``claim_checks`` and ``reality_report``."""
    return audit.with_text_facts(contexts).select(
        *DOC, audit.text_checks().alias("_findings"), audit.missing_sections().alias("_missing"), audit.said_words().alias("_said"),
        audit.references().alias("_refs"), tagged_claims().alias("_claims"))


def claim_checks(contexts: DataFrame, files: DataFrame, manifests: DataFrame, declared: DataFrame) -> DataFrame:
    """Every check that was run: (project, path, kind, claim, actual, passed).

    One pass over the documents takes all claims out; one equi join on (project, kind, claim)
    meets them with everything that is known. Version claims count only where the project states
    a version, dependency claims only where a manifest declares any.
    """
    said = contexts.select(*DOC, F.inline("_claims" if "_claims" in contexts.columns else tagged_claims()))
    versions = manifest_version(manifests)
    known = (
        inv.known_paths(files).select("project", F.lit("missing_file").alias("kind"), F.col("path").alias("claim"))
        .unionByName(versions.select("project", F.lit("version_mismatch").alias("kind"), F.col("actual").alias("claim")))
        .unionByName(declared.select("project", F.lit("unknown_dep").alias("kind"), F.col("name").alias("claim")))
        .distinct().withColumn("_known", F.lit(True))
    )
    have = declared.select("project").distinct().withColumn("_deps", F.lit(True))
    facts = versions.join(have, "project", "full_outer")
    kind = F.col("kind")
    due = (
        (kind == "missing_file") | ((kind == "version_mismatch") & F.col("actual").isNotNull())
        | ((kind == "unknown_dep") & F.col("_deps").isNotNull())
    )
    return (
        said.join(facts, "project", "left").filter(due).join(known, ["project", "kind", "claim"], "left")
        .select(*DOC, "kind", "claim", F.when(kind == "version_mismatch", F.col("actual")).alias("actual"),
                F.col("_known").isNotNull().alias("passed"))
    )


def claim_findings(checks: DataFrame, title: str = fixed.DOC_TITLE) -> DataFrame:
    c, kind = F.col("claim"), F.col("kind")
    failed = checks.filter(~F.col("passed"))
    return failed.select(
        *DOC, F.when(kind == "version_mismatch", "error").otherwise("warning").alias("severity"),
        kind.alias("category"),
        F.when(kind == "missing_file", F.concat(F.lit("Claimed file not found: "), c))
        .when(kind == "unknown_dep", F.concat(F.lit("Dependency '"), c, F.lit("' not in pyproject/package.json")))
        .otherwise(F.concat(F.lit(f"{title} says v"), c, F.lit(", project is v"), "actual")).alias("message"),
        "claim",
        F.when(kind == "missing_file", F.concat(F.lit("Remove reference or update path ("), c, F.lit(")")))
        .when(kind == "unknown_dep", F.concat(F.lit("Remove '"), c, F.lit("' from Dependencies or add to manifest")))
        .otherwise(F.concat(F.lit("Update Current State → Version to "), "actual")).alias("suggestion"),
    )


def reality_report(contexts: DataFrame, checks: DataFrame) -> DataFrame:
    """Checks run and passed per document and the share as a score; 0 when nothing to check."""
    counts = checks.groupBy(*DOC).agg(
        F.count("*").alias("checks_run"), F.count_if("passed").alias("checks_passed"))
    return (
        contexts.select(*DOC).join(counts, DOC, "left").fillna(0)
        .withColumn("reality_score", share_score(F.col("checks_passed"), F.col("checks_run")))
    )

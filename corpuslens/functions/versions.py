"""Order-preserving keys of version numbers: strings that sort as the versions do.

Python packages follow epoch, release, pre-, post- and development release and local label, others
semantic versioning. Any number of parts of any length is ordered; trailing zero parts of a release don't
count. What is no version has a null key.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PEP = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|rc|c)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_SEMVER = r"^\s*[v=]?(\d+(?:\.\d+)*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\s*$"


def _number(digits: Column) -> Column:
    """A whole number as its length and its digits; no digits are 0."""
    plain = F.regexp_replace(F.concat(F.lit("0"), digits), r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def _release(release: Column) -> Column:
    """Each part behind a mark that is larger than all that may follow the last part."""
    parts = F.split(F.regexp_replace(release, r"(\.0+)+$", ""), r"\.")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("P"), _number(p))), "")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def python_version_key(version: Column) -> Column:
    text = F.lower(version)
    epoch, release, pre, pre_n, dash, post, post_n, dev, dev_n, local = (_group(text, _PEP, n) for n in range(1, 11))
    has_post = (dash != "") | (post != "")
    phase = (
        F.when(pre.isin("a", "alpha"), F.concat(F.lit("1"), _number(pre_n))).when(pre.isin("b", "beta"), F.concat(F.lit("2"), _number(pre_n)))
        .when(pre != "", F.concat(F.lit("3"), _number(pre_n)))
        .when((dev != "") & ~has_post, F.lit("0")).otherwise(F.lit("4"))
    )
    after = F.when(has_post, F.concat(F.lit("1"), _number(F.concat(dash, post_n)))).otherwise(F.lit("0"))
    ahead = F.when(dev != "", F.concat(F.lit("0"), _number(dev_n))).otherwise(F.lit("9"))
    labels = F.transform(F.split(local, "[-_.]"), lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("b"), _number(s))).otherwise(F.concat(F.lit("a"), s, F.lit(" "))))
    key = F.concat(_number(epoch), _release(release), phase, after, ahead, F.when(local != "", F.array_join(labels, "")).otherwise(F.lit("")))
    return F.when(text.rlike(_PEP), key)


def semantic_version_key(version: Column) -> Column:
    release, pre = (_group(version, _SEMVER, n) for n in (1, 2))
    names = F.transform(F.split(pre, r"\."), lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("a"), _number(s))).otherwise(F.concat(F.lit("b"), s, F.lit(" "))))
    key = F.concat(_number(F.lit("")), _release(release), F.when(pre != "", F.concat(F.lit("1"), F.array_join(names, ""))).otherwise(F.lit("4")))
    return F.when(version.rlike(_SEMVER), key)


def version_key(version: Column, ecosystem: Column) -> Column:
    """Key by the rules of the ecosystem; keys of one ecosystem compare."""
    return F.when(ecosystem == "PyPI", python_version_key(version)).otherwise(semantic_version_key(version))

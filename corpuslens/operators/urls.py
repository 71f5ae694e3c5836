"""Repository addresses: strict and loose normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.text import strip

HOST = "github.com"
# owner: 1-39 letters, digits or single inner hyphens; repo: 1-100 word characters, dots, hyphens
STRICT = (
    r"^https://github\.com/([A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38})/"
    r"([A-Za-z0-9._-]{1,100}?)(?:\.git)?(?:/.*)?$"
)


def canonical_repo_url(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds ``repo_url`` (null when rejected) and ``reason``."""
    bare = strip(column)
    owner = F.regexp_extract(bare, STRICT, 1)
    repo = F.regexp_replace(F.regexp_extract(bare, STRICT, 2), r"\.git$", "")
    bad = (owner == "") | bare.rlike(r"[\s\x00-\x1f]")
    reserved = F.lower(owner).isin(*fixed.RESERVED_OWNERS)
    return urls.withColumn(
        "repo_url", F.when(~bad & ~reserved, F.concat(F.lit(f"https://{HOST}/"), owner, F.lit("/"), repo))
    ).withColumn(
        "reason", F.when(bad, "not a repository address").when(reserved, "reserved owner")
    )


def loose_repo_url(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds ``clone_url``: scheme and host are checked, two path parts are kept."""
    bare = strip(column)
    scheme = F.try_parse_url(bare, F.lit("PROTOCOL"))
    host = F.lower(F.try_parse_url(bare, F.lit("HOST")))
    parts = F.filter(F.split(F.try_parse_url(bare, F.lit("PATH")), "/"), lambda p: p != "")
    ok = F.lower(scheme).isin("https", "http") & host.isin(HOST, f"www.{HOST}") & (F.size(parts) >= 2)
    repo = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    return urls.withColumn(
        "clone_url",
        F.when(ok, F.concat(F.lit(f"https://{HOST}/"), F.get(parts, F.lit(0)), F.lit("/"), repo, F.lit(".git"))),
    )

"""URL filter: fixed rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. Three beta-binomial levels shrink them: a suffix
towards all pages, a registered domain towards its suffix, a host towards its domain. How hard a
level shrinks (its concentration) is estimated from the data by moments. A page is blocked when
the lower bound of its host's share of bad pages, a quantile of the beta posterior, is above a
threshold, so a host with little evidence is never blocked on a whim. The bound is above the
threshold exactly if the posterior leaves the threshold and what lies below it so little
probability, which is what is computed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import cut_lineage, map_batches, ship_with_tasks

ship_with_tasks(__name__)

#: Fixed values: (verdict, host and path); a rule fits its host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labels below which a country registers domains: with a last label of two letters they are one suffix.
SECOND_LABELS = ("ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gov", "govt", "id", "ind", "info", "lg", "ltd", "me", "mil",
                 "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "sch", "school")
BAD_SHARE = 0.5  #: a host is blocked when its share of bad pages is above this ...
CONFIDENCE = 0.95  #: ... with that probability
LEAST, MOST = 2.0, 1000.0  #: range of a concentration
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """What domains are registered below: one of ``suffixes`` (a full list of public suffixes, say; the
    longest fits), else two labels by ``SECOND_LABELS`` and a country, else the last label."""
    two = F.substring_index(host, ".", -2)
    found = F.when(two.rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$"), two).otherwise(F.substring_index(host, ".", -1))
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(host, ".", -labels)
        found = F.when(end.isin(*[s for s in suffixes if s.count(".") + 1 == labels]), end).otherwise(found)
    return found


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more, or the host itself if it has none."""
    rest = F.expr("length(host) - length(suffix) - 1")
    label = F.substring_index(F.when(rest > 0, F.substring(host, F.lit(1), rest)).otherwise(F.lit("")), ".", -1)
    return F.when(rest > 0, F.concat(label, F.lit("."), suffix)).otherwise(host)


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; ties by the rule's text."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shrunk(groups: DataFrame, prior: str) -> DataFrame:
    """Adds mean and strength of the posterior of each group (columns n, bad and ``prior``).

    Between-group variance by moments: what the squared deviations exceed the binomial noise by.
    """
    p = F.col(prior)
    share = F.col("bad") / F.when(F.col("n") > 0, F.col("n"))
    one = groups.agg(
        F.sum(F.col("n") * (share - p) * (share - p)).alias("dev"), F.sum(F.when(F.col("n") > 0, p * (1 - p))).alias("noise"),
        F.sum(F.col("n") * p * (1 - p)).alias("within"), F.sum("n").cast("double").alias("rows"))
    # rho = between variance / (between + within); the concentration is (1 - rho) / rho
    within = F.col("within") / F.when(F.col("rows") > 0, F.col("rows"))
    between = (F.col("dev") - F.col("noise")) / F.when(F.col("rows") > 0, F.col("rows"))
    raw = F.when(between > 0, within / between - 1).otherwise(F.lit(MOST))
    one = one.select(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(raw, F.lit(MOST)))).alias("pull"))
    # one row, so the join is a broadcast of one number
    scaled = groups.join(F.broadcast(one), F.lit(True))
    return scaled.withColumn("mean", (F.col("pull") * p + F.col("bad")) / (F.col("pull") + F.col("n"))).withColumn("strength", F.col("pull") + F.col("n")).drop("pull")


def beta_share_above(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Probability that a Beta(a, b) variable is above x: one minus the regularised incomplete beta
    function, by its continued fraction on the side where that converges fast."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.array([math.lgamma(i + j) - math.lgamma(i) - math.lgamma(j) for i, j in zip(p, q)])
    front = np.exp(front + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.where(abs(e := 1 - (p + q) * y / (p + 1)) < tiny, tiny, e)
    h, m = d.copy(), 0
    while True:
        m += 1
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = np.where(abs(c) < tiny, tiny, c)
            h *= d * c
        if not len(h) or np.abs(d * c - 1).max() < 1e-13:  # about the root of the larger number of steps
            return np.clip(np.where(turned, front * h, 1 - front * h), 0.0, 1.0)


def host_reputation(pages: DataFrame, outcomes: DataFrame, bad_share: float = BAD_SHARE, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """host, n, bad, mean, strength, bad_probability (that the share of bad pages is above
    ``bad_share``): one row per host of ``pages`` (page_id, url); ``outcomes`` has page_id and bad
    (boolean, null: no outcome)."""
    seen = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = pages.select("page_id", host_of(F.col("url")).alias("host")).join(seen, "page_id", "left")
    hosts = known.groupBy("host").agg(F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = cut_lineage(hosts, "hosts")  # every level reads it twice
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = by_suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    by_suffix = _shrunk(by_suffix.join(F.broadcast(top), F.lit(True)), "prior")
    domains = cut_lineage(domains.join(by_suffix.select("suffix", F.col("mean").alias("prior")), "suffix"), "domains")
    domains = _shrunk(domains, "prior")
    hosts = cut_lineage(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]), "shrunk")
    hosts = _shrunk(hosts, "prior").select("host", "n", "bad", "mean", "strength")

    def run(batches):
        for batch in batches:
            mean, strength = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mean", "strength"))
            p = beta_share_above(mean * strength, (1 - mean) * strength, bad_share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "bad_probability"])

    return map_batches(hosts, run, "host string, n bigint, bad bigint, mean double, strength double, bad_probability double")


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_share: float = BAD_SHARE, confidence: float = CONFIDENCE, suffixes: tuple[str, ...] = (),
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_probability.

    A null url or one without ``://`` has empty host and path; such pages share the reputation of
    the empty host. A null or repeated page_id is judged like any other (an outcome of a page_id
    counts for each of its rows; of several outcomes the bad one counts). Of two rules of the same
    length the one that comes later by code points holds. Urls are read whole, whatever their length. Other
    columns are ignored; an empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("first", first_rule(F.col("host"), F.col("path"), rules))
    bounds = host_reputation(pages, outcomes, bad_share, suffixes).select("host", "bad_probability")
    by_host = F.when(F.col("bad_probability") > confidence, "block").otherwise("allow")
    return judged.join(bounds, "host", "left").select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"),
        F.coalesce(F.col("first.verdict"), by_host).alias("verdict"), F.round("bad_probability", 6).alias("bad_probability"))


def _sql_level(name: str, source: str) -> str:
    return (
        f"{name}_pull AS (SELECT greatest({LEAST}::DOUBLE, least({MOST}::DOUBLE, coalesce(CASE WHEN (dev - noise) / rows > 0 THEN (within / rows) / ((dev - noise) / rows) - 1 ELSE {MOST}::DOUBLE END, {MOST}::DOUBLE))) AS pull FROM "
        f"(SELECT sum(n * (bad / nullif(n, 0) - prior) * (bad / nullif(n, 0) - prior)) AS dev, sum(CASE WHEN n > 0 THEN prior * (1 - prior) END) AS noise, sum(n * prior * (1 - prior)) AS within, nullif(CAST(sum(n) AS DOUBLE), 0) AS rows FROM {source})),\n"
        f"{name} AS (SELECT *, (pull * prior + bad) / (pull + n) AS mean, pull + n AS strength FROM {source}, {name}_pull)"
    )


_SQL_HOST = f"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_SQL_TAIL = "array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:{}]), '.')"
_SQL_RULES = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
_SQL_VERDICT = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES)
ORACLE = f"""WITH u AS (SELECT page_id, {_SQL_HOST} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM u LEFT JOIN o USING (page_id) GROUP BY host),
x0 AS (SELECT *, CASE WHEN regexp_matches({_SQL_TAIL.format(2)}, '^({'|'.join(SECOND_LABELS)})\\.[a-z][a-z]$') THEN {_SQL_TAIL.format(2)} ELSE {_SQL_TAIL.format(1)} END AS suffix FROM c),
h0 AS (SELECT *, CASE WHEN suffix = {_SQL_TAIL.format(2)} THEN {_SQL_TAIL.format(3)} ELSE {_SQL_TAIL.format(2)} END AS domain FROM x0),
d0 AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM d0 GROUP BY ALL),
s1 AS (SELECT s0.*, (SELECT (coalesce(CAST(sum(bad) AS BIGINT), 0) + 1) / (coalesce(CAST(sum(n) AS BIGINT), 0) + 2) FROM s0) AS prior FROM s0),
{_sql_level('s2', 's1')},
d1 AS (SELECT d0.*, s2.mean AS prior FROM d0 JOIN s2 USING (suffix)),
{_sql_level('d2', 'd1')},
h1 AS (SELECT h0.*, d2.mean AS prior FROM h0 JOIN d2 USING (domain, suffix)),
{_sql_level('h2', 'h1')},
v AS (SELECT host, mean * strength AS a, (1 - mean) * strength AS b FROM h2),
w AS (SELECT DISTINCT a, b FROM v),
i AS (SELECT a, b, list_sum(list_transform(range(CAST(200 + 4 * (a + b) AS BIGINT)), lambda n: exp(lgamma(a + b + n) - lgamma(a + 1 + n) - lgamma(b) + (a + n) * ln({BAD_SHARE}::DOUBLE) + b * ln(1 - {BAD_SHARE}::DOUBLE)))) AS below FROM w),
b AS (SELECT host, 1 - below AS p FROM v JOIN i USING (a, b)),
r AS (SELECT page_id, host, path, CASE {_SQL_RULES} END AS rule, p FROM u LEFT JOIN b USING (host))
SELECT page_id, host, path, rule, CASE rule {_SQL_VERDICT} ELSE CASE WHEN p > {CONFIDENCE}::DOUBLE THEN 'block' ELSE 'allow' END END AS verdict, round(p, 6) AS bad_probability FROM r"""

"""Licence validation, bundles, quotas and feature gates over whole logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.keys import KeyConfig, key_checksum_ok, key_format_ok, key_hash
from corpuslens.operators.ranking import bucketed_counts, bucketed_rank, carried
from corpuslens.session import cut_lineage, local_rows


def _candidates(aliases: Mapping[str, str]) -> Column:
    out = F.array("product")
    for product, alias in aliases.items():
        out = F.when(F.col("product") == product, F.array(F.col("product"), F.lit(alias))).otherwise(out)
    return out


def license_lookup(requests: DataFrame, licenses: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Adds the licence row for (key hash, product), falling back to the alias product.

    The lookup runs on distinct (key hash, product) pairs, however often a key is used; the
    request log itself is joined once, to that small result.
    """
    rows = requests.withColumn("key_hash", key_hash(F.col("license_key")))
    pairs = rows.select("key_hash", "product").distinct().withColumn("_cand", _candidates(aliases))
    lic = licenses.select(
        "key_hash", F.col("product").alias("_product"),
        F.struct("id", "tier", "active", "expires_at", F.col("product").alias("product")).alias("lic"))
    found = (
        pairs.select("key_hash", "product", F.posexplode("_cand").alias("_rank", "_product"))
        .join(lic, ["key_hash", "_product"]).groupBy("key_hash", "product").agg(F.min_by("lic", "_rank").alias("lic"))
    )
    return rows.join(found, ["key_hash", "product"], "left")


def validation_outcomes(
    requests: DataFrame, licenses: DataFrame, config: KeyConfig, aliases: Mapping[str, str]
) -> DataFrame:
    """First failing rule of: format, checksum, known, active, not expired at request time."""
    def any_product(test) -> Column:
        out = test(F.col("license_key"), F.col("product"), config)
        for product, alias in aliases.items():
            out = out | ((F.col("product") == product) & test(F.col("license_key"), F.lit(alias), config))
        return out

    rows = license_lookup(requests, licenses, aliases)
    result = (
        F.when(~any_product(key_format_ok), "invalid_format")
        .when(~any_product(key_checksum_ok), "invalid_checksum")
        .when(F.col("lic").isNull(), "not_found").when(~F.col("lic.active"), "revoked")
        .when(F.col("ts") > F.col("lic.expires_at"), "expired").otherwise("valid")
    )
    tier = F.when(F.col("result") == "valid", F.col("lic.tier")).otherwise("free")
    return rows.withColumn("result", result).select(
        "request_id", "ts", "key_hash", "machine_id", F.col("lic.id").alias("license_id"), "result",
        tier.alias("tier"),
    )


def machine_activity(outcomes: DataFrame) -> DataFrame:
    """First and last successful use per licence and machine."""
    used = outcomes.filter((F.col("result") == "valid") & F.col("machine_id").isNotNull())
    return used.groupBy("license_id", "machine_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merged_machines(current: DataFrame, update: DataFrame) -> DataFrame:
    """Upsert as an aggregate of both tables: earliest first_seen, latest last_seen."""
    return current.unionByName(update).groupBy("license_id", "machine_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def is_checkout() -> Column:
    """Billing events that buy something: completed checkouts with an address."""
    return (F.col("event_type") == "checkout.session.completed") & F.col("email").isNotNull()


def bought_products(default: Sequence[str]) -> tuple[Column, Column]:
    """(products that a checkout buys, number of its bundle or null): a listed bundle, the default bundle, or one product."""
    listed = F.filter(F.transform(F.split("bundle_products", ","), lambda p: F.trim(p)), lambda p: p != "")
    bundle = F.when(F.size(listed) > 0, listed).otherwise(F.array(*[F.lit(p) for p in default]))
    is_bundle = F.col("product") == "bundle"
    return F.when(is_bundle, bundle).otherwise(F.array("product")), F.when(is_bundle, F.concat(F.lit("bundle-"), F.col("event_id").cast("string")))


def bundle_products(events: DataFrame, default: Sequence[str]) -> DataFrame:
    """One row per product a checkout buys."""
    products, bundle_id = bought_products(default)
    return events.filter(is_checkout()).select(
        F.col("event_id").alias("checkout_id"), "ts", "subscription_id", "email", bundle_id.alias("bundle_id"),
        F.posexplode(products).alias("item_no", "bought"),
    ).withColumnRenamed("bought", "product")


def revoked_with_siblings(licenses: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Active licences of cancelled subscriptions and all active licences of their bundles."""
    active = licenses.filter("active")
    seeds = active.join(cancelled.select("subscription_id").distinct(), "subscription_id", "left_semi")
    bundles = seeds.select("bundle_id").filter(F.col("bundle_id").isNotNull()).distinct()
    siblings = active.join(bundles, "bundle_id", "left_semi")
    cols = licenses.columns
    return seeds.select(*cols).unionByName(siblings.select(*cols)).distinct()


def license_states(events: DataFrame, default_bundle: Sequence[str], bucket_seconds: int = 86400) -> DataFrame:
    """Licence state from billing events: bought licences, revoked by the first cancellation of
    their subscription that is not earlier. Failed payments and other types change nothing.

    The next cancellation is carried backwards in time, per subscription and time bucket, so a
    subscription with many events makes neither a hot task nor pairs of all its events.
    """
    made = bundle_products(events, default_bundle)
    back = (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("_back")
    ended = events.filter(F.col("event_type") == "customer.subscription.deleted").select(
        "subscription_id", back, F.lit(0).alias("_side"), F.col("ts").alias("_end"), F.lit(None).cast("bigint").alias("checkout_id"))
    bought = made.select(
        "subscription_id", back, F.lit(1).alias("_side"), F.lit(None).cast(events.schema["ts"].dataType).alias("_end"), "checkout_id").distinct()
    both = carried(
        ended.unionByName(bought), ["subscription_id"], F.floor(F.col("_back") / (bucket_seconds * 1_000_000)),
        ["_back", "_side", "checkout_id"], {"revoked_at": F.col("_end")})
    first = both.filter(F.col("_side") == 1).select("checkout_id", "revoked_at")
    return made.join(first, "checkout_id", "left").withColumn("active", F.col("revoked_at").isNull())


def gated_commands(commands: DataFrame) -> DataFrame:
    """Commands whose feature the tier does not include: anti join on (tier, feature)."""
    rows = [("free", f) for f in fixed.FREE_FEATURES] + [("pro", f) for f in fixed.PRO_FEATURES]
    features = F.broadcast(local_rows(commands.sparkSession, rows, "tier string, feature string"))
    return commands.join(features, ["tier", "feature"], "left_anti")


# ---- quotas -------------------------------------------------------------------------
def tier_limit(tier: Column, scan_type: Column) -> Column:
    """Limit of a tier and type; an unknown tier counts as free, an unknown type as 0."""
    known = [t for t, _, _ in fixed.TIER_LIMITS]
    tier = F.when(tier.isin(*known), tier).otherwise("free")
    out = F.lit(0)
    for t, s, limit in fixed.TIER_LIMITS:
        out = F.when((tier == t) & (scan_type == s), limit).otherwise(out)
    return out


def period_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def usage_counts(usage: DataFrame) -> DataFrame:
    return usage.withColumn("period", period_key(F.col("ts"))).groupBy(
        "license_id", "scan_type", "period").agg(F.count("*").alias("n"))


def audits_per_repo(usage: DataFrame) -> DataFrame:
    rows = usage.filter((F.col("scan_type") == "audit") & F.col("repo_fingerprint").isNotNull())
    return rows.groupBy("license_id", "repo_fingerprint").agg(F.count("*").alias("n"))


def quota_admission(requests: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Replays a request log against the tier limits: allowed, used and remaining per request.

    Audits of a known repository count per (licence, repository) over all time, everything else
    per (licence, type, month). Denied requests are not recorded, so admission is a rank:

    * a repository audit is allowed while its rank among the audits of that repository is
      within the limit;
    * any other request is allowed while its rank among the requests that count for it is; for
      audits without a repository these include the admitted repository audits of the month.

    Ranks are taken per time bucket, so one licence with most of the requests is spread. The log is
    read once; what is read again is written as narrow rows.
    """
    order = [F.col("ts"), F.col("request_id")]
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_seconds)
    rows = requests.withColumn("period", period_key(F.col("ts"))).withColumn(
        "limit", tier_limit(F.col("tier"), F.col("scan_type")))
    rows = cut_lineage(
        rows.select("request_id", "license_id", "scan_type", "repo_fingerprint", "ts", "period", "limit"), "requests")
    by_repo = (F.col("scan_type") == "audit") & F.col("repo_fingerprint").isNotNull()
    unlimited = F.col("limit") == -1

    repo = bucketed_rank(rows.filter(by_repo), ["license_id", "repo_fingerprint"], bucket, order, "n")
    repo = repo.withColumn("allowed", unlimited | (F.col("n") <= F.col("limit"))).withColumn(
        "before", F.when(unlimited, F.col("n") - 1).otherwise(F.least(F.col("n") - 1, F.col("limit"))))
    repo = cut_lineage(repo, "repository-audits")

    key = ["license_id", "scan_type", "period"]
    plain = rows.filter(~by_repo)
    counted = plain.withColumn("_plain", F.lit(True)).unionByName(
        repo.filter("allowed").select(*plain.columns).withColumn("_plain", F.lit(False)))
    ranked = cut_lineage(bucketed_counts(counted, key, bucket, order, {"c": F.lit(True), "m": F.col("_plain")}), "counted")
    # admitted repository audits among the first ``limit`` rows of the key
    early = ranked.filter(~F.col("_plain") & (F.col("c") <= F.col("limit"))).groupBy(*key).agg(F.count("*").alias("_early"))
    own = ranked.filter("_plain").join(early, key, "left").fillna(0, ["_early"])
    inside = unlimited | (F.col("c") <= F.col("limit"))
    own = own.withColumn("allowed", inside).withColumn(
        "before", F.when(inside, F.col("c") - 1)
        .otherwise(F.col("c") - F.col("m") + F.col("limit") - F.col("_early")))

    cols = [*rows.columns, "allowed", "before"]
    every = repo.select(*cols).unionByName(own.select(*cols))
    used = F.col("before") + F.col("allowed").cast("int")
    remaining = F.when(~F.col("allowed"), 0).when(unlimited, -1).otherwise(F.greatest(F.lit(0), F.col("limit") - used))
    return every.select(
        "request_id", "license_id", "scan_type", "period", "limit", "allowed",
        used.cast("bigint").alias("used"), remaining.cast("bigint").alias("remaining"))


def anonymous_id(key: Column) -> Column:
    """Usage id of a key that is not a licence."""
    return F.concat(F.lit("free:"), F.substring(key_hash(key), 1, 16))

"""Registered queries of this package with their check SQL."""

from __future__ import annotations

from corpuslens.llm import decontaminate, exact_dedup, filter_audit, jaccard_join, language_id, mixing, periodic_runs, quality_rules, secrets, suffix_dedup, token_archive, url_filter, warc

QUERIES = {}
ORACLES = {}


def _table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path() -> str:
    """The vocabulary file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


@query("op2_url_filter", url_filter.ORACLE)
def op2_url_filter(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    # a page is labelled through the document of the same number: bad when toxic or of low quality,
    # null (no outcome) where a missing label could make it so
    outcomes = labels.selectExpr("doc_id AS page_id", "toxic = 1 OR quality = 0 AS bad")
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages", "page_id", "url"), outcomes)


@query("op3_jaccard_join")
def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key", "stays")


@query("op4_mixing", mixing.ORACLE)
def op4_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query("op5_warc", warc.ORACLE)
def op5_warc(spark, sf_dir):
    return warc.archive_round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op6_secret_scan", secrets.ORACLE)
def op6_secret_scan(spark, sf_dir):
    return secrets.secret_scan(_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_exact_dedup", exact_dedup.ORACLE)
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_token_archive")
def op8_token_archive(spark, sf_dir):
    return token_archive.token_round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    return language_id.language_of_documents(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op10_decontaminate", decontaminate.ORACLE)
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op11_filter_audit", filter_audit.ORACLE)
def op11_filter_audit(spark, sf_dir):
    return filter_audit.interaction_audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op12_quality_rules", quality_rules.ORACLE)
def op12_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("rule_ablations", quality_rules.ABLATION_ORACLE)
def rule_ablations(spark, sf_dir):
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents", "doc_id", "text")))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents", "doc_id", "text"), periodic_runs.planted))

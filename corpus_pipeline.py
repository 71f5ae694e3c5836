"""The training-text pipeline: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import decontaminate, jaccard_join, language_id, mixing, token_archive
from corpuslens.llm.queries import tokenizer_path
from corpuslens.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told. The model learns from the labelled documents
    of this input that are not held out."""
    return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out(docs["doc_id"]))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard_join.kept_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their weights: a document is left out or comes up to three times."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return token_archive.token_round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
    ("token_archive", tokenized),
]

#: SQL can say neither the trained language model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

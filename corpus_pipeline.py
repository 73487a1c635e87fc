"""From raw documents to packed training sequences: five stages, each a DataFrame operation on what the last one kept.

``STAGES`` lists them; each takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of ``documents`` in all
but the last. ``run`` applies them to the documents of a folder and writes what each stage returns, so that a lost
executor costs the work of one stage at most.

Defined results: a document with a null or empty text fails the rules and goes; of repeated rows one stays; null ids,
languages and sources pass, a null id counting as the smallest in exact and as the largest in near deduplication; texts of
any length are treated whole; other columns pass through the first four stages, whatever their names; empty tables stay
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumipair.llm.exact_dedup import drop_copies
from lumipair.llm.near_dedup import keep_one
from lumipair.llm.packing import pack_documents
from lumipair.llm.pii import redact
from lumipair.llm.quality_rules import keep_good
from lumipair.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the production policy go."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: doc_id, piece, bin, begin, n_tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Fingerprints, the search for personal data and packing have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

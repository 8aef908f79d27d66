"""Training-corpus pipeline: stages over the documents table, each on what its predecessor kept.

Rejected documents go, one of each group of similar documents stays, documents that
hold a benchmark item go, secrets are replaced by their kind in brackets, and the
rest is encoded. SQL cannot express the stages; tests hold them against brute force.

Every stage judges a row by its own text, so rows without doc_id and rows that share
one are defined: a group of similar rows keeps that of smallest doc_id (null last),
then of smallest hash; null texts count as empty, which the classifier gives its
prior, which link with nothing, hold no item and no secret, and have no ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from placelens.llm import decontamination, jaccard_join, quality_classifier, secret_scan, sentencepiece_bpe
from placelens.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets."""
    return jaccard_join.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    model = sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_bpe.encode(docs, model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("encode", encode),
]

#: Not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

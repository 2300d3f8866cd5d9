"""The corpus pipeline: five stages over `documents`, each a corpus operator applied to all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of documents; the
last adds how often each document is taken.  `run` writes each stage to the shared folder and reads it again.
Nulls, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, exact_dedup, language_mixture, mixing, near_dedup
from tracelake.llm.common import documents, staged, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in learned languages: those go whose words, by the inferred mixture, mostly fit none of them."""
    return language_mixture.accepted(docs, language_mixture.train(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id."""
    return near_dedup.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that hold benchmark windows; n_chars follows the text."""
    clean = decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with size, source_size, target, taken and copies."""
    return mixing.sample(docs)


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]
#: Mixture inference is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Corpus pipeline: each stage works on all rows that the one before it kept.

Documents whose language stays unknown or is surely another than they say go, one document of each near-duplicate group stays, personal data are replaced by their kinds,
sources are mixed to their target weights, and the result is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.langid import identified
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import redacted
from gridloom.llm.simhash import keep_one
from gridloom.sources.tables import drop, materialize, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Fingerprints, automata and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed mixture: all stages over ``documents``, each result written and read again.

    What a stage wrote for itself, and the result that it read, are dropped once its own result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        own = written()
        docs = materialize(docs)
        drop(own - before)
    return STAGES[-1][1](spark, docs, sf_dir)

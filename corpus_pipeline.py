"""Cleans ``documents`` for training: five stages, each of which reads what its predecessor kept.

Toxic documents go, then copies, then near copies, then documents with benchmark passages; the last stage encodes what is left.
All stages but the last return the columns of ``documents``. Edge cases are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.bpe import token_report
from larkspur.llm.common import read_table, stored
from larkspur.llm.decontamination import drop_contaminated
from larkspur.llm.exact_dedup import keep_one_per_text
from larkspur.llm.ngram_join import keep_one_per_group
from larkspur.llm.toxicity import drop_toxic, fit_toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_text(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number of tokens, hash of the ids, hash of the decoded text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_report(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE encoding and decoding", encoded),
]

# The classifier and the encoder cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

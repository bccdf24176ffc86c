"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes the documents that its predecessor kept and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from servelens.llm import bpe, mixing, near_copies, pii, quality_rules
from servelens.llm.common import table
from servelens.session import stage


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on words and repetition keep."""
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more, candidates
    by SimHash with pigeonring and by MinHash bands."""
    return near_copies.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed as little-endian unsigned 32-bit integers."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", good_texts),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: SQL has no suffix arrays, XXH64 fingerprints or byte-pair merges; tests compare the stages with
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs

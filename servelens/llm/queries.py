"""The corpus operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from servelens.llm import (
    bpe,
    embedding_dups,
    lexical,
    merkle,
    mixing,
    pii,
    quality_rank,
    quality_rules,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from servelens.llm.common import pick, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(table(spark, sf_dir, "documents"), "doc_id", "text")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.rank_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(_documents(spark, sf_dir))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op7_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_embeddings(table(spark, sf_dir, "embeddings"))


def op8_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_documents(spark, sf_dir))


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_merkle_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_suffix_repetition,
        op2_bradley_terry_quality,
        op3_prefix_bpe,
        op4_toxic_segments,
        op5_simhash_pigeonring,
        op6_token_counts,
        op7_embedding_collisions,
        op8_secret_layers,
        op9_contextual_pii,
        op10_water_filling,
        op11_merkle_checkpoints,
        op12_warc_index,
        op13_geometric_blocks,
    )
}

"""Token accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.functions.requests import safe_key


def token_chargeback(*usage: DataFrame) -> DataFrame:
    """Prompt and completion tokens per (user, model) over any number of usage tables.

    Counts at or below zero do not enter; a key whose counts are all such does not appear.
    """
    columns = ["user_name", "model", "prompt_tokens", "completion_tokens"]
    merged = usage[0].select(*columns)
    for extra in usage[1:]:
        merged = merged.unionByName(extra.select(*columns))
    positive = merged.filter((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0))
    return positive.groupBy(
        safe_key("user_name").alias("user_name"), safe_key("model").alias("model")
    ).agg(
        F.sum(F.greatest("prompt_tokens", F.lit(0))).alias("tokens_in"),
        F.sum(F.greatest("completion_tokens", F.lit(0))).alias("tokens_out"),
    )


def merge_token_counters(tokens_in: DataFrame, tokens_out: DataFrame) -> DataFrame:
    """Union of the keys of two counter tables; the missing side counts zero."""
    keys = ["user_name", "model"]
    zero = F.lit(0).cast("bigint")
    sides = tokens_in.select(*keys, "tokens_in", zero.alias("tokens_out")).unionByName(
        tokens_out.select(*keys, zero.alias("tokens_in"), "tokens_out")
    )
    return (
        sides.groupBy(*keys)
        .agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
        .withColumn("total", F.col("tokens_in") + F.col("tokens_out"))
    )


def top_consumers(chargeback: DataFrame, n: int = 10) -> DataFrame:
    """Heaviest (user, model) pairs; equal totals are ordered by name."""
    return (
        chargeback.withColumn("total", F.col("tokens_in") + F.col("tokens_out"))
        .orderBy(F.desc("total"), "user_name", "model")
        .limit(n)
    )

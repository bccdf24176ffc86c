"""The joins of candidates of near copies: what comes many times over must not be gathered on the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelens.llm import near_copies


def test_listed_fingerprints_of_nodes_are_never_broadcast(spark):
    """Only the two ends, a row for each fingerprint, may be broadcast."""
    nodes = spark.range(40).select(
        F.col("id").alias("node"), F.lit(9).cast("long").alias("n"),
        (F.col("id") * 0x0101_0101_0101_0101).alias("fp"), F.array().cast("array<long>").alias("keys"),
    )
    plan = near_copies.candidates(nodes)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "[key#" in x], joins
    assert any("SortMergeJoin [key#" in x for x in plan.splitlines())

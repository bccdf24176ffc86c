"""The catalog's joins: what comes many times over must not be gathered on the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelens.operators import access


def test_names_by_prefix_are_never_broadcast(spark):
    """Small tables by estimate, whose names come once per prefix and fragment."""
    n = F.col("id")
    name = F.concat(F.lit("model-"), n)
    parts = spark.range(60)
    users = parts.select(F.concat(F.lit("u"), n % 9).alias("user_name"), F.array(F.lit("g")).alias("groups"))
    grants = parts.select(
        F.lit("group").alias("principal_type"), F.lit("g").alias("principal"),
        F.explode(F.array(F.lit("list"), F.lit("metadata"))).alias("access"),
        F.when(n % 3 == 0, F.concat(name, F.lit("*"))).otherwise(name).alias("resource_glob"),
    )
    out = access.visible_catalog(
        users, parts.select(name.alias("model")), parts.select(name.alias("base"), F.lit("a").alias("adapter")),
        parts.select(name.alias("name")), grants,
    )
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "__prefix" in x or "model" in x], joins
    assert {r.kind for r in out.select("kind").distinct().collect()} == {"model", "adapter", "loaded"}

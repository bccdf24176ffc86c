"""The joins of fingerprints: what comes many times over must not be gathered on the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelens.llm import simhash


def test_listed_fingerprints_are_never_broadcast(spark):
    """Fingerprints small by estimate, each listed under 68 keys: neither side of their join is broadcast."""
    prints = spark.range(40).select((F.col("id") * 0x0101_0101_0101_0101).alias("fp"))
    found = simhash.links(prints.union(prints.select(F.col("fp").bitwiseXOR(1 << 17))))
    plan = found._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    want = {(int(r.fp), int(r.fp) ^ 1 << 17) for r in prints.collect()}
    assert want <= {tuple(sorted((r.u, r.v), key=lambda x: x in {w[1] for w in want})) for r in found.collect()}
    assert "Broadcast" not in plan.toString()

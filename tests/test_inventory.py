"""Changes between two listings, with the kept one not shuffled."""

from __future__ import annotations

import uuid

from servelens.sources import inventory

FILES = "path string, length long, modified timestamp"


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, length long, at long").selectExpr(
        "path", "length", "timestamp_seconds(at) AS modified"
    )


BEFORE = [("/r/a/1", 5, 1), ("/r/a/2", 5, 1), ("/r/b/1", 1, 1), ("/r/c/x/1", 9, 1), ("/r/top", 1, 1), ("/r/e/1", None, None), (None, 1, 1)]
AFTER = [("/r/a/1", 5, 1), ("/r/a/2", 7, 1), ("/r/a/3", 1, 1), ("/r/c/x/1", 9, 1), ("/r/d/1", 2, 2), ("/r/top", 2, 1), ("/r/e/1", None, None)]


def kept(spark, rows):
    return inventory.keep_snapshot(listing(spark, rows), f"snap_{uuid.uuid4().hex}", buckets=4)


def test_changes(spark):
    before, after = kept(spark, BEFORE), listing(spark, AFTER)
    files = {r.path: (r.change, r.bytes_before, r.bytes_after) for r in inventory.file_changes(before, after).collect()}
    assert files == {
        "/r/a/2": ("changed", 5, 7), "/r/a/3": ("added", None, 1), "/r/b/1": ("removed", 1, None),
        "/r/d/1": ("added", None, 2), "/r/top": ("changed", 1, 2),
    }
    models = {tuple(r) for r in inventory.model_changes(before, after, "/r").collect()}
    assert models == {("a", "changed", 1, 0, 1, 3), ("b", "removed", 0, 1, 0, -1), ("d", "added", 1, 0, 0, 2)}
    nothing = listing(spark, []).where("1 = 0")
    assert {r.change for r in inventory.model_changes(kept(spark, []), after, "/r").collect()} == {"added"}
    assert {r.change for r in inventory.model_changes(before, nothing, "/r").collect()} == {"removed"}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_snapshots_are_not_shuffled(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = kept(spark, BEFORE)
        assert exchanges(inventory.file_changes(before, listing(spark, AFTER))) == 1
        assert exchanges(inventory.file_changes(before, kept(spark, AFTER))) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

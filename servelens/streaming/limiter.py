"""Rate limits on a stream, with rule versions re-read for every micro-batch.

The batch operators do the work, so a bucket that receives most of the traffic is spread over
time slices exactly as in batch. State is one row per bucket, written per epoch in the shared
folder: a replayed epoch reads the same predecessor and overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servelens.operators.quota import (
    WINDOW_MS,
    carry_buckets,
    decide,
    match_quota_rule,
    rank_requests,
    rules_asof,
)
from servelens.sources.policies import load_quota_rules, valid_versions

STATE_SCHEMA = (
    "bucket string, first_ms bigint, capacity int, window_start_ms bigint, used bigint"
)


class StreamLimiter:
    """``foreachBatch`` target: decisions go to ``out_dir``, bucket state to ``state_dir``.

    ``versions_path`` is a table of rule documents (version, valid_from_ms, doc). A new version
    applies to requests from its time on and has buckets of its own.
    """

    def __init__(
        self,
        versions_path: str,
        state_dir: str,
        out_dir: str,
        window_ms: int = WINDOW_MS,
        fallback: str | None = None,
    ):
        self.versions_path, self.state_dir, self.out_dir = versions_path, state_dir, out_dir
        self.window_ms, self.fallback = window_ms, fallback

    def rules(self, spark: SparkSession, first_ms: int, last_ms: int) -> DataFrame:
        """The valid rule documents in force at some time between the two."""
        docs = valid_versions(spark.read.parquet(self.versions_path), self.fallback)
        at = F.col("valid_from_ms")
        start = docs.filter(at <= first_ms).agg(F.max(at)).scalar()
        return docs.filter((at <= last_ms) & (at >= F.coalesce(start, F.lit(first_ms))))

    def carried(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """State left by the previous epoch; a missing one is an error except for the first."""
        if epoch == 0:
            return None
        return spark.read.schema(STATE_SCHEMA).parquet(f"{self.state_dir}/epoch-{epoch - 1}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first_ms, last_ms = batch.agg(F.min("ts_ms"), F.max("ts_ms")).first()
        docs = self.rules(spark, first_ms or 0, last_ms or 0)
        carried = self.carried(spark, epoch)
        if carried is not None and first_ms is not None:
            # Buckets of documents that no request of now can meet are let go.
            version = F.substring_index("bucket", "@", -1)
            live = docs.select(F.col("version").cast("string").alias("__v")).distinct()
            carried = carried.join(live, version == F.col("__v"), "left_semi")
        versions = docs.select("version", "valid_from_ms")
        matched = match_quota_rule(
            rules_asof(batch, versions), load_quota_rules(docs), version="version"
        )
        placed = rank_requests(matched, self.window_ms, carried=carried)
        target = f"{self.out_dir}/epoch-{epoch}"
        decide(placed, self.window_ms).write.mode("overwrite").parquet(target)
        written = spark.read.parquet(target)
        carry_buckets(written, carried).write.mode("overwrite").parquet(
            f"{self.state_dir}/epoch-{epoch}"
        )
        if epoch >= 2:
            # The state before the last one is of no use to a replay any more.
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.state_dir}/epoch-{epoch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def reload_alerts(versions: DataFrame, seen_until_ms: int | None = None) -> DataFrame:
    """A ``quota_reloaded`` alert per version that took effect after ``seen_until_ms``."""
    fresh = versions if seen_until_ms is None else versions.filter(
        F.col("valid_from_ms") > seen_until_ms
    )
    return fresh.select(
        F.col("valid_from_ms").alias("alert_id"),
        F.col("valid_from_ms").alias("ts_ms"),
        F.lit("quota_reloaded").alias("alert_type"),
        F.concat(
            F.lit("New quota rules in force: document of "),
            F.octet_length("doc").cast("string"),
            F.lit(" bytes"),
        ).alias("message"),
        F.lit("info").alias("severity"),
    )

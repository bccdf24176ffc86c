"""Latency quantiles on a stream: a mergeable sketch per window and model, merged over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.streaming.aggregates import event_time

#: Size of a sketch. Its rank error is about 1.65 / K, and none while it has seen at most K values.
K = 8192


def windowed_sketches(
    requests: DataFrame, window: str = "1 hour", watermark: str | None = None, value: str = "latency_us", k: int = K
) -> DataFrame:
    """(window_start_ms, model, count, sketch) of a whole-number column; same plan for batch and stream.

    The state of a window is one KLL sketch per model, however many values it has seen. Nulls are not
    counted.
    """
    timed = event_time(requests.where(F.col(value).isNotNull()), watermark)
    return (
        timed.groupBy(F.window("event_time", window).alias("w"), "model")
        .agg(F.count(value).alias("count"), F.kll_sketch_agg_bigint(value, k).alias("sketch"))
        .select(F.unix_millis("w.start").alias("window_start_ms"), "model", "count", "sketch")
    )


def merged_quantiles(sketches: DataFrame, probs: dict[str, float], keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Quantiles per key over all windows of ``sketches(keys, count, sketch)``: the number of values and a
    column per entry of ``probs``, each the smallest value whose estimated rank reaches the share."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("count").alias("requests"), F.kll_merge_agg_bigint("sketch").alias("__sketch")
    )
    found = [F.kll_sketch_get_quantile_bigint("__sketch", F.lit(p)).alias(n) for n, p in probs.items()]
    return merged.select(*keys, "requests", *found)

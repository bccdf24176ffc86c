"""Per-model request metrics: counters, histograms, percentiles, shadow comparison.

Inputs are *forwarded* requests: ``request_id, ts_ms, model, status, latency_us``.
Latencies are integer microseconds, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from servelens.operators.skew import (
    exact_quantiles,
    group_key,
    order_key,
    sliced_lag,
    time_slice,
    top_n_per_key,
)

# Histogram upper bounds in seconds and the percentile labels.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
PERCENTILES = {"p50": 50, "p95": 95, "p99": 99}
RECENT_SAMPLES = 1000
SHADOW_PREFIX = "shadow:"


def succeeded(status: Column | str = "status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.floor(s / 100) == 2, F.lit(False))


def request_counts(requests: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(succeeded()).alias("success"),
        F.count_if(~succeeded()).alias("errors"),
    )


def error_rate(requests: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    counts = request_counts(requests, keys)
    return counts.select(*keys, safe_rate("errors", "requests").alias("error_rate"))


def safe_rate(part: Column | str, whole: Column | str) -> Column:
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(p.cast("double"), w.cast("double")), F.lit(0.0))


def _bucket_columns(latency: str) -> list[Column]:
    return [
        F.count_if(F.col(latency) <= round(le * 1_000_000)).alias(f"__le_{i}")
        for i, le in enumerate(LATENCY_BUCKETS)
    ]


def bucket_rows() -> Column:
    """Exploded (le, le_sec, cum_count) rows over the columns of :func:`_bucket_columns`."""
    rows = [
        F.struct(
            F.lit(str(le)).alias("le"),
            F.lit(le).alias("le_sec"),
            F.col(f"__le_{i}").alias("cum_count"),
        )
        for i, le in enumerate(LATENCY_BUCKETS)
    ]
    rows.append(
        F.struct(
            F.lit("+Inf").alias("le"),
            F.lit(float("inf")).alias("le_sec"),
            F.col("count").alias("cum_count"),
        )
    )
    return F.explode(F.array(*rows))


def latency_histogram(
    requests: DataFrame, keys: Sequence[str] = ("model",), latency: str = "latency_us"
) -> DataFrame:
    """Cumulative buckets in long form: keys, le, cum_count, sum_us, count. One aggregation."""
    return (
        requests.groupBy(*keys)
        .agg(
            *_bucket_columns(latency),
            F.sum(latency).alias("sum_us"),
            F.count(latency).alias("count"),
        )
        .select(*keys, bucket_rows().alias("b"), "sum_us", "count")
        .select(*keys, "b.le", "b.le_sec", "b.cum_count", "sum_us", "count")
    )


def histogram_quantile(
    histogram: DataFrame, q: float, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Interpolated quantile from cumulative buckets, summed over replicas first.

    A rank beyond the last finite bound gives that bound; no observations give null.
    """
    merged = histogram.groupBy(*keys, "le_sec").agg(F.sum("cum_count").alias("cum"))
    ordered = W.partitionBy(*keys).orderBy("le_sec")
    every = W.partitionBy(*keys)
    infinite = F.col("le_sec") == float("inf")
    placed = (
        merged.withColumn("lo", F.coalesce(F.lag("le_sec").over(ordered), F.lit(0.0)))
        .withColumn("below", F.coalesce(F.lag("cum").over(ordered), F.lit(0)))
        .withColumn("total", F.max("cum").over(every))
        .withColumn("rank", F.lit(float(q)) * F.col("total"))
    )
    inside = (F.col("rank") - F.col("below")) / (F.col("cum") - F.col("below"))
    value = F.when(infinite, F.col("lo")).otherwise(
        F.col("lo") + (F.col("le_sec") - F.col("lo")) * F.coalesce(inside, F.lit(0.0))
    )
    reached = (F.col("cum") >= F.col("rank")) & (F.col("total") > 0)
    return placed.groupBy(*keys).agg(
        F.min_by(F.when(reached, value), F.when(reached, F.col("le_sec"))).alias("quantile_sec")
    )


def last_n(
    df: DataFrame,
    n: int,
    order: Sequence[str] = ("ts_ms", "request_id"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Newest ``n`` rows per key, or of the whole table when there are no keys."""
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    return top_n_per_key(df, keys, newest, n, row_id=order)


def nearest_rank(sorted_values: Column, percent: int) -> Column:
    index = F.ceil(F.lit(percent / 100.0) * F.size(sorted_values)).cast("int")
    return F.element_at(sorted_values, F.greatest(F.lit(1), index))


def recent_percentiles(
    requests: DataFrame,
    keys: Sequence[str] = ("model",),
    n: int = RECENT_SAMPLES,
    latency: str = "latency_us",
) -> DataFrame:
    """p50/p95/p99 over the newest ``n`` samples per key; at most ``n`` values meet in a group."""
    recent = last_n(
        requests.select(*keys, "ts_ms", "request_id", latency), n, keys=keys
    )
    values = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(latency)).alias("__v"))
    return values.select(
        *keys,
        *[nearest_rank(F.col("__v"), p).alias(f"{name}_us") for name, p in PERCENTILES.items()],
        F.size("__v").cast("bigint").alias("samples"),
    )


def tracked_models(latencies: DataFrame, requests: DataFrame) -> DataFrame:
    return latencies.select("model").union(requests.select("model")).distinct()


def model_scorecard(
    requests: DataFrame, keys: Sequence[str] = ("model",), recent: int | None = None
) -> DataFrame:
    """Counts, error rate and percentiles per key; a null key is a key.

    Percentiles cover all requests, or the newest ``recent`` ones of each key.
    """
    counts = request_counts(requests, keys)
    if recent is None:
        probs = {f"{name}_us": p / 100 for name, p in PERCENTILES.items()}
        times = exact_quantiles(requests, keys, "latency_us", probs)
    else:
        times = recent_percentiles(requests, keys, recent).drop("samples")
    zero = {f"{p}_us": 0 for p in PERCENTILES}
    keyed = times.withColumn("__key", group_key(keys)).drop(*keys)
    return (
        counts.withColumn("__key", group_key(keys))
        .join(keyed, "__key", "left")
        .drop("__key")
        .fillna(zero, list(zero))
        .withColumn("error_rate", safe_rate("errors", "requests"))
    )


def shadow_compare(requests: DataFrame, recent: int | None = None) -> DataFrame:
    """Primary against mirrored traffic, side by side per model, with shadow minus primary.

    Requests without a model are primary ones of the model null.
    """
    is_shadow = F.coalesce(F.startswith(F.col("model"), F.lit(SHADOW_PREFIX)), F.lit(False))
    name = F.when(is_shadow, F.substring("model", len(SHADOW_PREFIX) + 1, 1 << 20)).otherwise(
        F.col("model")
    )
    measures = ["requests", "error_rate", "p50_us", "p95_us", "p99_us"]
    sides = {"primary": ~is_shadow, "shadow": is_shadow}
    paired = (
        model_scorecard(requests, recent=recent)
        .groupBy(name.alias("model"))
        .agg(
            *[
                F.max(F.when(cond, F.col(m))).alias(f"{side}_{m}")
                for side, cond in sides.items()
                for m in measures
            ]
        )
    )
    deltas = [
        (F.col(f"shadow_{m}") - F.col(f"primary_{m}")).alias(f"delta_{m}") for m in measures[1:]
    ]
    return paired.select("*", *deltas)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], value: str, ts_ms: str = "ts_ms", seq: str = "event_id"
) -> DataFrame:
    """Last written value per key; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, order_key(ts_ms, seq)).alias(value))


def counter_increase(
    samples: DataFrame,
    keys: Sequence[str],
    window_ms: int,
    value: str = "value",
    slice_ms: int = 3_600_000,
) -> DataFrame:
    """Growth of monotone counters per tumbling window; a drop means the counter restarted."""
    with_prev = sliced_lag(
        samples, keys, ["ts_ms", "seq"], time_slice("ts_ms", slice_ms), {value: "__prev"}
    )
    step = (
        F.when(F.col("__prev").isNull(), F.lit(0))
        .when(F.col(value) < F.col("__prev"), F.col(value))
        .otherwise(F.col(value) - F.col("__prev"))
    )
    start = time_slice("ts_ms", window_ms) * window_ms
    return (
        with_prev.withColumn("__step", step)
        .groupBy(*keys, start.alias("window_start_ms"))
        .agg(F.sum("__step").alias("increase"))
        .withColumn("rate_per_sec", F.col("increase") * 1000.0 / window_ms)
    )

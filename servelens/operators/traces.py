"""Spans and service logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.operators.skew import exact_quantiles


def proxy_overhead(spans: DataFrame) -> DataFrame:
    """Server time minus upstream client time, per model / user / stream.

    ``spans``: trace_id, span_id, parent_span_id, kind, start_us, end_us, attrs.
    """
    duration = F.col("end_us") - F.col("start_us")
    server = spans.filter(F.col("kind") == "SERVER").select(
        "trace_id",
        "span_id",
        F.col("attrs")["model"].alias("model"),
        F.col("attrs")["user"].alias("user_name"),
        F.coalesce(F.col("attrs")["stream"] == "true", F.lit(False)).alias("stream"),
        duration.alias("server_us"),
    )
    client = spans.filter(F.col("kind") == "CLIENT").groupBy(
        "trace_id", F.col("parent_span_id").alias("span_id")
    ).agg(F.sum(duration).alias("client_us"))
    keys = ["model", "user_name", "stream"]
    joined = server.join(client, ["trace_id", "span_id"]).withColumn(
        "overhead_us", F.greatest(F.col("server_us") - F.col("client_us"), F.lit(0))
    )
    return exact_quantiles(
        joined,
        keys,
        "overhead_us",
        {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99},
        totals=("calls", "overhead_sum_us"),
    )


def correlate_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Log lines and warnings / errors per server span; lines are counted before the join."""
    counts = (
        logs.filter(F.col("mdc")["trace_id"].isNotNull())
        .groupBy(F.col("mdc")["trace_id"].alias("trace_id"), F.col("mdc")["span_id"].alias("span_id"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("level") == "WARN").alias("warnings"),
            F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"),
        )
    )
    return (
        spans.filter(F.col("kind") == "SERVER")
        .select("trace_id", "span_id", "name")
        .join(counts, ["trace_id", "span_id"], "left")
        .fillna(0, ["lines", "warnings", "errors"])
    )

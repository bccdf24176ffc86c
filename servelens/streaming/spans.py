"""Server spans and their upstream calls, paired while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.operators.skew import exact_quantiles

CALL_MS = 600_000


def _timed(spans: DataFrame, lateness_ms: int, name: str) -> DataFrame:
    return spans.withColumn(name, F.timestamp_micros("start_us")).withWatermark(name, f"{lateness_ms} milliseconds")


def span_overheads(spans: DataFrame, lateness_ms: int = 0, call_ms: int = CALL_MS) -> DataFrame:
    """A row per server span of a span stream: its attributes, server_us, the time client_us of its
    upstream calls together, and overhead_us; the last two are null where no call came.

    Upstream calls begin within ``call_ms`` of their server span; both may come ``lateness_ms`` late. The
    join holds a span until no call of its can come any more, so a span without one comes out then.
    """
    server = _timed(spans.filter(F.col("kind") == "SERVER"), lateness_ms, "server_time").select(
        "server_time",
        "trace_id",
        "span_id",
        F.col("attrs")["model"].alias("model"),
        F.col("attrs")["user"].alias("user_name"),
        F.coalesce(F.col("attrs")["stream"] == "true", F.lit(False)).alias("stream"),
        (F.col("end_us") - F.col("start_us")).alias("server_us"),
    )
    client = _timed(spans.filter(F.col("kind") == "CLIENT"), lateness_ms, "client_time").select(
        "client_time",
        F.col("trace_id").alias("client_trace"),
        F.col("parent_span_id").alias("client_parent"),
        (F.col("end_us") - F.col("start_us")).alias("client_us"),
    )
    near = F.expr(
        "client_trace = trace_id and client_parent = span_id and client_time >= server_time "
        f"and client_time <= server_time + interval {call_ms} milliseconds"
    )
    keys = ["server_time", "trace_id", "span_id", "model", "user_name", "stream", "server_us"]
    return (
        server.join(client, near, "left_outer")
        .groupBy(*keys)
        .agg(F.sum("client_us").alias("client_us"))
        .withColumn(
            "overhead_us",
            F.when(F.col("client_us").isNotNull(), F.greatest(F.col("server_us") - F.col("client_us"), F.lit(0))),
        )
        .drop("server_time")
    )


def overhead_quantiles(overheads: DataFrame) -> DataFrame:
    """The percentiles of ``traces.proxy_overhead`` from the rows that a stream has written."""
    return exact_quantiles(
        overheads,
        ["model", "user_name", "stream"],
        "overhead_us",
        {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99},
        totals=("calls", "overhead_sum_us"),
    )

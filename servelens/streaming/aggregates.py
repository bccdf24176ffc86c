"""Windowed aggregates over event time. Late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.functions.requests import safe_key
from servelens.operators.fleet import LIFECYCLE
from servelens.operators.metrics import _bucket_columns, bucket_rows, succeeded
from servelens.operators.skew import order_key


def event_time(df: DataFrame, watermark: str | None = None, ts_ms: str = "ts_ms") -> DataFrame:
    """Add ``event_time``; streams also get a watermark on it.

    A zone-less timestamp cannot carry a watermark, so it is built from milliseconds.
    """
    timed = df.withColumn("event_time", F.timestamp_millis(ts_ms))
    return timed.withWatermark("event_time", watermark) if watermark else timed


def distinct_reports(usage: DataFrame, watermark: str, report_id: str = "report_id") -> DataFrame:
    """Usage with each report once, however often it was sent within the watermark of its first copy;
    the event time goes on to the windows that follow. A copy that comes later than that is dropped
    by the watermark if its own time is as old."""
    return event_time(usage, watermark).dropDuplicatesWithinWatermark([report_id])


def windowed_chargeback(
    usage: DataFrame, window: str = "1 hour", watermark: str | None = None
) -> DataFrame:
    """Tokens per event-time window, user and model; same plan for batch and stream. Rows that have an
    ``event_time`` keep it, and its watermark."""
    timed = usage if "event_time" in usage.columns else event_time(usage, watermark)
    positive = timed.filter(
        (F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0)
    )
    return (
        positive.groupBy(
            F.window("event_time", window).alias("w"),
            safe_key("user_name").alias("user_name"),
            safe_key("model").alias("model"),
        )
        .agg(
            F.sum(F.greatest("prompt_tokens", F.lit(0))).alias("tokens_in"),
            F.sum(F.greatest("completion_tokens", F.lit(0))).alias("tokens_out"),
        )
        .select(
            F.unix_millis("w.start").alias("window_start_ms"),
            "user_name",
            "model",
            "tokens_in",
            "tokens_out",
        )
    )


def open_rows(rows: DataFrame, closed: DataFrame, window_ms: int, ts_ms: str = "ts_ms") -> DataFrame:
    """The rows after the last window that a finished stream has written."""
    last = closed.agg(F.max("window_start_ms") + window_ms).scalar()
    return rows.filter(F.coalesce(F.col(ts_ms) >= last, F.lit(True)))


def running_totals(windowed: DataFrame) -> DataFrame:
    """Totals per (user, model) over the emitted windows."""
    return windowed.groupBy("user_name", "model").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )


def windowed_metrics(
    requests: DataFrame, window: str = "1 hour", watermark: str | None = None
) -> DataFrame:
    """Counters and cumulative latency buckets per event-time window and model."""
    return (
        event_time(requests, watermark)
        .groupBy(F.window("event_time", window).alias("w"), "model")
        .agg(
            F.count_if(succeeded()).alias("success"),
            F.count_if(~succeeded()).alias("errors"),
            *_bucket_columns("latency_us"),
            F.sum("latency_us").alias("sum_us"),
            F.count("latency_us").alias("count"),
        )
        .select(
            F.unix_millis("w.start").alias("window_start_ms"),
            "model", "success", "errors", "sum_us", "count", bucket_rows().alias("b"),
        )
        .select(
            "window_start_ms", "model", "success", "errors", "sum_us", "count",
            "b.le", "b.cum_count",
        )
    )


def running_roster(events: DataFrame) -> DataFrame:
    """Last lifecycle event per container, for complete or update mode; one row of state each.

    Filter the sink's result on ``event = 'registered'`` for the live roster.
    """
    return (
        events.filter(F.col("event").isin(*LIFECYCLE))
        .groupBy("container_id", "host")
        .agg(
            F.max_by("event", order_key("ts_ms", "event_id")).alias("event"),
            F.max("ts_ms").alias("since_ms"),
        )
    )

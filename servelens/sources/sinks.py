"""Writers: metric exposition text, service-log lines, instance lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.operators.metrics import PERCENTILES

# Metric names without their prefix and their types; the help texts are our own.
FAMILIES = {
    "target_containers": ("gauge", "Containers that are wanted"),
    "running_containers": ("gauge", "Containers that run"),
    "queue_depth_total": ("gauge", "Requests that wait, over all containers"),
    "container_load": (None, None),
    "container_startup_ms": ("gauge", "Milliseconds from start to registration"),
    "container_queue_depth": (None, None),
    "inference_latency_seconds": ("histogram", "Answer times in seconds"),
    "inference_latency_p50_ms": ("gauge", "Median answer time in milliseconds"),
    "inference_latency_p95_ms": ("gauge", "95th percentile of answer times in milliseconds"),
    "inference_latency_p99_ms": ("gauge", "99th percentile of answer times in milliseconds"),
    "inference_requests_total": ("counter", "Answered calls for each model and result"),
    "model_error_rate": ("gauge", "Share of calls that failed, for each model"),
    "tokens_in_total": ("counter", "Tokens of prompts"),
    "tokens_out_total": ("counter", "Tokens of answers"),
    "alerts_total": ("counter", "Alerts of all kinds"),
    "container_failures_total": ("counter", "Alerts of failed containers"),
    "scaling_events_total": ("counter", "Alerts of changes in scale"),
}


def metric(name: str | Column, value: Column, **labels: Column) -> Column:
    """struct(metric, labels, value) with the labels in the order given; null for a null value."""
    pairs = [
        F.concat(F.lit(f'{k}="'), escape_label(v), F.lit('"')) for k, v in labels.items()
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("")
    return F.when(
        value.isNotNull(),
        F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("metric"),
            text.alias("labels"),
            value.cast("string").alias("value"),
        ),
    )


def metric_rows(df: DataFrame, *metrics: Column) -> DataFrame:
    """Long-form rows (metric, labels, value) of the non-null metrics, in one pass over ``df``."""
    present = F.filter(F.array(*metrics), lambda m: m.isNotNull())
    return df.select(F.inline(present))


def escape_label(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def histogram_metrics(histogram: DataFrame) -> DataFrame:
    """Bucket, sum and count rows from the long histogram."""
    name = "inference_latency_seconds"
    model, last = F.col("model"), F.col("le") == "+Inf"
    return metric_rows(
        histogram,
        metric(f"{name}_bucket", F.col("cum_count"), model=model, le=F.col("le")),
        metric(f"{name}_sum", F.when(last, F.col("sum_us") / 1_000_000), model=model),
        metric(f"{name}_count", F.when(last, F.col("count")), model=model),
    )


def scorecard_metrics(card: DataFrame) -> DataFrame:
    """Percentile, request-count and error-rate rows from the scorecard."""
    model, total = F.col("model"), "inference_requests_total"
    success = F.greatest(F.lit(0), F.col("requests") - F.col("errors"))
    return metric_rows(
        card,
        *[
            metric(f"inference_latency_{p}_ms", F.col(f"{p}_us") / 1000, model=model)
            for p in PERCENTILES
        ],
        metric(total, success, model=model, status=F.lit("success")),
        metric(total, F.col("errors"), model=model, status=F.lit("error")),
        metric("model_error_rate", F.col("error_rate"), model=model),
    )


def token_metrics(chargeback: DataFrame) -> DataFrame:
    who = {"user": F.col("user_name"), "model": F.col("model")}
    spent = lambda c: F.when(F.col(c) > 0, F.col(c))
    return metric_rows(
        chargeback,
        metric("tokens_in_total", spent("tokens_in"), **who),
        metric("tokens_out_total", spent("tokens_out"), **who),
    )


def container_metrics(loads: DataFrame) -> DataFrame:
    """Load, depth and start-up time per container; ``loads`` is the latest reading of each, with
    ``startup_ms`` null where it is not known."""
    at = {"container_id": F.col("container_id"), "host": F.col("host")}
    return metric_rows(
        loads,
        metric("container_load", F.col("gpu_load"), **at),
        metric("container_startup_ms", F.col("startup_ms"), container_id=F.col("container_id")),
        metric("container_queue_depth", F.col("queue_depth"), **at),
    )


def gpu_metrics(gpus: DataFrame) -> DataFrame:
    """One row per GPU metric of (container_id, host, gpu, metrics map)."""
    rows = gpus.select("container_id", "host", "gpu", F.explode("metrics").alias("name", "text"))
    return metric_rows(
        rows,
        metric(
            F.concat(F.lit("gpu_"), F.col("name")), F.col("text"),
            container_id=F.col("container_id"), host=F.col("host"), gpu=F.col("gpu"),
        ),
    )


def fleet_metrics(fleet: DataFrame) -> DataFrame:
    """Fleet gauges of one row (target, running, queue_depth)."""
    return metric_rows(
        fleet,
        metric("target_containers", F.col("target")),
        metric("running_containers", F.col("running")),
        metric("queue_depth_total", F.col("queue_depth")),
    )


def alert_metrics(rollup: DataFrame) -> DataFrame:
    """Alert counters over all alerts, from the ``all`` row of the roll-up."""
    return metric_rows(
        rollup.filter(F.col("scope") == "all"),
        metric("alerts_total", F.col("alerts")),
        metric("container_failures_total", F.col("container_failures")),
        metric("scaling_events_total", F.col("scaling_events")),
    )


def to_exposition(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """Metric rows -> text lines with HELP and TYPE ahead of each family.

    Sorting by (family_ord, part, line) gives the exposition order. The rows are read twice, for
    samples and for families: stage them first, they are few.
    """
    base = F.regexp_replace(F.col("metric"), "^(inference_latency_seconds)_(bucket|sum|count)$", "$1")
    known = list(FAMILIES)
    position = F.array_position(F.array(*[F.lit(k) for k in known]), F.col("family"))
    named = metrics.withColumn("family", base).withColumn(
        "family_ord", F.when(position > 0, position.cast("int")).otherwise(len(known) + 1)
    )
    samples = named.select(
        "family_ord",
        F.lit(2).alias("part"),
        F.concat(F.lit(prefix), "metric", "labels", F.lit(" "), "value").alias("line"),
    )
    table = F.create_map(
        *[x for k, (t, h) in FAMILIES.items() if t for x in (F.lit(k), F.struct(F.lit(t), F.lit(h)))]
    )
    heads = named.select("family_ord", "family").distinct().withColumn("__m", table[F.col("family")])
    full = F.concat(F.lit(prefix), F.col("family"))
    header_rows = F.array(
        F.struct(F.lit(0).alias("part"),
                 F.concat(F.lit("# HELP "), full, F.lit(" "), F.col("__m.col2")).alias("line")),
        F.struct(F.lit(1).alias("part"),
                 F.concat(F.lit("# TYPE "), full, F.lit(" "), F.col("__m.col1")).alias("line")),
    )
    headers = (
        heads.filter(F.col("__m").isNotNull())
        .select("family_ord", F.explode(header_rows).alias("h"))
        .select("family_ord", "h.part", "h.line")
    )
    return headers.unionByName(samples)


def write_exposition(lines: DataFrame, path: str) -> None:
    """Text files whose concatenation in name order is the exposition, via a range sort."""
    lines.orderBy("family_ord", "part", "line").select("line").write.mode("overwrite").text(path)


def format_service_log(logs: DataFrame) -> DataFrame:
    """Log rows (ts, level, logger, thread, message, mdc, exception, stack) -> JSON ``value``.

    Core fields first, then the context keys in order, then exception and stack.
    """
    field = lambda k, v: F.concat(_json_text(k), F.lit(":"), _json_text(v))
    core = [field(F.lit(c), F.coalesce(F.col(c), F.lit("")))
            for c in ("ts", "level", "logger", "thread", "message")]
    context = F.transform(
        F.array_sort(F.map_entries("mdc")), lambda e: field(e["key"], F.coalesce(e["value"], F.lit("null")))
    )
    failure = F.when(
        F.col("exception").isNotNull(),
        F.array(
            field(F.lit("exception"), F.col("exception")),
            field(F.lit("stack"), F.coalesce("stack", F.lit(""))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(*core), F.coalesce(context, none), failure)
    others = [c for c in logs.columns
              if c not in ("ts", "level", "logger", "thread", "message", "mdc", "exception", "stack")]
    return logs.select(
        *others, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value")
    )


def _json_text(c: Column) -> Column:
    """A string as a quoted JSON string: quotes, backslashes and control characters escaped."""
    as_array = F.to_json(F.array(c))
    return F.substring(as_array, F.lit(2), F.length(as_array) - 2)


def write_service_log(logs: DataFrame, path: str) -> None:
    format_service_log(logs).select("value").write.mode("append").text(path)


def instance_list(roster: DataFrame, port: int = 8000) -> DataFrame:
    """``host:port`` per running instance."""
    return roster.select(F.concat_ws(":", "host", F.lit(port).cast("string")).alias("value"))


def write_instance_list(roster: DataFrame, path: str, port: int = 8000) -> None:
    instance_list(roster, port).write.mode("overwrite").text(path)

"""The composite plan: one outcome row per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.functions.requests import (
    classify_endpoint,
    resolve_client_ip,
    resolve_user,
    retry_after_sec,
)
from servelens.operators.access import evaluate_access
from servelens.operators.metrics import succeeded
from servelens.operators.quota import WINDOW_MS, match_quota_rule, rate_limit
from servelens.operators.routing import TICK_MS, route_least_loaded
from servelens.session import stage
from servelens.sources.telemetry import check_usage_reports, parse_requests


def identify(raw: DataFrame, principal: str = "service") -> DataFrame:
    """Raw requests -> endpoint, caller, address, model and body checks.

    Write the result out (``session.stage`` or a table of your own) before adjudicating: the
    bodies are then parsed once, and the passes after it read only narrow columns.
    """
    named = raw.withColumns(
        {
            "endpoint": classify_endpoint("path"),
            "user_name": resolve_user("headers", F.lit(principal)),
            "client_ip": resolve_client_ip("headers", "peer_ip"),
        }
    )
    # Reports are checked against a body that is null for other endpoints, so those skip the work.
    report = F.when(F.col("endpoint") == "usage", F.col("body"))
    usage = (
        check_usage_reports(named.withColumn("__report", report), body="__report")
        .drop("__report", "usage_error")
        .withColumnsRenamed(
            {
                "prompt_tokens": "usage_prompt_tokens",
                "completion_tokens": "usage_completion_tokens",
            }
        )
    )
    return parse_requests(usage).drop("headers", "body", "response_body", "peer_ip", "path")


def usage_records(identified: DataFrame) -> DataFrame:
    """Billable usage of :func:`identify`'s rows: (user_name, model, prompt_tokens,
    completion_tokens, ts_ms, source).

    A whole answer (2xx, no stream) is billed to the base model with what its body says; an
    accepted report to the model as it was sent, so that stream usage is counted, too.
    """
    answered = (
        (F.col("endpoint") == "inference")
        & F.col("request_error").isNull()
        & succeeded()
        & ~F.col("stream")
    )
    reported = (F.col("endpoint") == "usage") & (F.col("usage_status") == 200)

    def rows(condition, model, prefix, source):
        return identified.filter(condition).select(
            "user_name",
            F.col(model).alias("model"),
            F.coalesce(f"{prefix}prompt_tokens", F.lit(0)).alias("prompt_tokens"),
            F.coalesce(f"{prefix}completion_tokens", F.lit(0)).alias("completion_tokens"),
            "ts_ms",
            F.lit(source).alias("source"),
        )

    return rows(answered, "base_model", "", "response").unionByName(
        rows(reported, "usage_model", "usage_", "report")
    )


def adjudicate(
    identified: DataFrame,
    rules: DataFrame,
    grants: DataFrame | None,
    depth: DataFrame,
    roster: DataFrame,
    access_mode: str = "enforce",
    window_ms: int = WINDOW_MS,
    tick_ms: int = TICK_MS,
    version: str | None = None,
) -> DataFrame:
    """Why each request was refused, or where it went.

    Gates in order: endpoint, body, quota, access to the base, access to the adapter, backend,
    upstream. A request the policy refuses has already used quota. ``upstream_error`` (``timeout``
    or ``io``), if present, marks calls without an upstream status. With ``version``, requests and
    rules carry that column (see ``rules_asof``) and each version has its own buckets.
    """
    eligible = (F.col("endpoint") == "inference") & F.col("request_error").isNull()
    matched = match_quota_rule(identified, rules, version=version)
    # Calls stopped before the quota gate neither take nor need a place in a bucket.
    for column in ("bucket", "rpm"):
        matched = matched.withColumn(column, F.when(eligible, F.col(column)))
    # Ranking goes over its input several times: the match is done once, before it.
    matched = stage(matched, "matched")
    limited = rate_limit(matched, window_ms=window_ms).withColumnRenamed("allowed", "quota_ok")
    checked = evaluate_access(limited, grants, access_mode, calls=identified)
    return outcomes(route_least_loaded(checked, depth, roster, tick_ms, ticks=identified))


def outcomes(routed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The outcome of calls that know their verdicts: columns of :func:`identify`, quota_ok, reason,
    retry_after_ms, rule_desc, base_allowed, allowed and routed_container. Works on tables and streams;
    ``keep`` names further columns to hand on.
    """
    has_upstream_error = "upstream_error" in routed.columns
    upstream = F.col("upstream_error") if has_upstream_error else F.lit(None).cast("string")
    reason = (
        F.when(F.col("endpoint") == "not_found", "not_found")
        .when(F.col("endpoint") != "inference", F.col("endpoint"))
        .when(F.col("request_error").isNotNull(), F.col("request_error"))
        .when(~F.col("quota_ok"), F.col("reason"))
        .when(~F.col("base_allowed"), "permission_denied")
        .when(~F.col("allowed"), "adapter_denied")
        .when(F.col("routed_container").isNull(), "service_unavailable")
        .when(upstream == "timeout", "upstream_timeout")
        .when(upstream == "io", "upstream_error")
        .otherwise("forwarded")
    )
    code = (
        F.when(F.col("outcome") == "not_found", 404)
        .when(F.col("outcome") == "models", 200)
        .when(F.col("outcome") == "usage", F.col("usage_status"))
        .when(F.col("request_status").isNotNull(), F.col("request_status"))
        .when(~F.col("quota_ok"), 429)
        .when(F.col("outcome").isin("permission_denied", "adapter_denied"), 403)
        .when(F.col("outcome") == "service_unavailable", 503)
        .when(F.col("outcome") == "upstream_timeout", 504)
        .when(F.col("outcome") == "upstream_error", 502)
        .otherwise(F.col("status"))
    )
    sent = F.col("outcome").isin("forwarded", "upstream_timeout", "upstream_error")
    # Tokens count for answers that came whole: a stream reports its own, a failed call has none.
    billed = sent & succeeded(code) & ~F.col("stream")
    throttled = F.col("outcome").isin("quota_zero", "rate_limited", "late")
    return routed.withColumn("outcome", reason).select(
        *keep,
        "request_id",
        "ts_ms",
        "user_name",
        "client_ip",
        F.col("base_model").alias("model"),
        "lora",
        "outcome",
        code.cast("int").alias("code"),
        F.when(throttled, F.col("rule_desc")).alias("rule_desc"),
        F.when(throttled, retry_after_sec("retry_after_ms")).alias("retry_after_sec"),
        F.when(sent, F.col("routed_container")).alias("container_id"),
        sent.alias("forwarded"),
        (sent & succeeded(code)).alias("ok"),
        F.when(sent, F.col("latency_us")).alias("latency_us"),
        F.when(billed, F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(billed, F.col("completion_tokens")).alias("completion_tokens"),
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("model", "outcome").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("ok").alias("succeeded"),
        F.sum("latency_us").alias("latency_us"),
        F.sum("prompt_tokens").alias("tokens_in"),
        F.sum("completion_tokens").alias("tokens_out"),
    )

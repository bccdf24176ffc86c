"""The composite plan as one stream: raw calls in, outcome windows out.

Three stateful operators follow each other, all in append mode under one watermark: policies are
resolved once per call, calls take their places in rate-limit buckets, and outcomes are counted per
window. The event time travels with each call, so a window closes only when all calls in it have
been through the limiter. The policies, depth readings and roster are tables, read anew by every
trigger.
"""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from servelens.operators.access import EVERYONE, keyed_grants
from servelens.operators.quota import RULE_FIELDS, WINDOW_MS, decide, with_bucket
from servelens.operators.routing import TICK_MS, tick_of, tick_routes
from servelens.plans.adjudication import identify, outcomes
from servelens.session import stage
from servelens.streaming.aggregates import event_time
from servelens.streaming.keyed import place_requests

#: Columns of identified calls that outcomes need, besides their id and time.
CARRIED = (
    "user_name", "client_ip", "endpoint", "request_error", "request_status", "usage_status",
    "base_model", "lora", "stream", "status", "latency_us", "prompt_tokens", "completion_tokens",
)


def _key(kind: str, *parts: Column) -> Column:
    names = ("kind", "a", "b", "c")
    values = [F.lit(kind), *parts, *[F.lit("")] * (3 - len(parts))]
    return F.struct(*[v.alias(n) for n, v in zip(names, values)])


def policy_table(rules: DataFrame, grants: DataFrame, access: str = "infer") -> DataFrame:
    """(key, rule, like): quota rules by their fixed parts, grants by principal and literal prefix, and
    one row that every call meets. Rules are those of ``load_quota_rules``."""
    fixed = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("*"))
    model = F.when(F.col("rule_model") == "*", "*").otherwise(fixed("rule_model"))
    best = (
        rules.groupBy(_key("rule", fixed("rule_user"), fixed("rule_group"), model).alias("key"))
        .agg(F.min(F.struct("rule_ord", *RULE_FIELDS)).alias("rule"))
        .withColumn("like", F.lit(None).cast("string"))
    )
    no_rule = F.lit(None).cast(best.schema["rule"].dataType).alias("rule")
    patterns = keyed_grants(grants).filter(F.col("access") == access).select(
        _key("grant", F.col("__p"), F.col("__prefix")).alias("key"), no_rule, F.col("__like").alias("like")
    )
    call = rules.sparkSession.range(1).select(
        _key("call").alias("key"), no_rule, F.lit(None).cast("string").alias("like")
    )
    return best.unionByName(patterns).unionByName(call)


def _shapes(policies: DataFrame) -> tuple[list[str], dict[str, list[int]]]:
    """Which kinds of keys the policies have: of rules the first characters of their parts (eight at
    most), of grants the lengths of their prefixes by the first character of the principal."""
    first = lambda part: F.substring(part, 1, 1)
    rule = F.col("key.kind") == "rule"
    found = (
        policies.where("key.kind in ('rule', 'grant')")
        .select(
            F.when(rule, F.concat(*[first(f"key.{p}") for p in "abc"])).alias("rule"),
            F.when(~rule, first("key.a")).alias("principal"),
            F.when(~rule, F.length("key.b")).alias("length"),
        )
        .distinct()
        .collect()
    )
    lengths = {p: sorted(r.length for r in found if r.principal == p and r.length is not None) for p in "u*g"}
    return sorted(r.rule for r in found if r.rule is not None), lengths


def _asks(rules: list[str], lengths: dict[str, list[int]]) -> Column:
    """The keys under which a call may find rules and grants, of the kinds that there are; null where
    its name is shorter than a prefix."""
    equal = lambda c: F.concat(F.lit("="), c)
    groups = F.coalesce(F.col("groups"), F.array().cast("array<string>"))
    # The prefixes of the adapter's name hold those of its base.
    named = F.lower(F.concat_ws("#", "base_model", "lora"))

    def ruled(shape: str, group: Column) -> Column:
        user, _, model = (part == "=" for part in shape)
        return _key(
            "rule", equal(F.col("user_name")) if user else F.lit("*"), group,
            equal(F.col("base_model")) if model else F.lit("*"),
        )

    def granted(kind: str, principal: Column) -> list[Column]:
        cut = lambda n: _key("grant", principal, F.substring(named, 1, n))
        return [F.when(F.length(named) >= n, cut(n)) for n in lengths[kind]]

    own = [_key("call"), *[ruled(s, F.lit("*")) for s in rules if s[1] == "*"]]
    own += granted("u", F.concat(F.lit("u:"), F.col("user_name"))) + granted("*", F.lit(EVERYONE))
    shared = [s for s in rules if s[1] == "="]
    if not shared and not lengths["g"]:
        return F.array(*own)
    of_group = lambda g: F.array(
        *[ruled(s, equal(g)) for s in shared], *granted("g", F.concat(F.lit("g:"), g))
    )
    return F.concat(F.array(*own), F.flatten(F.transform(groups, of_group)))


def resolve_policies(identified: DataFrame, policies: DataFrame) -> DataFrame:
    """Calls with the columns of their quota rule, ``bucket``, ``base_allowed`` and ``allowed``.

    ``identified`` has a watermark on ``event_time``; calls come out once it has passed them. A
    request id names one call: a call that is sent twice counts once. A call's keys, of the kinds that
    the policies have when the stream starts, meet the policies in an equi-join and are brought
    together again before the shuffle.
    """
    eligible = (F.col("endpoint") == "inference") & F.col("request_error").isNull()
    keys = F.when(eligible, _asks(*_shapes(policies))).otherwise(F.array(_key("call")))
    kept = F.struct("ts_ms", *CARRIED)
    asked = identified.select("event_time", "request_id", kept.alias("call"), F.explode(keys).alias("key"))
    base = F.lower("call.base_model")
    full = F.lower(F.concat_ws("#", "call.base_model", "call.lora"))
    # Every call meets the row of its own kind; only there it is carried into the sort by calls.
    met = asked.join(policies, "key").select(
        "event_time",
        "request_id",
        F.when(F.col("key.kind") == "call", F.col("call")).alias("call"),
        "rule",
        F.coalesce(F.like(base, F.col("like")), F.lit(False)).alias("base_allowed"),
        F.coalesce(F.like(full, F.col("like")), F.lit(False)).alias("full_allowed"),
    )
    found = met.groupBy("event_time", "request_id").agg(
        F.first("call", ignorenulls=True).alias("call"),
        F.min("rule").alias("rule"),
        F.max("base_allowed").alias("base_allowed"),
        F.max("full_allowed").alias("full_allowed"),
    )
    resolved = found.select(
        "event_time",
        "request_id",
        "call.*",
        *[F.col(f"rule.{f}").alias(f) for f in RULE_FIELDS],
        "base_allowed",
        (F.col("base_allowed") & (F.col("call.lora").isNull() | F.col("full_allowed"))).alias("allowed"),
    )
    return with_bucket(resolved)


def routes_over(depth: DataFrame, roster: DataFrame, tick_ms: int = TICK_MS) -> tuple[DataFrame, int, int]:
    """Routes for every tick from before the first depth reading to after the last one, and these two
    ticks: what holds before and after them holds there. Its size follows the time, not the calls."""
    tick = tick_of("ts_ms", tick_ms)
    low, high = depth.agg(F.min(tick), F.max(tick)).first()
    low, high = (0, 0) if low is None else (low - 1, high + 1)
    ticks = depth.sparkSession.range(low, high + 1).select(F.col("id").alias("tick"))
    return stage(tick_routes(depth, roster, ticks, tick_ms), "routes"), low, high


#: What travels with a call through its bucket.
PAYLOAD = (*CARRIED, *[f for f in RULE_FIELDS if f != "rpm"], "base_allowed", "allowed")


def _short() -> Column:
    """The payload under names of one letter: the names were most of what a bucket's task handled."""
    return F.struct(*[F.col(name).alias(letter) for name, letter in zip(PAYLOAD, ascii_letters)])


def _unpack(placed: DataFrame, kept: DataType) -> DataFrame:
    """``placed(payload)`` with the columns of the payload."""
    names = [F.col(f"kept.{letter}").alias(name) for name, letter in zip(PAYLOAD, ascii_letters)]
    return placed.withColumn("kept", F.from_json("payload", kept)).select("*", *names)


def stream_adjudication(
    raw: DataFrame,
    rules: DataFrame,
    grants: DataFrame,
    depth: DataFrame,
    roster: DataFrame,
    lateness_ms: int = 0,
    window_ms: int = WINDOW_MS,
    tick_ms: int = TICK_MS,
) -> DataFrame:
    """Outcome of every call of a stream of raw requests, with ``event_time`` under a watermark.

    The columns are those of ``adjudicate``. Calls may come ``lateness_ms`` after newer ones; later
    ones are dropped by the watermark.
    """
    policies = stage(policy_table(rules, grants), "policies")
    routes, low, high = routes_over(depth, roster, tick_ms)
    calls = resolve_policies(event_time(identify(raw), f"{lateness_ms} milliseconds"), policies)
    placed = place_requests(
        calls.withColumn("payload", F.to_json(_short())), window_ms, payload="payload", watermark=False
    )
    # A bucket's calls come out of one task; what follows is shared out again.
    unpacked = _unpack(placed.repartition("request_id"), calls.select(_short().alias("kept")).schema["kept"].dataType)
    judged = decide(unpacked.withColumnRenamed("allowed", "may"), window_ms).withColumnsRenamed(
        {"allowed": "quota_ok", "may": "allowed"}
    )
    tick = F.greatest(F.lit(low), F.least(F.lit(high), tick_of("ts_ms", tick_ms)))
    return outcomes(judged.withColumn("tick", tick).join(routes, "tick", "left"), keep=["event_time"])


def outcome_windows(calls: DataFrame, window: str = "1 hour") -> DataFrame:
    """Outcome counts per window, model and outcome, for append mode."""
    return (
        calls.groupBy(F.window("event_time", window).alias("w"), "model", "outcome")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if("ok").alias("succeeded"),
            F.sum("latency_us").alias("latency_us"),
            F.sum("prompt_tokens").alias("tokens_in"),
            F.sum("completion_tokens").alias("tokens_out"),
        )
        .select(F.unix_millis("w.start").alias("window_start_ms"), "*")
        .drop("w")
    )


def outcome_totals(windows: DataFrame) -> DataFrame:
    """Counts per model and outcome over the windows that a stream has written."""
    sums = ("requests", "succeeded", "latency_us", "tokens_in", "tokens_out")
    return windows.groupBy("model", "outcome").agg(*[F.sum(c).alias(c) for c in sums])

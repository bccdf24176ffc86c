"""The keys that a streamed call asks by: few, and all that count."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelens.operators.access import evaluate_access
from servelens.sources import policies
from servelens.streaming import adjudication as one_stream

CALL = (
    "request_id long, ts_ms long, user_name string, groups array<string>, base_model string, lora string, endpoint string, "
    "request_error string, client_ip string, request_status int, usage_status int, stream boolean, status int, latency_us long, "
    "prompt_tokens long, completion_tokens long"
)
GRANTS = "principal_type string, principal string, access string, resource_glob string"
RULES = '{"rules":[{"requestsPerMinute":9},{"user":"u1","requestsPerMinute":2},{"group":"g1","model":"big","requestsPerMinute":3}]}'


def tables(spark):
    names = ["big", "Bigger" + "x" * 200, "b", "other", "éü", ""]
    people = [("u1", ["g1"]), ("u2", ["g1", "g2"]), ("u3", None), (None, []), ("u1", [None, "g2"]), ("*", ["*"])]
    both = [(u, g, m, lora) for u, g in people for m in names for lora in (None, "lora-0")]
    calls = [(i, 1_000 + i, u, g, m, lora, "inference", None, *[None] * 8) for i, (u, g, m, lora) in enumerate(both)]
    grants = [
        ("group", "g1", "infer", "big"), ("group", "g2", "infer", "BIG*"), ("user", "u3", "infer", "?*"), ("user", "*", "infer", "o*#lora-?"),
        ("user", "*", "list", "*"), ("user", "u2", "infer", "éü*"), ("group", "g1", "infer", "z" * 300 + "*"),
    ]
    rules = policies.load_quota_rules(spark.createDataFrame([(RULES,)], "doc string"))
    return spark.createDataFrame(calls, CALL), rules, spark.createDataFrame(grants, GRANTS)


def test_a_call_asks_by_the_kinds_of_keys_there_are(spark):
    """Not by every prefix of a long name: three kinds of rules and six of grants are looked for."""
    calls, rules, grants = tables(spark)
    table = one_stream.policy_table(rules, grants)
    asked = []
    explode = F.explode

    def seen(keys):
        asked.append(keys)
        return explode(keys)

    one_stream.F.explode = seen
    try:
        one_stream.resolve_policies(calls.withColumn("event_time", F.timestamp_millis("ts_ms")), table)
    finally:
        one_stream.F.explode = explode
    most = calls.select(F.max(F.size(asked[0]))).first()[0]
    assert most <= 20


def test_verdicts_equal_the_batch_operator(spark):
    calls, rules, grants = tables(spark)
    timed = calls.withColumn("event_time", F.timestamp_millis("ts_ms"))
    found = one_stream.resolve_policies(timed, one_stream.policy_table(rules, grants))
    columns = ["request_id", "base_allowed", "allowed"]
    want = evaluate_access(calls, grants, "enforce", calls=calls).select(columns).collect()
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want))
    assert len({(r.base_allowed, r.allowed) for r in want}) == 3


def test_no_policies_at_all(spark):
    calls, rules, grants = tables(spark)
    table = one_stream.policy_table(rules.limit(0), grants.limit(0))
    found = one_stream.resolve_policies(calls.withColumn("event_time", F.timestamp_millis("ts_ms")), table)
    assert found.count() == calls.count()
    assert found.where("allowed or rpm is not null").isEmpty()

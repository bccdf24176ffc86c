"""What travels with a call through its bucket's one task, and where it is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelens.plans import views
from servelens.streaming import adjudication as one_stream

CALL = (
    "request_id long, ts_ms long, user_name string, client_ip string, endpoint string, request_error string, request_status int, "
    "usage_status int, base_model string, lora string, stream boolean, status int, latency_us long, prompt_tokens long, "
    "completion_tokens long, rule_user string, rule_group string, rule_model string, rule_desc string, bucket string, "
    "base_allowed boolean, allowed boolean"
)


def test_payload_is_short_and_whole(spark):
    full = (1, 5, "user-12345", "203.0.113.7", "inference", None, 200, 200, "model-1", "lora-0", False, 200, 123456, 12, 345,
            "user-12345", "team-1", "*", "d", "b", True, False)
    odd = (2, 5, "", 'a "b" \\ é\n🙂', None, "", None, None, None, "", None, None, -1, None, 0, None, "", None, None, None, None, True)
    calls = spark.createDataFrame([full, odd], CALL)
    short = one_stream._short()
    placed = calls.select("request_id", F.to_json(short).alias("payload"))
    out = one_stream._unpack(placed, calls.select(short.alias("kept")).schema["kept"].dataType)
    assert out.select(F.max(F.length("payload"))).first()[0] <= 230
    names = list(one_stream.PAYLOAD)
    assert sorted(map(str, out.select(names).collect())) == sorted(map(str, calls.select(names).collect()))


def test_calls_are_shared_out_behind_their_bucket(spark, sf_dir):
    """A stream's plan reads payloads on the far side of a shuffle by call, not in the bucket's task."""
    events = views.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    raw = views.raw_requests_from(views.requests_from(stream))
    from servelens.sources import policies

    out = one_stream.stream_adjudication(
        raw, policies.load_quota_rules(views.rules_docs(spark)), views.grants(spark), views.depth(spark, sf_dir), views.roster(spark, sf_dir)
    )
    lines = out._jdf.queryExecution().analyzed().toString().splitlines()
    at = {k: next(i for i, x in enumerate(lines) if k in x) for k in ("from_json", "RepartitionByExpression [request_id", "TransformWithState")}
    assert at["from_json"] < at["RepartitionByExpression [request_id"] < at["TransformWithState"]

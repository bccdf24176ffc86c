from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from servelens.operators import access, quota
from servelens.plans import adjudication
from servelens.sources import policies

REQUEST = "request_id long, ts_ms long, user_name string, groups array<string>, base_model string"


def rules_of(spark, rules):
    return policies.load_quota_rules(spark.createDataFrame([(json.dumps({"rules": rules}),)], "doc string"))


def decisions(spark, rules, calls, window_ms=60_000):
    rows = [(i, ts, user, groups, model) for i, (ts, user, groups, model) in enumerate(calls)]
    out = quota.quota_decisions(spark.createDataFrame(rows, REQUEST), rules_of(spark, rules), window_ms)
    return out.orderBy("request_id").collect()


def test_user_limit(spark):
    out = decisions(
        spark, [{"user": "alice", "model": "m", "requestsPerMinute": 3}],
        [(t, "alice", [], "m") for t in range(4)] + [(9, "bob", [], "m")],
    )
    assert [r["allowed"] for r in out] == [True, True, True, False, True]
    assert 0 < out[3]["retry_after_ms"] <= 60_000 and out[3]["reason"] == "rate_limited"
    assert out[3]["rule_desc"] == "rule[user=alice,group=null,model=m,rpm=3]"


def test_zero_quota(spark):
    out = decisions(spark, [{"user": "banned", "model": "*", "requestsPerMinute": 0}], [(0, "banned", [], "m")])
    assert (out[0]["allowed"], out[0]["reason"], out[0]["retry_after_ms"]) == (False, "quota_zero", 60_000)


def test_most_specific_rule_wins(spark):
    rules = [
        {"model": "*", "requestsPerMinute": 1},
        {"group": "team-a", "model": "*", "requestsPerMinute": 2},
        {"user": "alice", "model": "m", "requestsPerMinute": 5},
    ]
    out = decisions(spark, rules, [(t, "alice", ["team-a"], "m") for t in range(6)])
    assert [r["allowed"] for r in out] == [True] * 5 + [False]


def test_group_and_wildcard_buckets_are_shared(spark):
    calls = [(0, "alice", ["g"], "m1"), (1, "bob", ["g"], "m2"), (2, "carol", ["g"], "m3")]
    out = decisions(spark, [{"group": "g", "requestsPerMinute": 2}], calls)
    assert [r["allowed"] for r in out] == [True, True, False]
    calls = [(0, "alice", [], m) for m in ("m1", "m2", "m3")]
    out = decisions(spark, [{"user": "alice", "model": "*", "requestsPerMinute": 2}], calls)
    assert [r["allowed"] for r in out] == [True, True, False]


def test_global_limit_over_many_callers(spark):
    calls = [(5, f"u{i}", [], f"m{i % 3}") for i in range(20)]
    out = decisions(spark, [{"model": "*", "requestsPerMinute": 5}], calls)
    assert sum(r["allowed"] for r in out) == 5


def replay(calls, rules, window_ms):
    """One call at a time, as a bucket counter would."""
    ordered = sorted(
        enumerate(rules),
        key=lambda e: (-(4 * bool(e[1].get("user")) + 2 * bool(e[1].get("group")) + (e[1].get("model", "*") != "*")), e[0]),
    )
    buckets, out = {}, []
    for ts, user, groups, model in calls:
        rule = next(
            (r for _, r in ordered
             if r.get("user") in (None, user) and (r.get("group") is None or r["group"] in groups)
             and r.get("model", "*") in ("*", model)),
            None,
        )
        if rule is None:
            out.append((True, 0))
            continue
        if rule["requestsPerMinute"] == 0:
            out.append((False, 60_000))
            continue
        who = f"u:{rule['user']}" if rule.get("user") else f"g:{rule['group']}" if rule.get("group") else "*"
        b = buckets.setdefault((who, rule.get("model", "*")), [ts, rule["requestsPerMinute"], rule["requestsPerMinute"]])
        if ts - b[0] >= window_ms:
            b[0] += (ts - b[0]) // window_ms * window_ms
            b[1] = b[2]
        if b[1] > 0:
            b[1] -= 1
            out.append((True, 0))
        else:
            out.append((False, max(1, b[0] + window_ms - ts)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rate_limit_against_replay(spark, seed):
    rng = random.Random(seed)
    pool = [
        {"user": "u1", "model": "m1", "requestsPerMinute": 2}, {"user": "u1", "requestsPerMinute": 3},
        {"user": "u1", "group": "g1", "requestsPerMinute": 7}, {"group": "g1", "requestsPerMinute": 4},
        {"group": "g2", "model": "m2", "requestsPerMinute": 0}, {"model": "m0", "requestsPerMinute": 6},
        {"requestsPerMinute": 5},
    ]
    rules = rng.sample(pool, rng.randrange(2, len(pool) + 1))
    ts, calls = 1_000_000, []
    for _ in range(600):
        ts += rng.choice([0, 1, 50, 400, 900])
        calls.append((ts, f"u{rng.randrange(3)}", [f"g{rng.randrange(3)}"], f"m{rng.randrange(3)}"))
    out = decisions(spark, rules, calls, window_ms=5_000)
    assert [(r["allowed"], r["retry_after_ms"]) for r in out] == replay(calls, rules, 5_000)


def test_first_rule_wins_over_many(spark):
    rng = random.Random(1)
    rules = [
        {
            **({"user": f"u{rng.randrange(6)}"} if rng.random() < 0.5 else {}),
            **({"group": f"g{rng.randrange(4)}"} if rng.random() < 0.5 else {}),
            "model": rng.choice(["*", "m0", "m1"]),
            "requestsPerMinute": rng.randrange(5),
        }
        for _ in range(12)
    ]
    rows = [
        (i, i, rng.choice(["u0", "u1", "u2", "u9", None]), rng.choice([[], ["g0"], ["g1", "g3"], None]), rng.choice(["m0", "m2", None]))
        for i in range(400)
    ]
    requests = spark.createDataFrame(rows, REQUEST)
    ordered = rules_of(spark, rules).orderBy("rule_ord", "rule_user", "rule_group", "rule_model", "rpm").collect()
    for got in quota.match_quota_rule(requests, rules_of(spark, rules)).collect():
        first = next(
            (
                r
                for r in ordered
                if r["rule_user"] in (None, got["user_name"])
                and (r["rule_group"] is None or r["rule_group"] in (got["groups"] or []))
                and r["rule_model"] in ("*", got["base_model"])
            ),
            None,
        )
        fields = ("rule_user", "rule_group", "rule_model", "rpm")
        assert [got[f] for f in fields] == [first and first[f] for f in fields]


def test_versions_asof(spark):
    docs = spark.createDataFrame(
        [(1, 1000, '{"rules":[]}'), (2, 5000, "{oops"), (3, 9000, ""), (4, 200_000_000, "{}")],
        "version int, valid_from_ms long, doc string",
    )
    assert policies.valid_versions(docs).count() == 2
    valid = policies.valid_versions(docs, fallback='{"rules":[]}')
    rows = [(i, t, "u", [], "m") for i, t in enumerate([0, 999, 1000, 6000, 9000, 100_000_000, 200_000_000, 300_000_000])]
    requests = spark.createDataFrame(rows, REQUEST)
    expected = [None, None, 1, 1, 3, 3, 4, 4]
    found = quota.rules_asof(requests, valid).orderBy("request_id")
    assert [r["version"] for r in found.collect()] == expected


def test_new_version_resets_buckets(spark):
    docs = spark.createDataFrame(
        [(1, 0, '{"rules":[{"user":"alice","requestsPerMinute":1}]}'),
         (2, 100, '{"rules":[{"user":"alice","requestsPerMinute":1}]}')],
        "version int, valid_from_ms long, doc string",
    )
    requests = spark.createDataFrame([(i, t, "alice", [], "m") for i, t in enumerate([-5, 10, 20, 110, 120])], REQUEST)
    out = quota.quota_decisions(
        quota.rules_asof(requests, docs), policies.load_quota_rules(docs), version="version"
    ).orderBy("request_id")
    assert [r["allowed"] for r in out.collect()] == [True, True, False, True, False]


def test_carried_buckets_continue(spark):
    rules = rules_of(spark, [{"requestsPerMinute": 3}])
    calls = [(i, t, "u", [], "m") for i, t in enumerate([0, 10, 20, 30, 70_000, 80_000, 90_000, 100_000])]
    whole = quota.quota_decisions(spark.createDataFrame(calls, REQUEST), rules).orderBy("request_id")
    carried, got = None, []
    for part in (calls[:2], calls[2:5], calls[5:]):
        matched = quota.match_quota_rule(spark.createDataFrame(part, REQUEST), rules)
        placed = quota.rank_requests(matched, carried=carried)
        got += [r["allowed"] for r in quota.decide(placed).orderBy("request_id").collect()]
        state = quota.carry_buckets(placed, carried)
        carried = spark.createDataFrame(state.collect(), state.schema)
    assert got == [r["allowed"] for r in whole.collect()]


GRANT = "principal_type string, principal string, access string, resource_glob string"


def access_requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, user_name string, groups array<string>, base_model string, lora string")


def test_access_modes(spark):
    df = access_requests(spark, [(1, "u", [], "m", None)])
    grants = spark.createDataFrame([], GRANT)
    verdict = lambda mode, g=grants: access.evaluate_access(df, g, mode).first()["allowed"]
    assert [verdict(m) for m in ("off", "degraded_strict", "degraded_lenient", "enforce")] == [True, False, True, False]
    assert access.evaluate_access(df, None).first()["allowed"] is True
    with pytest.raises(ValueError):
        verdict("nonsense")


def test_many_grants_and_members(spark):
    """One group of many grants and many members: no row per member and pattern."""
    grants = spark.createDataFrame(
        [("group", "g", "infer", f"m{i}-*") for i in range(400)] + [("user", "*", "infer", "*-open")], GRANT
    )
    rows = [(i, f"u{i}", ["g"] if i % 2 else [], f"m{i % 500}-x" if i % 3 else "any-open", None) for i in range(600)]
    out = access.evaluate_access(access_requests(spark, rows), grants).collect()
    for r in out:
        i = r["request_id"]
        assert r["allowed"] == (i % 3 == 0 or (i % 2 == 1 and i % 500 < 400))


def test_adapter_needs_base_and_own_grant(spark):
    grants = spark.createDataFrame(
        [("user", "alice", "infer", "LLaMA-3*b"), ("group", "g", "infer", "llama-3-70b#*"), ("user", "*", "infer", "open?"),
         ("user", "a_ice", "infer", "x%")],
        GRANT,
    )
    rows = [
        (1, "alice", [], "llama-3-70b", None), (2, "alice", [], "llama-3-70b", "support"),
        (3, "alice", ["g"], "llama-3-70b", "support"), (4, "bob", ["g"], "llama-3-70b", "support"),
        (5, "bob", None, "open1", None), (6, "bob", [], "open12", None), (7, "a_ice", [], "xyz", None),
        (8, None, [], "open1", None), (9, "alice", [], None, None),
    ]
    expected = [(True, True), (True, False), (True, True), (False, False), (True, True), (False, False),
                (False, False), (True, True), (False, False)]
    out = access.evaluate_access(access_requests(spark, rows), grants).orderBy("request_id").collect()
    assert [(r["base_allowed"], r["allowed"]) for r in out] == expected


def test_catalog(spark):
    users = spark.createDataFrame([("u", ["g"]), ("v", [])], "user_name string, groups array<string>")
    grants = spark.createDataFrame(
        [("group", "g", "list", "m*"), ("user", "v", "list", "m1"), ("user", "v", "list", "m2#a"), ("user", "*", "metadata", "m2")],
        GRANT,
    )
    catalog = spark.createDataFrame([("m1",), ("m2",)], "model string")
    adapters = spark.createDataFrame([("m1", "a"), ("m2", "a")], "base string, adapter string")
    loaded = spark.createDataFrame([("m1",), ("m2",)], "name string")
    out = {tuple(r) for r in access.visible_catalog(users, catalog, adapters, loaded, grants).collect()}
    assert out == {
        ("u", "model", "m1", None), ("u", "model", "m2", None), ("v", "model", "m1", None),
        ("u", "adapter", "m1", "a"), ("u", "adapter", "m2", "a"),
        ("u", "loaded", "m2", None), ("v", "loaded", "m2", None),
    }


def test_outcomes_in_gate_order(spark):
    body = '{"model":"%s"}'
    calls = [
        ("POST", "/v1/chat/completions", body % "m", 200, None),
        ("POST", "/v1/chat/completions", body % "m#x", 200, None),
        ("GET", "/v1/chat/completions", body % "m", 200, None),
        ("POST", "/v1/chat/completions", "[1]", 200, None),
        ("POST", "/v1/chat/completions", '{"model":3}', 200, None),
        ("POST", "/v1/chat/completions", body % "secret", 200, None),
        ("POST", "/v1/chat/completions", body % "m", None, "timeout"),
        ("POST", "/v1/chat/completions", body % "m", None, "io"),
        ("POST", "/v1/chat/completions", body % "m", 200, None),
        ("GET", "/v1/models", "", 200, None),
        ("POST", "/nope", "", 200, None),
        ("POST", "/v1/usage", '{"model":"m","prompt_tokens":1}', 200, None),
        ("POST", "/v1/usage", '{"model":"m","prompt_tokens":-1}', 200, None),
    ]
    rows = [
        (i, i, m, p, {"X-Forwarded-User": "u"}, "1.1.1.1", b, None, ["g"], s, 5, e)
        for i, (m, p, b, s, e) in enumerate(calls)
    ]
    raw = spark.createDataFrame(
        rows,
        "request_id long, ts_ms long, method string, path string, headers map<string,string>, peer_ip string,"
        " body string, response_body string, groups array<string>, status int, latency_us long, upstream_error string",
    )
    rules = rules_of(spark, [{"requestsPerMinute": 5}])
    grants = spark.createDataFrame([("group", "g", "infer", "m")], GRANT)
    roster = spark.createDataFrame([("c", "h", 0)], "container_id string, host string, ord int")
    depth = spark.createDataFrame([], "container_id string, ts_ms long, event_id long, depth int")
    identified = adjudication.identify(raw)
    out = adjudication.adjudicate(identified, rules, grants, depth, roster).orderBy("request_id").collect()
    assert [(r["outcome"], r["code"]) for r in out] == [
        ("forwarded", 200), ("adapter_denied", 403), ("method_not_allowed", 405), ("invalid_json", 400),
        ("missing_model", 400), ("permission_denied", 403), ("upstream_timeout", 504), ("upstream_error", 502),
        ("rate_limited", 429), ("models", 200), ("not_found", 404), ("usage", 200), ("usage", 400),
    ]
    assert out[8]["retry_after_sec"] == 60
    assert [r["forwarded"] for r in out].count(True) == 3
    empty = adjudication.adjudicate(identified, rules, grants, depth, roster.limit(0)).orderBy("request_id").first()
    assert (empty["outcome"], empty["code"]) == ("service_unavailable", 503)


def test_request_bodies(spark):
    from servelens.sources import telemetry

    bodies = ['{"model":"m","stream":true}', '{"model":"m","stream":"true"}', '{"model":""}', "null", '"x"', "", None]
    df = spark.createDataFrame([(i, "post", b) for i, b in enumerate(bodies)], "i int, method string, body string")
    out = telemetry.check_requests(df).orderBy("i").collect()
    assert [(r["request_error"], r["stream"]) for r in out] == [
        (None, True), (None, False), ("missing_model", False), ("invalid_json", False), ("invalid_json", False),
        ("invalid_json", False), ("invalid_json", False),
    ]
    reports = ['{"model":"m","prompt_tokens":100,"completion_tokens":250}', '{"prompt_tokens":1}',
               '{"model":"m","prompt_tokens":-5}', '{"model":"m"}', '{"model":7,"prompt_tokens":"12"}', '{"model":{}}',
               '{"model":"m","pad":"' + "x" * 17_000 + '"}']
    df = spark.createDataFrame([(i, "POST", b) for i, b in enumerate(reports)], "i int, method string, body string")
    out = telemetry.check_usage_reports(df).orderBy("i").collect()
    assert [(r["usage_status"], r["usage_error"], r["prompt_tokens"], r["completion_tokens"]) for r in out] == [
        (200, None, 100, 250), (400, "missing_model", None, None), (400, "invalid_tokens", None, None), (200, None, 0, 0),
        (200, None, 12, 0), (400, "missing_model", None, None), (400, "invalid_json", None, None),
    ]
    usage = telemetry.read_response_usage(
        spark.createDataFrame([('{"usage":{"prompt_tokens":42,"completion_tokens":17}}',), ('{"usage":3}',), ("x",)], "response_body string")
    )
    assert [(r["prompt_tokens"], r["completion_tokens"]) for r in usage.collect()] == [(42, 17), (None, None), (None, None)]
    assert usage.filter(F.col("prompt_tokens").isNull()).count() == 2

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from servelens.operators import deployments, fleet, metrics, routing, scoring, skew, tokens, traces
from servelens.sources import policies, telemetry


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [
        (
            rng.choice(["hot", "hot", "hot", "a", "b", None]),
            rng.randrange(0, 40_000),
            i * 2**50 if i % 2 else -i,
            rng.randrange(0, 90_000),
        )
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, "k string, ts_ms long, request_id long, v long").cache()


def same(left, right):
    assert left.exceptAll(right).count() == 0
    assert right.exceptAll(left).count() == 0


def test_sliced_row_number_equals_window(skewed):
    plain = skewed.withColumn(
        "n", F.row_number().over(W.partitionBy("k").orderBy("ts_ms", "request_id")).cast("long")
    )
    for slice_ms in (1, 500, 10_000_000):
        out = skew.sliced_row_number(
            skewed, ["k"], ["ts_ms", "request_id"], skew.time_slice("ts_ms", slice_ms), "n"
        )
        same(out.select(plain.columns), plain)


def test_sliced_lag_equals_window(skewed):
    plain = skewed.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("ts_ms", "request_id")))
    out = skew.sliced_lag(
        skewed, ["k"], ["ts_ms", "request_id"], skew.time_slice("ts_ms", 700), {"v": "p"}
    )
    same(out.select(plain.columns), plain)


def test_top_n_equals_window(skewed):
    order = [F.desc("ts_ms"), F.desc("request_id")]
    plain = (
        skewed.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(*order)))
        .filter("n <= 50")
        .drop("n")
    )
    same(skew.top_n_per_key(skewed, ["k"], order, 50, ["request_id"]), plain)


def test_exact_quantiles_are_nearest_rank(skewed):
    probs = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = {r["k"]: r for r in skew.exact_quantiles(skewed, ["k"], "v", probs).collect()}
    values: dict[str, list[int]] = {}
    for r in skewed.collect():
        values.setdefault(r["k"], []).append(r["v"])
    for k, vs in values.items():
        vs.sort()
        for name, p in probs.items():
            rank = max(1, -(-int(round(p * 1000)) * len(vs) // 1000))
            assert out[k][name] == vs[rank - 1], (k, name)


def test_order_key_orders_like_the_pair(spark):
    rows = [(5, 9), (5, 2**62), (6, 0), (4, 2**62), (1_700_000_000_000, 3), (5, -9), (6, -(2**63)), (-1, -1), (7, 2**63 - 1)]
    df = spark.createDataFrame(rows, "t long, i long").withColumn("key", skew.order_key("t", "i"))
    assert [(r.t, r.i) for r in df.orderBy("key").collect()] == sorted(rows)
    assert all(r.t == r.back for r in df.withColumn("back", skew.order_key_ts(F.col("key"))).collect())


def test_histogram_numbers(spark):
    rows = [(i, "m", int(ms * 1000)) for i, ms in enumerate([5, 50, 120, 800, 4500])]
    df = spark.createDataFrame(rows, "request_id long, model string, latency_us long")
    hist = {r["le"]: r for r in metrics.latency_histogram(df).collect()}
    assert [hist[le]["cum_count"] for le in ("0.005", "0.05", "0.25", "1.0", "5.0", "+Inf")] == [
        1, 2, 3, 4, 5, 5
    ]
    assert hist["+Inf"]["sum_us"] == 5_475_000 and hist["+Inf"]["count"] == 5
    q = metrics.histogram_quantile(metrics.latency_histogram(df), 0.5).first()["quantile_sec"]
    assert q == pytest.approx(0.1 + 0.15 * 0.5)


def test_percentiles_and_error_rate(spark):
    rows = [(i, i, "m", 200 if i % 4 else 503, (i + 1) * 1000) for i in range(20)]
    df = spark.createDataFrame(
        rows, "request_id long, ts_ms long, model string, status int, latency_us long"
    )
    card = metrics.model_scorecard(df).first()
    assert (card["p50_us"], card["p95_us"], card["p99_us"]) == (10_000, 19_000, 20_000)
    assert (card["requests"], card["errors"], card["error_rate"]) == (20, 5, 0.25)
    assert metrics.error_rate(df.limit(0)).count() == 0
    newest = metrics.recent_percentiles(df, n=5).first()
    assert (newest["p50_us"], newest["samples"]) == (18_000, 5)


def test_shadow_pairs_models(spark):
    rows = [(1, 1, "m", 200, 100), (2, 2, "shadow:m", 500, 300), (3, 3, "shadow:x", 200, 5)]
    df = spark.createDataFrame(
        rows, "request_id long, ts_ms long, model string, status int, latency_us long"
    )
    out = {r["model"]: r for r in metrics.shadow_compare(df).collect()}
    assert out["m"]["delta_p50_us"] == 200 and out["m"]["delta_error_rate"] == 1.0
    assert out["x"]["primary_requests"] is None


def test_chargeback_conserves_tokens(spark):
    rows = [(f"u{i % 4}", "m", 10, 20) for i in range(20)] + [("u0", "m", -5, 0), (None, "a|b", 0, 3)]
    schema = "user_name string, model string, prompt_tokens long, completion_tokens long"
    out = tokens.token_chargeback(spark.createDataFrame(rows, schema))
    total = out.filter("model = 'm'").agg(F.sum("tokens_in"), F.sum("tokens_out"), F.count("*")).first()
    assert tuple(total) == (200, 400, 4)
    odd = out.filter("model <> 'm'").first()
    assert (odd["user_name"], odd["model"], odd["tokens_in"], odd["tokens_out"]) == ("unknown", "a_b", 0, 3)
    assert tokens.top_consumers(out, 1).first()["user_name"] == "u0"


def test_scrape_loads(spark):
    pages = [
        'nv_gpu_utilization{gpu="0",gpu_uuid="a"} 45.5\nnv_gpu_utilization{gpu="1",gpu_uuid="b"} 55.5\n',
        'nv_inference_request_success{model="m"} 3\n',
        "",
        "something 1\n",
        'nv_inference_pending_request_count{model="a"} 12\nnv_inference_pending_request_count{model="b"} 3\n'
        'nv_inference_pending_request_count{model="c"} 0\nnv_inference_pending_request_count{model="d"} 1.2.3\n',
    ]
    df = spark.createDataFrame(
        [("h", f"c{i}", i, i, body) for i, body in enumerate(pages)],
        "host string, container_id string, ts_ms long, scrape_id long, body string",
    )
    expected = [(0.505, 0), (0.3, 0), (0.0, 0), (0.0, 0), (0.0, 15)]
    exploded = fleet.scrape_load(df, telemetry.parse_exposition(df))
    for out in (exploded, fleet.scrape_load_inline(df)):
        got = [(r["gpu_load"], r["queue_depth"]) for r in out.orderBy("scrape_id").collect()]
        assert [g[0] for g in got] == pytest.approx([e[0] for e in expected])
        assert [g[1] for g in got] == [e[1] for e in expected]


def test_routing_prefers_low_depth_then_host(spark):
    roster = spark.createDataFrame(
        [("c1", "h2", 0), ("c2", "h1", 1), ("c3", "h3", 2)], "container_id string, host string, ord int"
    )
    depth = spark.createDataFrame(
        [("c1", 500, 1, 4), ("c2", 600, 2, 4), ("c3", 700, 3, 9), ("c2", 2500, 4, 1), ("c2", 2600, 5, 7)],
        "container_id string, ts_ms long, event_id long, depth int",
    )
    requests = spark.createDataFrame([(i, t) for i, t in enumerate([100, 1100, 2900, 3100])],
                                     "request_id long, ts_ms long")
    out = routing.route_least_loaded(requests, depth, roster, tick_ms=1000).orderBy("request_id")
    assert [r["routed_container"] for r in out.collect()] == ["c2", "c2", "c2", "c1"]
    none = routing.route_least_loaded(requests, depth, roster.limit(0), tick_ms=1000)
    assert {r["routed_container"] for r in none.collect()} == {None}


def test_drain_picks_list_order_on_ties(spark):
    roster = spark.createDataFrame(
        [("d", "c1", "h2", 0), ("d", "c2", "h1", 1)], "deployment string, container_id string, host string, ord int"
    )
    depth = spark.createDataFrame([], "container_id string, ts_ms long, event_id long, depth int")
    assert routing.drain_candidate(depth, roster).first()["container_id"] == "c1"


def sequential_plan(weights, total):
    clean = [max(0, w or 0) for w in weights]
    if sum(clean) == 0:
        return [1] * len(weights)
    exact = [w * total / sum(clean) for w in clean]
    out = [int(e // 1) if w == 0 or e >= 1 else 1 for w, e in zip(clean, exact)]
    rem = [e - e // 1 for e in exact]
    for _ in range(max(0, total - sum(out))):
        best = max((i for i, w in enumerate(clean) if w > 0 and rem[i] >= 0), key=lambda i: (rem[i], -i), default=None)
        if best is None:
            break
        out[best] += 1
        rem[best] = -1
    return out


def plan(spark, specs):
    rows = [
        (f"d{i}", total, [(f"v{j}", w) for j, w in enumerate(ws)]) for i, (total, ws) in enumerate(specs)
    ]
    df = spark.createDataFrame(rows, "name string, replicas int, traffic array<struct<name:string,weight:int>>")
    got: dict[str, list] = {}
    for r in deployments.allocate_replicas(df).orderBy("name", "pos").collect():
        got.setdefault(r["name"], []).append(r["replicas"])
    return [got[f"d{i}"] for i in range(len(specs))]


def test_replica_allocation_numbers(spark):
    specs = [(10, [90, 10]), (100, [50, 30, 20]), (7, [90, 10]), (10, [100, 0]), (3, [0, None])]
    assert plan(spark, specs) == [[9, 1], [50, 30, 20], [6, 1], [10, 0], [1, 1]]


def test_replica_allocation_against_replay(spark):
    rng = random.Random(3)
    specs = [
        (rng.randrange(0, 30), [rng.choice([None, 0, 1, 2, 3, 5, 50, 99]) for _ in range(rng.randrange(1, 7))])
        for _ in range(600)
    ]
    assert plan(spark, specs) == [sequential_plan(ws, total) for total, ws in specs]


def deployment_rows(spark, docs):
    return policies.read_deployments(spark.createDataFrame([(d,) for d in docs], "doc string"))


def test_deployment_defaults_status_and_demand(spark):
    docs = [
        '{"metadata":{"name":"a"},"spec":{"image":"i","modelRepository":"s3://m","replicas":2,'
        '"tensorParallelism":2,"accelerator":{"type":"amd_gpu","count":2},'
        '"env":[{"name":"A","value":"1"}],'
        '"traffic":[{"name":"v1","weight":75},{"name":"v2","weight":25,"image":"j","modelRepository":"n"}]}}',
        '{"metadata":{"name":"b"},"spec":{"modelRepository":"m"}}',
        '{"metadata":{"name":"c"},"spec":{"image":"i","modelRepository":"m","accelerator":{"type":"cpu_only"}}}',
    ]
    df = deployment_rows(spark, docs).cache()
    c = df.filter("name = 'c'").first()
    assert (c["replicas"], c["memory"], c["cpu"], c["proxy_port"], c["scaling_mode"]) == (1, "4Gi", "2", 9000, "composite")
    assert (c["min_replicas"], c["max_replicas"], c["up_threshold"], c["down_threshold"]) == (1, 10, 0.7, 0.2)
    demand = {r["resource"]: r for r in deployments.capacity_demand(df).collect()}
    assert demand["amd.com/gpu"]["units"] == 8 and None not in demand
    pods = spark.createDataFrame([("a", 1), ("a", 1), ("c", 0)], "name string, ready_replicas int")
    status = {r["name"]: r for r in deployments.deployment_status(df, pods).collect()}
    assert [status[n]["phase"] for n in "abc"] == ["Ready", "Failed", "Reconciling"]
    assert status["a"]["message"] == "2/2 replicas ready" and status["b"]["reason"] == "InvalidSpec"
    variants = {r["deployment_name"]: r for r in deployments.effective_variants(df).collect()}
    assert (variants["a-v1"]["image"], variants["a-v2"]["model_repository"]) == ("i", "n")
    running = spark.createDataFrame(
        [("a", "v1"), ("a", "old"), ("a", None), ("c", None), ("c", "v1")], "name string, variant string"
    )
    stale = {(r["name"], r["variant"]) for r in deployments.stale_variants(df, running).collect()}
    assert stale == {("a", "old"), ("a", None), ("c", "v1")}
    broken = {(r["name"], r["violation"]) for r in policies.audit_deployments(df).collect()}
    assert broken == {("b", "image_required")}


def test_phase_events(spark):
    phases = ["Reconciling", "Ready", "Ready", "Reconciling", "Failed", "Failed", "Ready"]
    df = spark.createDataFrame(
        [("d", i * 86_400_000 // 2, i, p) for i, p in enumerate(phases)],
        "name string, ts_ms long, seq long, phase string",
    )
    out = deployments.phase_transitions(df).orderBy("seq").collect()
    assert [(r["seq"], r["event_type"], r["reason"]) for r in out] == [
        (1, "Normal", "Ready"), (3, "Normal", "Reconciling"), (4, "Warning", "InvalidSpec"),
        (5, "Warning", "InvalidSpec"), (6, "Normal", "Ready"),
    ]


def test_counter_resets(spark):
    values = [10, 15, 3, 8]
    df = spark.createDataFrame(
        [("c", i * 1000, i, v) for i, v in enumerate(values)], "c string, ts_ms long, seq long, value long"
    )
    out = metrics.counter_increase(df, ["c"], window_ms=10_000, slice_ms=2000).first()
    assert out["increase"] == 5 + 3 + 5


def test_reconcile_snapshot(spark):
    desired = spark.createDataFrame(
        [("b", f"i{n}", n) for n in range(5)], "backend string, instance string, inst_ord long"
    )
    slots = spark.createDataFrame(
        [("b", "s0", 0, "i1", 0), ("b", "s1", 1, "i0", 1), ("b", "s2", 2, "old", 0), ("b", "s3", 3, "i1", 0)],
        "backend string, slot string, slot_ord long, instance string, admin_state int",
    )
    out = {(r["instance"], r["slot"], r["action"]) for r in fleet.reconcile_snapshot(desired, slots, 2).collect()}
    assert out == {
        ("i1", "s0", "keep"), ("i0", "s1", "enable"), ("i2", "s2", "assign"), ("i3", "s3", "assign"),
        ("i4", None, "unplaced"),
    }
    spare = fleet.reconcile_snapshot(desired.filter("instance = 'i1'"), slots)
    assert {(r["slot"], r["action"]) for r in spare.collect()} == {("s0", "keep"), ("s2", "maint"), ("s3", "maint")}


def test_health_codes(spark):
    roster = spark.createDataFrame([("h1",), ("h2",)], "host string")
    probes = spark.createDataFrame([("h1", 1, 1, True), ("h1", 2, 2, False)], "host string, ts_ms long, event_id long, ready boolean")
    assert fleet.fleet_health(probes, roster).first()["health"] == "NO_INSTANCES_READY"
    assert fleet.fleet_health(probes.filter("ready"), roster).first()["health"] == "OK"
    strict = fleet.fleet_health(probes, roster, authz="degraded_strict").first()
    assert (strict["health"], strict["proxy_health"]) == ("RANGER_UNAVAILABLE", "OK")
    assert fleet.fleet_health(probes, roster.limit(0)).first()["proxy_health"] == "NO_BACKENDS"


def test_roster_and_startup(spark):
    rows = [
        ("c1", "h", 1, 1, "start"), ("c1", "h", 5, 2, "ready"), ("c1", "h", 6, 3, "registered"),
        ("c2", "h", 2, 4, "registered"), ("c2", "h", 9, 5, "completed"), ("c3", "h", 1, 6, "ready"),
    ]
    df = spark.createDataFrame(rows, "container_id string, host string, ts_ms long, event_id long, event string")
    assert [r[0] for r in fleet.instance_roster(df).collect()] == ["c1"]
    assert {r[0] for r in fleet.instance_roster(df, as_of_ms=8).collect()} == {"c1", "c2"}
    assert {r["container_id"]: r["startup_ms"] for r in fleet.startup_times(df).collect()} == {
        "c1": 4, "c2": None, "c3": None
    }


def test_alerts(spark):
    rows = [(i, i, "scaling_event" if i % 3 else "container_failure", f"m{i}", "info") for i in range(250)]
    df = spark.createDataFrame(rows, "alert_id long, ts_ms long, alert_type string, message string, severity string")
    out = {r["scope"]: r for r in fleet.alert_rollup(df).collect()}
    assert (out["recent"]["alerts"], out["recent"]["container_failures"]) == (100, 34)
    assert (out["all"]["alerts"], out["all"]["scaling_events"]) == (250, 166)
    line = fleet.recent_alert_lines(df, 1).first()["line"]
    assert line == "# [1970-01-01T00:00:00.249Z] INFO - container_failure: m249"
    control = spark.createDataFrame(
        [(1, 1, "zk_connection_lost", "LOST"), (2, 2, "zk_connection_lost", "SUSPENDED"), (3, 3, "ranger_degraded", None)],
        "event_id long, ts_ms long, event string, detail string",
    )
    assert [r["severity"] for r in fleet.control_alerts(control, strict=False).orderBy("alert_id").collect()] == [
        "critical", "warning", "warning"
    ]


def test_drains(spark):
    drains = spark.createDataFrame([("a", 1, 1000), ("a", 2, 50_000), ("b", 3, 1000), ("c", 4, 1000)],
                                   "container_id string, drain_id long, drain_ms long")
    depth = spark.createDataFrame(
        [("a", 500, 1, 4), ("a", 20_000, 2, 0), ("a", 40_000, 3, 6), ("b", 100, 4, 3), ("b", 30_000, 5, 2),
         ("b", 31_500, 6, 0)],
        "container_id string, ts_ms long, event_id long, depth int",
    )
    out = {r["drain_id"]: (r["verdict"], r["remaining"]) for r in fleet.drain_verdicts(drains, depth).collect()}
    assert out == {1: ("drained", 0), 2: ("drain_timeout", 6), 3: ("drain_timeout", 2), 4: ("drained", 0)}


def test_spans_and_logs(spark):
    attrs = {"model": "m", "user": "u", "stream": "false"}
    spans = spark.createDataFrame(
        [("t", "s", None, "POST", "SERVER", 0, 1000, attrs), ("t", "c", "s", "up", "CLIENT", 100, 900, attrs)],
        "trace_id string, span_id string, parent_span_id string, name string, kind string, start_us long,"
        " end_us long, attrs map<string,string>",
    )
    out = traces.proxy_overhead(spans).first()
    assert (out["calls"], out["p50_us"], out["stream"]) == (1, 200, False)
    logs = spark.createDataFrame(
        [("WARN", {"trace_id": "t", "span_id": "s"}), ("ERROR", {"trace_id": "t", "span_id": "s"}), ("INFO", {})],
        "level string, mdc map<string,string>",
    )
    row = traces.correlate_logs(logs, spans).first()
    assert (row["lines"], row["warnings"], row["errors"]) == (2, 1, 1)


def test_scoring_routes_by_base(spark):
    def triple():
        return lambda batch: batch * 3

    df = spark.createDataFrame(
        [(1, "a#x", [1.0, 2.0]), (2, "b", [1.0, 1.0]), (3, "none", [0.0, 0.0])],
        "id long, model string, x array<float>",
    )
    models = {"a": triple, "b": scoring.identity_model}
    for salts in (None, 4):
        out = scoring.score_routed(df, models, "model", "x", cluster_salts=salts, row_id="id")
        assert {r["id"]: r["score"] for r in out.collect()} == {1: [3.0, 6.0], 2: [1.0, 1.0], 3: None}


def test_asof_equals_scan(spark):
    rng = random.Random(11)
    marks = [(rng.choice("hhhab"), rng.randrange(0, 5000), i, rng.choice([None, 0, 1, 2])) for i in range(500)]
    points = [(rng.choice("hhabz"), rng.randrange(0, 5000), rng.random() < 0.5, i) for i in range(300)]
    m = spark.createDataFrame(marks, "k string, ts_ms long, event_id long, v int")
    p = spark.createDataFrame(points, "k string, ts_ms long, inclusive boolean, pid long")
    out = {r["pid"]: r["v"] for r in skew.asof_last(m, p, ["k"], ["v"], slice_ms=300).collect()}
    for k, ts, inclusive, pid in points:
        seen = [x for x in marks if x[0] == k and x[3] is not None and (x[1] < ts or (inclusive and x[1] == ts))]
        assert out[pid] == (max(seen, key=lambda x: (x[1], x[2]))[3] if seen else None)
    assert len(out) == len(points)


def test_null_keys_are_keys(spark):
    shape = "request_id long, model string, status int, latency_us long"
    rows = [(1, None, 200, 10), (2, None, 500, 30), (3, "m", 200, 20), (4, "shadow:m", 200, 25)]
    requests = spark.createDataFrame(rows, shape)
    card = {r["model"]: r for r in metrics.model_scorecard(requests).collect()}
    assert (card[None]["requests"], card[None]["p50_us"], card[None]["p99_us"]) == (2, 10, 30)
    pairs = {r["model"]: r for r in metrics.shadow_compare(requests).collect()}
    assert pairs[None]["primary_requests"] == 2 and pairs["m"]["delta_p50_us"] == 5
    samples = spark.createDataFrame([(None, 0, 1, 5), (None, 10, 2, 9), ("a", 0, 3, 1)], "k string, ts_ms long, seq long, value long")
    grown = {r["k"]: r["increase"] for r in metrics.counter_increase(samples, ["k"], 1000).collect()}
    assert grown == {None: 4, "a": 0}
    spans = spark.createDataFrame(
        [("t", "s", None, "SERVER", 0, 100, {"user": "u"}), ("t", "c", "s", "CLIENT", 10, 70, {})],
        "trace_id string, span_id string, parent_span_id string, kind string, start_us long, end_us long, attrs map<string,string>",
    )
    (row,) = traces.proxy_overhead(spans).collect()
    assert (row["model"], row["user_name"], row["calls"], row["p50_us"]) == (None, "u", 1, 40)


def test_percentiles_of_all_or_of_the_newest(spark):
    rows = [(i, "m", 200, i, i) for i in range(1, 2001)]
    requests = spark.createDataFrame(rows, "request_id long, model string, status int, latency_us long, ts_ms long")
    assert metrics.model_scorecard(requests).first()["p50_us"] == 1000
    assert metrics.model_scorecard(requests, recent=1000).first()["p50_us"] == 1500


def test_corrupt_scrapes_do_not_end_the_job(spark):
    body = (
        'nv_inference_pending_request_count{model="a"} 99999999999\n'
        'nv_gpu_utilization{gpu="0"} 4.55e1\nnv_gpu_utilization{gpu="1"} -3\nnv_gpu_utilization{gpu="2"} 1.2.3\n'
    )
    scrapes = spark.createDataFrame([("h", "c", 0, 1, body)], "host string, container_id string, ts_ms long, scrape_id long, body string")
    one = fleet.scrape_load(scrapes, telemetry.parse_exposition(scrapes)).first()
    two = fleet.scrape_load_inline(scrapes).first()
    assert (one["gpu_load"], one["queue_depth"]) == (two["gpu_load"], two["queue_depth"])
    assert one["queue_depth"] == 2**31 - 1 and one["gpu_load"] == pytest.approx(0.0455)


def test_routes_against_a_plain_walk(spark):
    rng = random.Random(3)
    roster = [(f"c{i}", f"h{i % 3}", i) for i in range(7)]
    readings = [(f"c{rng.randrange(7)}", rng.randrange(0, 4000), i - 500, rng.randrange(5)) for i in range(300)]
    calls = [(i, rng.randrange(-50, 5000)) for i in range(400)]
    out = routing.route_least_loaded(
        spark.createDataFrame(calls, "request_id long, ts_ms long"),
        spark.createDataFrame(readings, "container_id string, ts_ms long, event_id long, depth int"),
        spark.createDataFrame(roster, "container_id string, host string, ord int"),
        tick_ms=10,
    )
    for r in out.collect():
        tick = r["ts_ms"] // 10
        depths = {}
        for c, ts, event, depth in sorted(readings, key=lambda x: (x[1], x[2])):
            if ts // 10 + 1 <= tick:
                depths[c] = depth
        want = min((depths.get(c, 0), h, o, c) for c, h, o in roster)
        assert (r["routed_depth"], r["routed_host"], r["routed_container"]) == (want[0], want[1], want[3])

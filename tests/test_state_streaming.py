from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from servelens.operators import quota, state, tokens
from servelens.sources import policies
from servelens.streaming import aggregates, limiter, stateful

PROBE = "host string, ts_ms long, event_id long, ready boolean"


def step_breaker(probes, threshold, reset_ms):
    """One probe at a time."""
    mode, fails, opened, out = "CLOSED", 0, 0, []
    for host, ts, rid, ready in probes:
        if mode == "OPEN":
            if ts - opened < reset_ms:
                continue
            out.append((host, ts, rid, 0, "OPEN", "HALF_OPEN"))
            mode = "HALF_OPEN"
        if mode == "HALF_OPEN":
            mode = "CLOSED" if ready else "OPEN"
            opened, fails = ts, 0
            out.append((host, ts, rid, 1, "HALF_OPEN", mode))
        elif ready:
            fails = 0
        else:
            fails += 1
            if fails >= threshold:
                mode, opened = "OPEN", ts
                out.append((host, ts, rid, 0, "CLOSED", "OPEN"))
    return out


def probe_rows(seed, hosts=("a", "b"), n=400):
    rng = random.Random(seed)
    rows, rid = [], 0
    for host in hosts:
        ts, p = 0, 0.3
        for _ in range(n):
            ts += rng.choice([0, 1, 5, 5, 5, 40, 200])
            p = rng.choice([p, p, p, 0.05, 0.6, 0.95])
            rows.append((host, ts, rid, rng.random() > p))
            rid += 1
    return rows


@pytest.mark.parametrize(("seed", "chunk_ms", "reset_ms"), [(0, 50, 30), (1, 50, 200), (2, 1000, 30), (3, 10, 45), (4, 10**9, 30)])
def test_breaker_chunks_equal_replay(spark, seed, chunk_ms, reset_ms):
    rows = probe_rows(seed)
    expected = sorted(step_breaker([r for r in rows if r[0] == "a"], 3, reset_ms) + step_breaker([r for r in rows if r[0] == "b"], 3, reset_ms))
    df = spark.createDataFrame(rows, PROBE).repartition(5)
    out = state.breaker_transitions(df, threshold=3, reset_ms=reset_ms, chunk_ms=chunk_ms)
    assert sorted(tuple(r) for r in out.collect()) == expected


def test_breaker_numbers(spark):
    fail = [("h", t, t, False) for t in (0, 10, 20)]
    out = lambda rows: [r["to_state"] for r in state.breaker_transitions(
        spark.createDataFrame(rows, PROBE), threshold=3, reset_ms=100).orderBy("ts_ms", "step").collect()]
    assert out(fail) == ["OPEN"]
    assert out(fail + [("h", 119, 3, True)]) == ["OPEN"]
    assert out(fail + [("h", 120, 3, True)]) == ["OPEN", "HALF_OPEN", "CLOSED"]
    assert out(fail + [("h", 130, 3, False)]) == ["OPEN", "HALF_OPEN", "OPEN"]
    assert out(fail[:2] + [("h", 15, 9, True)] + [("h", 30, 10, False)]) == []


def step_scaling(loads, limits, target=1):
    changed, out = None, []
    for d, tick, ts, load in loads:
        if changed is not None and ts - changed < limits.cooldown_ms:
            continue
        new = target
        if load > limits.up and target < limits.maximum:
            new += 1
        elif load < limits.down and target > limits.minimum:
            new -= 1
        if new != target:
            out.append((d, tick, ts, "scale_up" if new > target else "scale_down", target, new))
            target, changed = new, ts
    return out


SIGNAL = "deployment string, tick long, ts_ms long, load double"


def signal_rows(seed, n=300):
    rng = random.Random(seed)
    return [(d, t, t * 15_000, rng.random()) for d in ("x", "y") for t in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_scaling_equals_replay(spark, seed):
    rows, limits = signal_rows(seed), state.ScalingLimits(maximum=3, cooldown_ms=40_000)
    expected = sorted(step_scaling([r for r in rows if r[0] == "x"], limits) + step_scaling([r for r in rows if r[0] == "y"], limits))
    out = state.scale_recommendations(spark.createDataFrame(rows, SIGNAL).repartition(4), limits=limits)
    assert sorted(tuple(r) for r in out.collect()) == expected


@pytest.mark.parametrize(("target", "load", "after"), [(1, 0.8, 2), (2, 0.1, 1), (1, 0.5, 1), (10, 0.9, 10), (1, 0.1, 1)])
def test_scaling_numbers(spark, target, load, after):
    df = spark.createDataFrame([("d", 0, 0, load), ("d", 1, 1000, load)], SIGNAL)
    out = state.scale_recommendations(df, initial_target=target).collect()
    assert (out[0]["to_target"] if out else target) == after and len(out) <= 1


def feed(spark, df, path, key, parts):
    """Write ``df`` as ``parts`` files in key order, one micro-batch each."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    width = (hi - lo) // parts + 1
    for i in range(parts):
        piece = df.filter((F.col(key) >= lo + i * width) & (F.col(key) < lo + (i + 1) * width))
        piece.coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(out)


def usage_rows(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(4)}", "m", rng.randrange(-2, 9), rng.randrange(9), t * 60_000) for t in range(600)]
    return spark.createDataFrame(rows, "user_name string, model string, prompt_tokens long, completion_tokens long, ts_ms long")


def closed(df, last_ms, window_ms=3_600_000):
    """Windows the watermark has passed when the input ends."""
    return df.filter(F.col("window_start_ms") + window_ms <= last_ms)


def test_streamed_chargeback_equals_batch(spark, tmp_path):
    usage = usage_rows(spark)
    feed(spark, usage, str(tmp_path / "in"), "ts_ms", 4)
    streamed = run(
        aggregates.windowed_chargeback(stream_of(spark, str(tmp_path / "in"), usage.schema), watermark="0 seconds"), tmp_path
    )
    batch = closed(aggregates.windowed_chargeback(usage), 599 * 60_000)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    whole = aggregates.running_totals(aggregates.windowed_chargeback(usage))
    assert whole.select("user_name", "model", "tokens_in", "tokens_out").exceptAll(tokens.token_chargeback(usage)).count() == 0


def test_streamed_metrics_equal_batch(spark, tmp_path):
    rows = [(i, i * 60_000, f"m{i % 2}", 200 if i % 7 else 500, (i * 7919) % 900_000) for i in range(500)]
    df = spark.createDataFrame(rows, "request_id long, ts_ms long, model string, status int, latency_us long")
    feed(spark, df, str(tmp_path / "in"), "ts_ms", 3)
    streamed = run(
        aggregates.windowed_metrics(stream_of(spark, str(tmp_path / "in"), df.schema), watermark="0 seconds"), tmp_path
    )
    batch = closed(aggregates.windowed_metrics(df), 499 * 60_000)
    assert batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_streamed_breaker_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(probe_rows(9), PROBE)
    feed(spark, df, str(tmp_path / "in"), "ts_ms", 3)
    out = run(stateful.stream_breaker(stream_of(spark, str(tmp_path / "in"), df.schema), 3, 30), tmp_path)
    batch = state.breaker_transitions(df, 3, 30)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_scaling_equals_batch(spark, tmp_path):
    limits = state.ScalingLimits(maximum=4, cooldown_ms=40_000)
    df = spark.createDataFrame(signal_rows(4, 120), SIGNAL)
    feed(spark, df, str(tmp_path / "in"), "tick", 3)
    out = run(stateful.stream_scaling(stream_of(spark, str(tmp_path / "in"), df.schema), limits=limits), tmp_path)
    batch = state.scale_recommendations(df, limits=limits)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_readiness(spark, tmp_path):
    rows = [("a", "start", 0), ("b", "start", 0), ("a", "probe_ready", 50_000), ("z", "start", 400_000), ("z", "probe_ready", 401_000),
            ("y", "start", 900_000)]
    rows = [(c, e, t + 1_000_000) for c, e, t in rows]
    df = spark.createDataFrame(rows, "container_id string, event string, ts_ms long")
    feed(spark, df, str(tmp_path / "in"), "ts_ms", 3)
    events = aggregates.event_time(stream_of(spark, str(tmp_path / "in"), df.schema), "0 seconds")
    out = run(stateful.stream_readiness(events, 120_000), tmp_path)
    got = {(r["container_id"], r["verdict"], r["took_ms"]) for r in out.collect()}
    assert got == {("a", "warmup_ok", 50_000), ("b", "warmup_timeout", None), ("z", "warmup_ok", 1000)}


def test_streamed_roster(spark, tmp_path):
    rows = [("c1", "h", 1, 1, "registered"), ("c2", "h", 2, 2, "registered"), ("c2", "h", 9, 3, "completed")]
    df = spark.createDataFrame(rows, "container_id string, host string, ts_ms long, event_id long, event string")
    feed(spark, df, str(tmp_path / "in"), "ts_ms", 2)
    seen = {}

    def keep(batch, epoch):
        seen.update({r["container_id"]: r["event"] for r in batch.collect()})

    query = (
        aggregates.running_roster(stream_of(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete")
        .foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert seen == {"c1": "registered", "c2": "completed"}


def test_streamed_limits_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, i * 97, f"u{rng.randrange(3)}", [f"g{rng.randrange(2)}"], f"m{rng.randrange(2)}") for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, ts_ms long, user_name string, groups array<string>, base_model string")
    docs = spark.createDataFrame(
        [(1, 0, '{"rules":[{"requestsPerMinute":4},{"user":"u1","requestsPerMinute":2}]}'), (2, 15_000, "{broken"),
         (3, 20_000, '{"rules":[{"group":"g0","requestsPerMinute":3},{"user":"u2","requestsPerMinute":0}]}')],
        "version int, valid_from_ms long, doc string",
    )
    versions = str(tmp_path / "versions")
    docs.write.parquet(versions)
    feed(spark, df, str(tmp_path / "in"), "ts_ms", 4)
    sink = limiter.StreamLimiter(versions, str(tmp_path / "state"), str(tmp_path / "out"), window_ms=5_000)
    query = (
        stream_of(spark, str(tmp_path / "in"), df.schema).writeStream.foreachBatch(sink)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    columns = ["request_id", "allowed", "retry_after_ms", "reason", "rule_desc"]
    out = spark.read.parquet(str(tmp_path / "out" / "epoch-*"))
    assert out.filter("late").count() == 0
    valid = policies.valid_versions(docs)
    batch = quota.quota_decisions(
        quota.rules_asof(df, valid), policies.load_quota_rules(valid), window_ms=5_000, version="version"
    )
    got = sorted(map(str, out.select(columns).collect()))
    assert got == sorted(map(str, batch.select(columns).collect()))
    alerts = limiter.reload_alerts(valid, seen_until_ms=0).collect()
    assert [a["alert_type"] for a in alerts] == ["quota_reloaded"]

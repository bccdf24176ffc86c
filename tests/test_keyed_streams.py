"""Streams with rows out of order, over several triggers and restarts, against the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from servelens.operators import fleet, quota
from servelens.plans import adjudication, views
from servelens.session import stage
from servelens.sources import policies
from servelens.streaming import adjudication as one_stream
from servelens.streaming import keyed
from servelens.streaming.roster import RosterTable


@pytest.fixture(scope="module", autouse=True)
def few_state_stores(spark):
    """Every state store of a trigger starts a worker, so these small streams have one; the registered ones have more."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, tmp_path, rows, schema, cuts, build, mode="append", sink=None):
    """Give ``rows`` to a stream in ``cuts`` runs, each of which is a restart."""
    path, size = str(tmp_path / "in"), -(-len(rows) // cuts)
    for k in range(0, len(rows), size):
        part = spark.createDataFrame(rows[k : k + size], schema)
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path)
        writer = build(stream).writeStream.option("checkpointLocation", str(tmp_path / "ck")).outputMode(mode)
        if sink is None:
            writer = writer.format("parquet").option("path", str(tmp_path / "out"))
        else:
            writer = writer.foreachBatch(sink)
        started = writer.trigger(availableNow=True).start()
        started.awaitTermination(240)
        assert started.exception() is None
    return None if sink else spark.read.parquet(str(tmp_path / "out"))


def shuffled(rows, ts, lateness, seed=0):
    """Rows in an order in which none comes more than ``lateness`` after a newer one."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[ts] + rng.random() * lateness)


CALL = "request_id long, ts_ms long, user_name string, groups array<string>, base_model string"
RULES = '{"rules":[{"requestsPerMinute":4},{"user":"u1","requestsPerMinute":2},{"user":"u2","requestsPerMinute":0},{"group":"g9","model":"m9","requestsPerMinute":1}]}'


def calls(n=400, seed=2):
    rng = random.Random(seed)
    return [
        (i * 7 % n, 1_000_000 + i * 97 // 3 * 3, f"u{rng.randrange(4)}", rng.choice([None, [], [f"g{rng.randrange(2)}"]]), f"m{rng.randrange(2)}")
        for i in range(n)
    ]


def rules(spark, doc=RULES):
    return policies.load_quota_rules(spark.createDataFrame([(doc,)], "doc string"))


DECISION = ["request_id", "allowed", "retry_after_ms", "reason", "rule_desc"]
MATCHED = "bucket string, request_id long, ts_ms long, rpm int, rule_user string, rule_group string, rule_model string"


def decided(placed, window_ms):
    fields = F.from_json("payload", "rule_user string, rule_group string, rule_model string")
    return quota.decide(placed.withColumn("r", fields).select("*", "r.*"), window_ms)


def test_limits_of_shuffled_files_equal_batch(spark, tmp_path):
    batch = quota.match_quota_rule(spark.createDataFrame(calls(), CALL), rules(spark))
    marker = (None, 10_000, 9_999_999_999, 1, None, None, None)
    rows = [tuple(r) for r in batch.select("bucket", "request_id", "ts_ms", "rpm", "rule_user", "rule_group", "rule_model").collect()]
    rows = shuffled(rows, 2, 3_000) + [marker]

    def build(stream):
        payload = F.to_json(F.struct("rule_user", "rule_group", "rule_model"))
        return keyed.place_requests(stream.withColumn("p", payload), 5_000, lateness_ms=3_000, payload="p")

    out = decided(feed(spark, tmp_path, rows, MATCHED, 3, build), 5_000).where("request_id < 10000")
    assert out.where("late").count() == 0
    want = quota.rate_limit(batch, window_ms=5_000)
    assert sorted(map(str, out.select(DECISION).collect())) == sorted(map(str, want.select(DECISION).collect()))
    assert {r.reason for r in want.collect()} == {None, "rate_limited", "quota_zero"}


def test_late_calls_come_out_flagged(spark, tmp_path):
    T = 1_000_000
    rows = [("b", i, T + 1_000 * i, 2, None, None, None) for i in range(1, 40)]
    rows += [("b", 100, T + 5_500, 2, None, None, None), ("c", 101, T + 5_500, 2, None, None, None)]
    rows += [("b", i, T + 1_000 * i, 2, None, None, None) for i in range(40, 60)] + [("z", 999, 10**9, 1, None, None, None)]
    # Two runs: the late calls come after those around them were released.
    build = lambda s: keyed.place_requests(s, 10_000, lateness_ms=2_000, grace_ms=60_000)
    out = {r.request_id: r for r in feed(spark, tmp_path, rows, MATCHED, 4, build).collect()}
    # Nothing of bucket c was released before, so its call is in order and has its place.
    assert out[100].late and out[100].place is None and not out[101].late and out[101].place == 1
    assert all(not out[i].late and out[i].place == (i - 1) % 10 + 1 for i in range(1, 60))


def test_idle_buckets_begin_anew(spark, tmp_path):
    rows = [("b", 1, 1_000, 1, None, None, None), ("x", 2, 500_000, 1, None, None, None), ("b", 3, 604_000, 1, None, None, None),
            ("z", 4, 10**9, 1, None, None, None)]
    build = lambda s: keyed.place_requests(s, 10_000, idle_ms=100_000)
    out = {r.request_id: r for r in feed(spark, tmp_path, rows, MATCHED, 4, build).collect()}
    assert out[1].window_start_ms == 1_000 and out[3].window_start_ms == 604_000


ROWS = "kind string, container_id string, id long, ts_ms long, depth int"


def test_drains_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], 1_000_000
    for i in range(600):
        at += rng.choice([0, 500, 3_000, 9_000])
        name = f"c{rng.randrange(5)}"
        rows.append(("drain", name, i, at, None) if rng.random() < 0.2 else ("depth", name, i, at, rng.choice([None, 0, 0, 3, 5, 1])))
    rows += [("depth", "c0", 700, at, 4), ("drain", "quiet", 701, at, None), ("depth", "end", 702, at + 10**9, 1)]

    def split(df):
        drains = df.where("kind = 'drain'").select("container_id", F.col("id").alias("drain_id"), F.col("ts_ms").alias("drain_ms"))
        depth = df.where("kind = 'depth'").select("container_id", "ts_ms", F.col("id").alias("event_id"), "depth")
        return drains, depth

    out = feed(spark, tmp_path, shuffled(rows, 3, 20_000), ROWS, 3, lambda s: keyed.stream_drains(*split(s), lateness_ms=20_000))
    drains, depth = split(spark.createDataFrame(rows, ROWS))
    want = fleet.drain_verdicts(drains, depth.where("depth is not null"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(out.columns).collect()))
    assert {r.verdict for r in out.collect()} == {"drained", "drain_timeout"}


RAW = (
    "request_id long, ts_ms long, method string, path string, headers map<string,string>, peer_ip string, "
    "body string, response_body string, groups array<string>, status int, latency_us long"
)


def raw_calls(n=500, seed=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        model = rng.choice(['"m0"', '"m1"', '"m0#l0"', '"m1#l1"', '""', "7"])
        body = '{"model": ' if rng.random() < 0.05 else f'{{"model":{model},"stream":{rng.choice(["true", "false"])}}}'
        path = rng.choice(["/v1/completions"] * 5 + ["/v1/models", "/v1/usage", "/nowhere"])
        response = '{"usage":{"prompt_tokens":3,"completion_tokens":5}}'
        groups = rng.choice([None, ["g0"], ["g1", "g0"]])
        out.append(
            (i, 1_000_000 + i * 731, rng.choice(["POST"] * 9 + ["GET"]), path, {"X-Forwarded-User": f"u{rng.randrange(4)}"}, "1.1.1.1",
             body, response, groups, rng.choice([200, 200, 500]), rng.randrange(9_000))
        )
    return out


@pytest.fixture(scope="module")
def policy_inputs(spark):
    doc = '{"rules":[{"requestsPerMinute":9},{"user":"u1","requestsPerMinute":2},{"user":"u2","model":"m1","requestsPerMinute":0},{"group":"g1","requestsPerMinute":3}]}'
    grants = spark.createDataFrame(
        [("group", "g0", "infer", "m*"), ("user", "u3", "infer", "?1#*"), ("user", "u1", "list", "*")],
        "principal_type string, principal string, access string, resource_glob string",
    )
    depth = spark.createDataFrame([(f"c{i % 3}", 1_050_000 + 9_000 * i, i, (i * 7) % 5) for i in range(20)], "container_id string, ts_ms long, event_id long, depth int")
    roster = spark.createDataFrame([(f"c{i}", f"h{i}", i, "d") for i in range(3)], "container_id string, host string, ord int, deployment string")
    return rules(spark, doc), grants, depth, roster


def test_adjudication_in_one_stream_equals_batch(spark, tmp_path, policy_inputs):
    rows = raw_calls()
    end = (10_000, 10**9, "POST", "/nowhere", {}, "", "", "", None, 200, 0)
    want = adjudication.adjudicate(
        stage(adjudication.identify(spark.createDataFrame(rows, RAW)), "identified"), *policy_inputs, window_ms=60_000, tick_ms=15_000
    )

    def build(stream):
        return one_stream.stream_adjudication(stream, *policy_inputs, lateness_ms=40_000, window_ms=60_000, tick_ms=15_000)

    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    mixed = shuffled(rows, 1, 40_000) + [end]
    out = feed(spark, tmp_path / "a", mixed, RAW, 3, build).where("request_id < 10000").select(want.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert len({r.outcome for r in want.collect()}) > 8
    windows = feed(spark, tmp_path / "b", mixed, RAW, 2, lambda s: one_stream.outcome_windows(build(s), "1 minute"))
    assert windows.select("window_start_ms").distinct().count() > 4
    totals, batch = one_stream.outcome_totals(windows), adjudication.outcome_summary(want)
    assert sorted(map(str, totals.collect())) == sorted(map(str, batch.select(totals.columns).collect()))


def test_policy_table_keys_equal_batch_verdicts(spark, sf_dir):
    """The keys that a stream asks by give what the joins of the batch plan give."""
    calls = stage(adjudication.identify(views.raw_requests(spark, sf_dir)), "identified")
    found = one_stream.resolve_policies(
        calls.withColumn("event_time", F.timestamp_millis("ts_ms")),
        one_stream.policy_table(policies.load_quota_rules(views.rules_docs(spark)), views.grants(spark)),
    )
    names = ["request_id", "rule_user", "rule_group", "rule_model", "rpm"]
    good = "endpoint = 'inference' and request_error is null"
    want = quota.match_quota_rule(calls, policies.load_quota_rules(views.rules_docs(spark))).where(good)
    assert sorted(map(str, found.where(good).select(names).collect())) == sorted(map(str, want.select(names).collect()))


EVENT = "container_id string, host string, ts_ms long, event_id long, event string"


def sizes(root, kind):
    """Rows that each epoch wrote."""
    import pyarrow.parquet as pq

    return {int(p.name[6:]): sum(pq.read_metadata(f).num_rows for f in p.glob("*.parquet")) for p in (root / kind).glob("epoch=*")}


def test_roster_of_changes_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    kinds = (*fleet.LIFECYCLE, "registered", "registered", "ready")
    rows = [(f"c{rng.randrange(200)}", rng.choice(["h", None]), 1_000_000 + i * 500, i, rng.choice(kinds)) for i in range(600)]
    end = ("end", "h", 10**10, 999, "ready")
    table = RosterTable(str(tmp_path / "table"), least_changes=60)
    build = lambda s: keyed.roster_changes(s, fleet.LIFECYCLE, 20_000)
    feed(spark, tmp_path, shuffled(rows, 2, 20_000) + [end], EVENT, 3, build, "update", table)
    want = fleet.instance_roster(spark.createDataFrame(rows, EVENT))
    assert sorted(map(str, table.read(spark).collect())) == sorted(map(str, want.collect()))
    # What is on disk are the changes since the snapshot before the last, no copy of all per trigger.
    assert len(sizes(tmp_path / "table", "snapshots")) == 2
    assert all(n <= 200 for n in sizes(tmp_path / "table", "changes").values())


def test_roster_writes_changes_only_and_forgets(spark, tmp_path):
    rows = [(f"c{i}", "h", 1_000 + i, i, "registered") for i in range(300)]
    rows += [("c1", "h", 50_000, 400, "drain"), ("c1", "h", 50_000, 399, "registered"), ("c2", "h", 10, 401, "drain")]
    rows += [("c3", "h", 90_000, 402, "stopped"), ("zz", "h", 10**7, 403, "registered")]
    rows += [("c4", "h", 10**7, 404, "completed")] + [(f"d{i}", "h", 10**7, 500 + i, "registered") for i in range(9)]
    table = RosterTable(str(tmp_path / "table"), ttl_ms=1_000_000, least_changes=10)
    build = lambda s: keyed.roster_changes(s, fleet.LIFECYCLE, 10_000, 1_000_000)
    feed(spark, tmp_path, rows, EVENT, 1, build, "update", table)
    written = sizes(tmp_path / "table", "changes")
    assert sum(written.values()) <= len(rows)
    live = {r.container_id: r.since_ms for r in table.read(spark).collect()}
    assert "c1" not in live and "c3" not in live and "c4" not in live and live["c0"] == 1_000 and live["zz"] == 10**7
    # A container that came back and a replayed epoch change nothing in the rest.
    back = spark.createDataFrame([("c1", "h", "registered", 2 * 10**7, 2 * 10**7, 1)], keyed.CHANGES)
    for _ in range(2):
        table(back, 900)
    live["c1"] = 2 * 10**7
    assert {r.container_id: r.since_ms for r in table.read(spark).collect()} == live
    names = {r.container_id for r in spark.read.parquet(f"{tmp_path}/table/snapshots/epoch={max(sizes(tmp_path / 'table', 'snapshots'))}").collect()}
    assert not names & {"c3"}

"""Sketches, span pairs and repeated reports on streams; patterns that begin with a wildcard."""

from __future__ import annotations

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from servelens.operators import access, traces
from servelens.streaming import aggregates, sketches, spans
from test_keyed_streams import feed, few_state_stores, shuffled  # noqa: F401


def test_sketch_rank_error_holds(spark):
    rng = random.Random(3)
    rows = [(i * 60_000, f"m{i % 2}", int(rng.lognormvariate(8, 2))) for i in range(20_000)] + [(0, "m0", None), (0, None, 7)]
    df = spark.createDataFrame(rows, "ts_ms long, model string, latency_us long")
    probs = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    windows = sketches.windowed_sketches(df, "1 day", k=200)
    assert windows.count() > 25
    for r in sketches.merged_quantiles(windows, probs).collect():
        values = sorted(v for _, m, v in rows if m == r.model and v is not None)
        assert r.requests == len(values)
        for name, p in probs.items():
            low, high = (sum(v < r[name] for v in values), sum(v <= r[name] for v in values))
            assert low / len(values) - 0.02 <= p <= high / len(values) + 0.02
    exact = sketches.merged_quantiles(sketches.windowed_sketches(df.limit(5000), "1 day"), probs).where("model = 'm0'").first()
    values = sorted(v for _, m, v in rows[:5000] if m == "m0")
    assert exact.p50 == values[-(-len(values) // 2) - 1]


SPAN = "trace_id string, span_id string, parent_span_id string, kind string, start_us long, end_us long, attrs map<string,string>"


def test_spans_pair_and_unmatched_come_out(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], 10**12
    for i in range(300):
        at += rng.randrange(2_000_000)
        attrs = {"model": f"m{i % 3}", "user": "u", "stream": rng.choice(["true", "false"])}
        rows.append((f"t{i}", "s", None, "SERVER", at, at + 50_000, attrs))
        for c in range(rng.choice([0, 1, 1, 2])):
            begins = at + rng.randrange(9_000)
            rows.append((f"t{i}", f"c{c}", "s", "CLIENT", begins, begins + rng.randrange(30_000), attrs))
    rows.append(("stray", "c", "s", "CLIENT", at, at + 5, {}))
    ends = [("end", "end", "none", kind, 10**15, 10**15, {}) for kind in ("SERVER", "CLIENT")]
    build = lambda s: spans.span_overheads(s, lateness_ms=60_000, call_ms=10_000)
    out = feed(spark, tmp_path, shuffled(rows, 4, 60_000_000) + ends, SPAN, 3, build)
    found = {r.trace_id: (r.client_us, r.overhead_us) for r in out.collect()}
    spent = {}
    for t, _, _, kind, a, b, _ in rows:
        if kind == "CLIENT":
            spent[t] = spent.get(t, 0) + b - a
    servers = [r for r in rows if r[3] == "SERVER"]
    assert found == {t: (spent.get(t), max(50_000 - spent[t], 0) if t in spent else None) for t, *_ in servers}
    want = traces.proxy_overhead(spark.createDataFrame(rows, SPAN))
    have = spans.overhead_quantiles(out)
    assert sorted(map(str, have.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_reports_sent_again_are_billed_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"u{i % 3}", "m", rng.randrange(1, 9), 1, 10**9 + i * 60_000) for i in range(200)]
    sent = [(*r, r[5] + d) for r in rows for d in (0, rng.randrange(600_000))]
    sent = [r[:6] for r in sorted(sent, key=lambda r: r[6])] + [(-1, "end", "m", 1, 1, 10**13)]
    schema = "report_id long, user_name string, model string, prompt_tokens long, completion_tokens long, ts_ms long"
    build = lambda s: aggregates.windowed_chargeback(aggregates.distinct_reports(s, "10 minutes"), "1 hour")
    out = feed(spark, tmp_path, sent, schema, 3, build)
    want = aggregates.windowed_chargeback(spark.createDataFrame(rows, schema), "1 hour")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


GRANT = "principal_type string, principal string, access string, resource_glob string"


def test_wildcard_patterns_equal_plain_matching(spark):
    rng = random.Random(5)
    letters = "ab-x%_"
    globs = ["*", "?*", "*a", "?b", "*-x", "**", "", "a*", "*%_*", "?", "*ab*-x", "*AB"]
    globs += ["".join(rng.choices([*letters, "*", "?"], k=rng.randint(1, 6))) for _ in range(150)]
    names = ["", "a", "ab", "%_"] + ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(80)]
    grants = spark.createDataFrame([("user", f"u{i % 3}", "infer", g) for i, g in enumerate(globs)], GRANT)
    asks = spark.createDataFrame([(f"u:u{k}", n) for k in range(3) for n in names], "__p string, __r string")
    want = {
        (f"u:u{i % 3}", n)
        for i, g in enumerate(globs)
        for n in names
        if fnmatch.fnmatchcase(n, g.lower())
    }
    assert {tuple(r) for r in access.granted(asks, grants, "infer").collect()} == want


def test_many_suffix_patterns_meet_few_names(spark):
    n = 10_000
    grants = spark.range(n).selectExpr(
        "'group' AS principal_type", "'g' AS principal", "'infer' AS access",
        "concat('*-x', lpad(cast(id AS string), 5, '0')) AS resource_glob",
    )
    keys = access.indexed_grants(grants).groupBy("__prefix").count()
    assert keys.agg(F.max("count")).first()[0] <= 300
    names = [f"model-x{i:05d}" for i in range(0, n, 97)] + [f"other-y{i}" for i in range(50)]
    asks = spark.createDataFrame([("g:g", name) for name in names], "__p string, __r string")
    assert {r["__r"] for r in access.granted(asks, grants, "infer").collect()} == {x for x in names if x.startswith("model")}


@pytest.mark.parametrize("name", ["Model-A#lora", "", None])
def test_resource_keys(spark, name):
    keys = spark.createDataFrame([(name,)], "r string").select(access.resource_keys("r").alias("k")).first()[0]
    assert keys is None if name is None else {"", name.lower()} <= set(keys)

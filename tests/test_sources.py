from __future__ import annotations

import json

from pyspark.sql import functions as F

from servelens.operators import metrics
from servelens.sources import policies, sinks, telemetry

LOG = (
    "ts string, level string, logger string, thread string, message string, mdc map<string,string>,"
    " exception string, stack string"
)


def test_service_log_round_trip(spark, tmp_path):
    rows = [
        ("2024-01-01T00:00:00.000Z", "INFO", "l", "t", 'say "hi"\nback\\slash\ttab', {"user": "u", "trace_id": "1"}, None, None),
        ("2024-01-01T00:00:00.001Z", "ERROR", "l", "t", "bell \u0001 é", None, "java.io.IOException", "at a\nat b\n"),
    ]
    logs = spark.createDataFrame(rows, LOG)
    path = str(tmp_path / "log")
    sinks.write_service_log(logs, path)
    text = sorted(r["value"] for r in spark.read.text(path).collect())
    assert "\\u0001" in text[1] and json.loads(text[1])["message"] == "bell \u0001 é"
    assert list(json.loads(text[0])) == ["ts", "level", "logger", "thread", "message", "trace_id", "user"]
    back = telemetry.read_service_log(spark, path).orderBy("ts").collect()
    for row, want in zip(back, rows):
        assert (row["message"], row["mdc"], row["exception"], row["stack"]) == (want[4], want[5] or {}, want[6], want[7])
    broken = telemetry.parse_service_log(spark.createDataFrame([("not json",)], "value string")).first()
    assert broken["raw"] == "not json" and broken["message"] is None


def test_exposition_grammar(spark):
    body = (
        "# HELP x y\n\nplain_total 3\r\nwith_time{a=\"b\"} 1.5e3 1700000000\n"
        'esc{p="a\\\\b\\"c\\nd",q="x}y"} +Inf\nbad{a="b"} oops\nlone\ndup{a="1",a="2"} 1\n'
    )
    df = telemetry.parse_exposition(spark.createDataFrame([(body,)], "body string"))
    out = {r["metric"]: r for r in df.collect()}
    assert set(out) == {"plain_total", "with_time", "esc", "dup"}
    assert (out["plain_total"]["value"], out["plain_total"]["labels"], out["plain_total"]["line_no"]) == (3.0, None, 2)
    assert (out["with_time"]["value"], out["with_time"]["labels"]) == (1500.0, {"a": "b"})
    assert out["esc"]["labels"] == {"p": 'a\\b"c\nd', "q": "x}y"} and out["esc"]["value"] == float("inf")
    assert out["dup"]["labels"] is None
    gpu = 'nv_gpu_power_usage{gpu="0"} 55.1\nnv_gpu_power_usage{gpu="1",uuid="x"} 7\n'
    pages = spark.createDataFrame([(gpu,)], "body string")
    assert telemetry.parse_exposition(pages).count() == 2
    strict = telemetry.parse_exposition(pages, strict=True).collect()
    assert [(r["metric"], r["labels"], r["value"]) for r in strict] == [("nv_gpu_power_usage", {"gpu": "0"}, 55.1)]


def test_exposition_out(spark, tmp_path):
    rows = [(1, 1, "m", 200, 5000), (2, 2, "m", 500, 70_000)]
    df = spark.createDataFrame(rows, "request_id long, ts_ms long, model string, status int, latency_us long")
    parts = sinks.histogram_metrics(metrics.latency_histogram(df)).unionByName(
        sinks.scorecard_metrics(metrics.model_scorecard(df))
    )
    odd = sinks.metric_rows(spark.range(1), sinks.metric("custom", F.lit(1), who=F.lit('a"b\\c')))
    path = str(tmp_path / "metrics")
    sinks.write_exposition(sinks.to_exposition(parts.unionByName(odd), "x_"), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert 'x_inference_latency_seconds_bucket{model="m",le="0.005"} 1' in lines
    assert 'x_inference_latency_seconds_bucket{model="m",le="+Inf"} 2' in lines
    assert 'x_inference_latency_seconds_sum{model="m"} 0.075' in lines
    assert 'x_inference_requests_total{model="m",status="error"} 1' in lines
    assert 'x_model_error_rate{model="m"} 0.5' in lines
    assert "# TYPE x_inference_latency_seconds histogram" in lines
    assert 'x_custom{who="a\\"b\\\\c"} 1' in lines
    back = telemetry.parse_exposition(spark.createDataFrame([("\n".join(lines),)], "body string"))
    assert back.filter("metric = 'x_custom'").first()["labels"] == {"who": 'a"b\\c'}


def test_rules_publish_and_load(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, '{"rules":[{"requestsPerMinute":-4},{"user":"","group":"g","model":"m","requestsPerMinute":2.9}]}'),
         (2, "{"), (3, ""), (4, None)],
        "version int, doc string",
    )
    path = str(tmp_path / "rules")
    policies.publish_rules(docs, path)
    policies.publish_rules(docs.filter("version = 1").withColumn("version", F.lit(9)), path)
    table = spark.read.parquet(path)
    assert {r["version"] for r in table.collect()} == {1, 9}
    out = policies.load_quota_rules(table.filter("version = 1")).orderBy("rule_ord").collect()
    assert [(r["rule_user"], r["rule_group"], r["rule_model"], r["rpm"], r["specificity"]) for r in out] == [
        (None, "g", "m", 2, 3), (None, None, "*", 0, 0)
    ]


def test_inventory_from_files(spark, tmp_path):
    for name, size in {"a/1/m.plan": 10, "a/config": 2, "b/1/m.onnx": 5, "lora.json": 3}.items():
        f = tmp_path / "repo" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * size)
    files = telemetry.list_files(spark, str(tmp_path / "repo"))
    out = {r["model"]: (r["files"], r["bytes"]) for r in telemetry.model_inventory(files, str(tmp_path / "repo")).collect()}
    assert out == {"a": (2, 12), "b": (1, 5)}
    plan = files.select("path", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
    archive = spark.createDataFrame([("hdfs:///r/models.tar.gz", 9, 1)], "path string, length long, modified long")
    row = telemetry.model_files(archive, "hdfs:///r/models.tar.gz").first()
    assert (row["relative"], row["kind"]) == ("models", "archive")


def test_adapters_and_index(spark):
    docs = spark.createDataFrame([(1, '{"m":["a","b"],"n":[]}'), (2, "oops")], "id int, doc string")
    assert {(r["base"], r["adapter"]) for r in telemetry.load_adapters(docs).collect()} == {("m", "a"), ("m", "b")}
    index = spark.createDataFrame([("h", '[{"name":"m","version":"1","state":"READY"}]'), ("g", "bad")], "host string, body string")
    assert {tuple(r) for r in telemetry.loaded_models(index).collect()} == {("h", "m", "1", "READY"), ("g", None, None, None)}


def test_launcher_audit(spark):
    good = dict(
        config_id=1, model_repository="hdfs:///m", secrets_path=None, bind_address="0.0.0.0", http_port=8000,
        grpc_port=8001, metrics_port=8002, admin_port=8888, min_containers=1, max_containers=10,
        scale_up_threshold=0.7, scale_down_threshold=0.2, tls_enabled=False, tls_keystore=None, proxy_enabled=True,
        proxy_port=9000, slice_size="1g.10gb", shadow_rate=0.0, shadow_endpoint=None,
    )
    bad = {**good, "config_id": 2, "model_repository": "m", "max_containers": 0, "scale_up_threshold": 0.0, "proxy_port": 8888,
           "slice_size": "2", "shadow_rate": 0.5, "tls_enabled": True}
    schema = ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}"
        for k, v in good.items()
    )
    df = spark.createDataFrame([tuple(good.values()), tuple(bad.values())], schema)
    out = policies.audit_launcher_configs(df).collect()
    assert {r["violation"] for r in out if r["config_id"] == 2} == {
        "model_repository", "max_containers", "scale_up_threshold", "scale_down_threshold", "tls_keystore",
        "proxy_port_clash", "slice_size", "shadow_endpoint",
    }
    assert not [r for r in out if r["config_id"] == 1]


def test_repeated_names_and_keys(spark):
    doc = '{"metadata":{"name":"d"},"spec":{"env":[{"name":"A","value":"1"},{"name":"B"},{"name":"A","value":"2"}]}}'
    (row,) = policies.read_deployments(spark.createDataFrame([(doc,)], "doc string")).collect()
    assert row["env"] == {"A": "2", "B": None}
    body = '{"model":"a","model":"b"}'
    call = spark.createDataFrame([("POST", body)], "method string, body string")
    (row,) = telemetry.check_requests(call).collect()
    assert row["request_error"] is None and row["model"] == "b"


def test_alert_counters_cover_all_alerts(spark):
    rollup = spark.createDataFrame(
        [("recent", 100, 60, 40), ("all", 250, 150, 100)],
        "scope string, alerts long, container_failures long, scaling_events long",
    )
    values = {r["name"]: r["value"] for r in sinks.alert_metrics(rollup).selectExpr("metric AS name", "value").collect()}
    assert sorted(float(v) for v in values.values()) == [100, 150, 250]

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from servelens.functions import load as L
from servelens.functions import requests as R
from servelens.functions import safety as S


def column(spark, schema, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_split_model_ref(spark):
    refs = ["m", "m#l", "#l", "m#", "a#b#c", "", None]
    out = column(spark, "string", refs, R.split_model_ref)
    assert [(o.base, o.lora) for o in out] == [
        ("m", None), ("m", "l"), ("#l", None), ("m#", None), ("a", "b#c"), ("", None), (None, None)
    ]


def test_identity_precedence(spark):
    headers = [
        {"X-Forwarded-User": "a", "X-Auth-User": "b"},
        {"x-auth-user": "b"},
        {"X-FORWARDED-USER": "", "X-Auth-User": "b"},
        {},
    ]
    out = column(spark, "map<string,string>", headers, lambda h: R.resolve_user(h, F.lit("svc")))
    assert out == ["a", "b", "svc", "svc"]
    none = F.lit(None).cast("string")
    assert column(spark, "map<string,string>", [{}], lambda h: R.resolve_user(h, none)) == ["anonymous"]


def test_client_ip(spark):
    name = "X-Forwarded-For"
    headers = [
        {name: "203.0.113.7, 10.0.0.1"}, {name: " 203.0.113.9 "}, {name: ""}, {}, {name: ",x"},
        {name: " , 10.0.0.1"},
    ]
    out = column(spark, "map<string,string>", headers, lambda h: R.resolve_client_ip(h, F.lit("peer")))
    assert out == ["203.0.113.7", "203.0.113.9", "peer", "peer", ",x", "unknown"]


def test_endpoints(spark):
    paths = ["/v1/models", "/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/usage", "/x"]
    out = column(spark, "string", paths, R.classify_endpoint)
    assert out == ["models", "inference", "inference", "inference", "usage", "not_found"]


def test_retry_after_rounds_up_to_one_second(spark):
    assert column(spark, "long", [1, 1000, 1001, 60000, 0], R.retry_after_sec) == [1, 1, 2, 60, 1]


def test_refused_hosts(spark):
    bad = [
        "127.0.0.1", "localhost", "169.254.169.254", "0.0.0.0", "", None, "host;rm",
        "host with spaces", "a..b", "-a", "224.0.0.1", "239.1.1.1", "127.1", "2130706433", "256.1.1.1",
        "1.2.3.4.5", "0", "LOCALHOST", "a" * 64, "x" * 254,
    ]
    assert column(spark, "string", bad, S.safe_host) == [False] * len(bad)


def test_accepted_hosts(spark):
    good = ["node-1.cluster", "10.0.0.5", "8.8.8.8", "a", "240.0.0.1", "host1"]
    assert column(spark, "string", good, S.safe_host) == [True] * len(good)


def test_paths(spark):
    good = ["hdfs:///user/models", "hdfs://namenode:8020/user/models", "/mnt/hdfs/models", "/models",
            "hdfs:///a/b/c-d_e.ext", "", None]
    bad = [
        "hdfs:///a ; rm -rf /", "hdfs:///a`x`", "hdfs:///a$(x)", "hdfs:///a|nc", "hdfs:///a && x",
        "hdfs:///a\nrm", "hdfs:///a'", 'hdfs:///a"', "hdfs:///a\\b", "hdfs:///a<r", "hdfs:///a>r",
        "hdfs:///a?g", "hdfs:///a*g", "relative/path", "../escape", "s3://b/m",
    ]
    assert all(column(spark, "string", good, S.safe_path))
    assert not any(column(spark, "string", bad, S.safe_path))
    assert column(spark, "string", ["0.0.0.0", "::1", "0.0.0.0; x", "a b"], S.safe_bind_address) == [
        True, True, False, False
    ]
    kinds = column(spark, "string", ["hdfs:///m", "/mnt/m", "s3://m"], S.repository_kind)
    assert kinds == ["./models", "/mnt/m", "/models"]


def test_redaction(spark):
    env = {"PUBLIC_VAR": "v", "API_KEY": "s", "dbPassword": "s", "My_Token_X": "s", "OAUTH": "s"}
    shown = column(spark, "map<string,string>", [env], S.redact)[0]
    assert shown == {k: ("v" if k == "PUBLIC_VAR" else "***REDACTED***") for k in env}


def test_query_strings(spark):
    queries = ["a=1&b=2&a=3", "=x&y=&z", "q=a%20b&r=%zz&s=a+b&t=1=2", None, "a=" + "x" * 4100]
    out = column(spark, "string", queries, S.parse_query)
    assert out == [
        {"b": "2", "a": "3"}, {}, {"q": "a b", "r": "%zz", "s": "a b", "t": "1=2"}, {}, {}
    ]


@pytest.mark.parametrize(
    ("args", "mode", "expected"),
    [
        ((1.0, 200, 2, 16), "GPU_UTIL", 1.0),
        ((1.0, 8, 2, 16), "QUEUE_DEPTH", 0.25),
        ((0.3, 24, 2, 16), "COMPOSITE", 0.75),
        ((0.0, 1000, 2, 16), "QUEUE_DEPTH", 1.0),
        ((0.0, 5, 0, 16), "QUEUE_DEPTH", 1.0),
        ((0.0, 0, 0, 16), "QUEUE_DEPTH", 0.0),
        ((float("nan"), 0, 1, 0), "GPU_UTIL", 0.0),
        ((1.7, -4, 1, 16), "anything", 1.0),
    ],
)
def test_normalised_load(spark, args, mode, expected):
    expr = L.normalised_load(*[F.lit(a) for a in args], F.lit(mode))
    assert spark.range(1).select(expr).first()[0] == pytest.approx(expected, abs=1e-9)


def test_categories(spark):
    modes = ["gpu-util", "Queue_Depth", "", None, "x"]
    assert column(spark, "string", modes, L.scaling_mode) == [
        "GPU_UTIL", "QUEUE_DEPTH", "COMPOSITE", "COMPOSITE", "COMPOSITE"
    ]
    kinds = ["amd_gpu", "cpu_only", "intel_gaudi", "aws_neuron", "nvidia_gpu", None, "zzz"]
    assert column(spark, "string", kinds, L.kubernetes_resource) == [
        "amd.com/gpu", None, "habana.ai/gaudi", "aws.amazon.com/neuron", "nvidia.com/gpu",
        "nvidia.com/gpu", "nvidia.com/gpu",
    ]
    assert column(spark, "string", kinds[:1] + kinds[4:5], L.yarn_resource) == ["amd.com/gpu", "yarn.io/gpu"]


def test_safe_key_and_sampling(spark):
    assert column(spark, "string", ["a|b", None], R.safe_key) == ["a_b", "unknown"]
    ids = spark.range(10_000)
    kept = ids.filter(R.sample_fraction("id", 0.25, "http://s")).count()
    assert 2200 < kept < 2800
    assert ids.filter(R.sample_fraction("id", 0.25, None)).count() == 0
    assert ids.filter(R.sample_fraction("id", 0.0, "http://s")).count() == 0
    assert ids.filter(R.sample_fraction("id", 1.0, "http://s")).count() == 10_000

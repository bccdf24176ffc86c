"""Serving tables projected from the generic input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Constant policy inputs of the example queries.
RULES_DOC = (
    '{"rules":[{"user":"user-1","model":"model-0","requestsPerMinute":2},'
    '{"group":"team-1","requestsPerMinute":5},'
    '{"user":"user-2","requestsPerMinute":0},'
    '{"requestsPerMinute":40}]}'
)
GRANTS = [
    *[("group", f"team-{i}", "infer", "model-*") for i in range(4)],
    ("group", "team-4", "infer", "model-0"),
    ("group", "team-0", "infer", "model-*#lora-0"),
    ("user", "*", "list", "model-*"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a zone-less timestamp, whatever the session time zone is."""
    name = ts if isinstance(ts, str) else "ts"
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.floor(micros / F.lit(1000)).cast("bigint")


def k_of(props: str = "props") -> Column:
    return F.regexp_extract(props, "[0-9]+", 0).cast("int")


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    """One request per event; works on tables and streams."""
    e = events.withColumn("k", k_of())
    k, user, kind = F.col("k"), F.col("user_id"), F.col("event_type")
    adapter = k % 3 == 0
    path = (
        F.when(kind == "view", "/v1/models")
        .when(kind == "signup", "/v1/embeddings")
        .when(kind == "purchase", "/v1/completions")
        .otherwise("/v1/chat/completions")
    )
    base = text("model-", k % 4)
    return e.select(
        F.col("event_id").alias("request_id"),
        "ts",
        epoch_ms("ts").alias("ts_ms"),
        text("user-", user).alias("user_name"),
        text("team-", user % 5).alias("team"),
        F.array(text("team-", user % 5)).alias("groups"),
        base.alias("base_model"),
        F.when(adapter, text("lora-", k % 2)).alias("lora"),
        F.when(adapter, text("model-", k % 4, "#lora-", k % 2)).otherwise(base).alias(
            "requested_model"
        ),
        path.alias("path"),
        F.when(kind == "error", 500).otherwise(200).alias("status"),
        F.round(F.col("value") * 1000).cast("bigint").alias("latency_us"),
        (k % 10 == 0).alias("stream"),
        text("container_", user % 6).alias("container_id"),
        text("host-", user % 6).alias("host"),
        k.cast("bigint").alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("completion_tokens"),
    )


def forwarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forwarded_from(requests(spark, sf_dir))


def forwarded_from(calls: DataFrame) -> DataFrame:
    """Inference calls, keyed by the model they were served by."""
    return calls.filter(F.col("path") != "/v1/models").withColumn("model", F.col("base_model"))


def with_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["request_id", "ts_ms", "model", "status", "latency_us"]
    primary = forwarded(spark, sf_dir)
    mirrored = primary.filter(F.col("prompt_tokens") % 10 == 9).withColumns(
        {
            "model": text("shadow:", F.col("base_model")),
            "latency_us": F.col("latency_us") + 1000 * (F.col("prompt_tokens") % 7),
        }
    )
    return primary.select(*columns).unionByName(mirrored.select(*columns))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they arrive: method, headers, peer, JSON body, JSON response.

    A few are malformed on purpose, by token count: GET calls, broken bodies, missing models.
    """
    return raw_requests_from(requests(spark, sf_dir))


def raw_requests_from(r: DataFrame) -> DataFrame:
    k = F.col("prompt_tokens")
    model = (
        F.when(k % 50 == 1, F.lit('""'))
        .when(k % 50 == 2, F.lit("17"))
        .otherwise(text('"', F.col("requested_model"), '"'))
    )
    stream = F.when(F.col("stream"), "true").when(k % 10 == 3, '"true"').otherwise("false")
    body = F.when(k % 50 == 3, '{"model": ').otherwise(
        text('{"model":', model, ',"stream":', stream, "}")
    )
    response = text(
        '{"usage":{"prompt_tokens":', k, ',"completion_tokens":', F.col("completion_tokens"), "}}"
    )
    headers = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(
                    F.lit("X-Forwarded-User").alias("key"),
                    F.when(k % 7 != 0, F.col("user_name")).alias("value"),
                ),
                F.struct(F.lit("x-auth-user").alias("key"), F.col("user_name").alias("value")),
                F.struct(
                    F.lit("X-FORWARDED-FOR").alias("key"),
                    F.when(k % 3 == 0, text(" 203.0.113.", k, " , 10.0.0.1"))
                    .when(k % 3 == 1, text("198.51.100.", k))
                    .alias("value"),
                ),
            ),
            lambda h: h["value"].isNotNull(),
        )
    )
    return r.select(
        "request_id",
        "ts_ms",
        F.when(k % 50 == 4, "GET").otherwise("POST").alias("method"),
        "path",
        headers.alias("headers"),
        text("192.0.2.", k).alias("peer_ip"),
        body.alias("body"),
        F.when(~F.col("stream"), response).alias("response_body"),
        "groups",
        "status",
        "latency_us",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_from(requests(spark, sf_dir))


def usage_from(calls: DataFrame) -> DataFrame:
    """Response usage of buffered calls (by base model) and out-of-band reports of streamed ones
    (by model as sent); a call is one or the other, so one pass serves both."""
    reported = F.col("stream")
    return (
        forwarded_from(calls)
        .filter(reported | (F.col("status") == 200))
        .select(
            "user_name",
            F.when(reported, F.col("requested_model")).otherwise(F.col("base_model")).alias("model"),
            "prompt_tokens",
            "completion_tokens",
            "ts_ms",
            F.when(reported, "report").otherwise("response").alias("source"),
        )
    )


def chat_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per conversation: system and user turns prompt, assistant turns complete."""
    words = F.size(F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w != "")).cast("bigint")
    prompt = F.col("role").isin("system", "user")
    return table(spark, sf_dir, "conversations").select(
        text("user-", F.col("conv_id") % 20).alias("user_name"),
        text("model-", F.col("conv_id") % 4).alias("model"),
        F.when(prompt, words).otherwise(0).alias("prompt_tokens"),
        F.when(prompt, 0).otherwise(words).alias("completion_tokens"),
    )


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select(
        "container_id", "host", "ts", "ts_ms", F.col("request_id").alias("event_id"),
        (F.col("prompt_tokens") % 20).cast("int").alias("depth"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running containers in list order; containers of one deployment share its number."""
    return (
        table(spark, sf_dir, "events")
        .select((F.col("user_id") % 6).cast("int").alias("ord"))
        .distinct()
        .select(
            text("container_", F.col("ord")).alias("container_id"),
            text("host-", F.col("ord")).alias("host"),
            "ord",
            text("dep-", F.col("ord") % 2).alias("deployment"),
        )
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes_from(requests(spark, sf_dir))


def probes_from(calls: DataFrame) -> DataFrame:
    return calls.select(
        "host", "ts", "ts_ms", F.col("request_id").alias("event_id"),
        (F.col("status") == 200).alias("ready"),
    )


def rules_docs(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(RULES_DOC).alias("doc"))


def grants(spark: SparkSession) -> DataFrame:
    names = ("principal_type", "principal", "access", "resource_glob")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, g)]) for g in GRANTS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric page per event: two GPUs, pending counts per model, some odd lines.

    By token count: pages without GPU lines, empty pages, and pages with a corrupt line.
    """
    r = requests(spark, sf_dir)
    k = F.col("prompt_tokens")
    gpu = text(
        "# HELP nv_gpu_utilization GPU utilization rate\n# TYPE nv_gpu_utilization gauge\n",
        'nv_gpu_utilization{gpu="0",gpu_uuid="GPU-', F.col("host"), '-a"} ', k, ".5\n",
        'nv_gpu_utilization{gpu="1",gpu_uuid="GPU-', F.col("host"), '-b"} ',
        F.col("request_id") % 100, "\n",
        'nv_gpu_memory_used_bytes{gpu="0"} ', F.col("completion_tokens") * 1000, "\n",
    )
    pending = text(
        'nv_inference_pending_request_count{model="', F.col("base_model"), '",version="1"} ',
        k % 20, ".7\n",
        'nv_inference_pending_request_count{model="other",version="1"} 1\n',
    )
    corrupt = text('nv_inference_pending_request_count{model="bad"} 1.2.3\n')
    done = text('nv_inference_request_success{model="', F.col("base_model"), '"} ',
                F.col("request_id"), "\n")
    body = (
        F.when(k % 10 == 8, "")
        .when(k % 10 == 7, F.concat(done, pending))
        .when(k % 10 == 6, F.concat(gpu, corrupt, pending, done))
        .otherwise(F.concat(gpu, pending, done))
    )
    return r.select(
        F.col("request_id").alias("scrape_id"), "ts_ms", "host", "container_id",
        text("dep-", F.regexp_extract("container_id", "[0-9]+", 0).cast("int") % 2).alias(
            "deployment"
        ),
        body.alias("body"),
    )


def container_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_events_from(table(spark, sf_dir, "events"))


def container_events_from(events: DataFrame) -> DataFrame:
    """Lifecycle rows: each event type plays one lifecycle role; works on tables and streams."""
    e = events.withColumn("k", k_of())
    kind, k = F.col("event_type"), F.col("k")
    role = (
        F.when(kind == "signup", "start")
        .when(kind == "click", "ready")
        .when(kind == "view", "registered")
        .when(kind == "purchase", F.when(k % 4 == 0, "stopped").otherwise("drain"))
        .otherwise(F.when(k % 2 == 0, "completed").otherwise("start_error"))
    )
    return e.select(
        "event_id",
        epoch_ms("ts").alias("ts_ms"),
        text("container_", F.col("user_id")).alias("container_id"),
        text("host-", F.col("user_id") % 6).alias("host"),
        role.alias("event"),
        F.when(role == "completed", k % 3).alias("exit_status"),
        F.when(k % 5 != 0, text("detail ", k)).alias("detail"),
        (F.col("event_id") / 2).cast("bigint").alias("start_id"),
    )


def deployment_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deployment document per order, with zero to four traffic variants.

    Optional fields are present or absent by remainders of the order key.
    """
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    when = lambda c, v: F.when(c, v)
    variant = lambda i: F.struct(
        text("v", i).alias("name"),
        when((n + i) % 11 != 0, (n * (i + 3)) % 7).cast("int").alias("weight"),
        when((n + i) % 3 == 0, text("image:", i)).alias("image"),
        when((n + i) % 5 == 0, F.when((n + i) % 2 == 0, "").otherwise(text("s3://v/", i))).alias(
            "modelRepository"
        ),
    )
    kinds = F.array(*[F.lit(x) for x in
                      ("nvidia_gpu", "amd_gpu", "intel_gaudi", "aws_neuron", "cpu_only", "tpu")])
    doc = F.struct(
        F.struct(text("dep-", n).alias("name")).alias("metadata"),
        F.struct(
            when(n % 17 != 0, text("img:", F.col("o_orderpriority"))).alias("image"),
            when(n % 19 != 0, text("hdfs:///m/", F.col("o_custkey"))).alias("modelRepository"),
            when(n % 4 != 0, (n % 13)).cast("int").alias("replicas"),
            when(n % 3 == 1, (n % 4)).cast("int").alias("tensorParallelism"),
            when(n % 5 == 2, F.lit(2)).alias("pipelineParallelism"),
            when(
                n % 2 == 0,
                F.struct(
                    F.get(kinds, (n % 6).cast("int")).alias("type"),
                    when(n % 8 == 0, (n % 3)).cast("int").alias("count"),
                ),
            ).alias("accelerator"),
            when(
                n % 6 == 0,
                F.struct(
                    when(n % 12 == 0, F.lit("bogus")).alias("mode"),
                    (n % 5 - 1).cast("int").alias("minReplicas"),
                ),
            ).alias("scaling"),
            F.when(
                n % 5 != 0,
                F.transform(F.sequence(F.lit(1), (n % 5).cast("int")), variant),
            ).alias("traffic"),
        ).alias("spec"),
    )
    return o.select("o_orderkey", F.to_json(doc).alias("doc"))


def rule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota document per order: up to three rules with fields left out by remainder."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    doc = text(
        '{"rules":[{"requestsPerMinute":', n % 40 - 3, '},{"group":"team-', n % 5,
        '","model":"', F.when(n % 2 == 0, "*").otherwise(text("model-", n % 4)),
        '","requestsPerMinute":"', n % 7, '"},{"user":"',
        F.when(n % 3 == 0, "").otherwise(text("user-", F.col("o_custkey"))),
        '","group":null,"model":"model-1"}]}',
    )
    return o.select(
        "o_orderkey",
        F.when(n % 10 == 7, '{"rules": [').when(n % 10 == 8, "").otherwise(doc).alias("doc"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server span and its upstream client span per inference call."""
    f = forwarded(spark, sf_dir)
    start = F.col("ts_ms") * 1000
    attrs = F.create_map(
        F.lit("user"), F.col("user_name"), F.lit("model"), F.col("base_model"),
        F.lit("stream"), F.col("stream").cast("string"),
    )
    sides = F.array(
        F.struct(
            F.lit("SERVER").alias("kind"), F.lit("s").alias("span_id"),
            F.lit(None).cast("string").alias("parent_span_id"),
            text("POST ", F.col("path")).alias("name"),
            start.alias("start_us"), (start + F.col("latency_us")).alias("end_us"),
        ),
        F.struct(
            F.lit("CLIENT").alias("kind"), F.lit("c").alias("span_id"),
            F.lit("s").alias("parent_span_id"), F.lit("upstream").alias("name"),
            (start + F.col("prompt_tokens")).alias("start_us"),
            (start + F.col("latency_us") - F.col("completion_tokens")).alias("end_us"),
        ),
    )
    return f.select(
        text("trace-", F.col("request_id")).alias("trace_id"), attrs.alias("attrs"),
        F.explode(sides).alias("s"),
    ).select("trace_id", "attrs", "s.*")


def service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per document, with the whole text as its message."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    mdc = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("user").alias("key"), text("user-", n % 7).alias("value")),
                F.struct(F.lit("trace_id").alias("key"), text("trace-", n).alias("value")),
                F.struct(F.lit("span_id").alias("key"),
                         F.when(n % 4 != 0, F.lit("s")).alias("value")),
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    level = F.when(n % 5 == 0, "WARN").when(n % 5 == 1, "ERROR").otherwise("INFO")
    return d.select(
        "doc_id",
        F.lit("2024-01-01T00:00:00.000Z").alias("ts"),
        level.alias("level"),
        F.col("source").alias("logger"),
        F.lit("main").alias("thread"),
        F.col("text").alias("message"),
        mdc.alias("mdc"),
        F.when(n % 5 == 1, F.lit("java.io.IOException")).alias("exception"),
        F.when(n % 5 == 1, text("at line ", n, "\n\tat \"x\"\\y\n")).alias("stack"),
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    no_fragment = F.substring_index("url", "#", 1)
    rest = F.substring_index(no_fragment, "://", -1)
    return p.select(
        "page_id",
        "url",
        F.substring_index(F.substring_index(rest, "/", 1), "?", 1).alias("host"),
        F.when(F.contains(no_fragment, F.lit("?")), F.substring_index(no_fragment, "?", -1)).alias(
            "query"
        ),
    )

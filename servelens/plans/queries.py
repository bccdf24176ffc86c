"""Example queries over the input tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servelens.functions import load as L
from servelens.functions import requests as R
from servelens.functions import safety as S
from servelens.operators import access, deployments, fleet, metrics, quota, routing
from servelens.operators import scoring, state, tokens, traces
from servelens.plans import adjudication
from servelens.plans import views as V
from servelens.session import shared_dir, stage
from servelens.sources import inventory, policies, scrape_log, sinks, telemetry
from servelens.streaming import adjudication as one_stream
from servelens.streaming import aggregates, keyed, limiter, sketches, spans, stateful
from servelens.streaming.roster import RosterTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- columns -----------------------------------------------------------------------------------


@query
def split_model_ref(spark, sf):
    k, base = F.col("prompt_tokens"), F.col("base_model")
    ref = (
        F.when(k % 7 == 0, V.text("#", base))
        .when(k % 7 == 1, V.text(base, "#"))
        .when(k % 7 == 2, V.text(base, "#a#b"))
        .otherwise(F.col("requested_model"))
    )
    r = V.requests(spark, sf).withColumn("ref", R.split_model_ref(ref))
    return r.select("request_id", F.col("ref.base").alias("base"), F.col("ref.lora").alias("lora"))


@query
def resolve_identity(spark, sf):
    raw = V.raw_requests(spark, sf)
    return raw.select(
        "request_id",
        R.resolve_user("headers", F.lit("service")).alias("user_name"),
        R.resolve_direct_user("headers", F.lit(None).cast("string"), "X-Missing").alias("direct_user"),
        R.resolve_client_ip("headers", "peer_ip").alias("client_ip"),
    )


@query
def classify_endpoint(spark, sf):
    r = V.requests(spark, sf)
    k = F.col("prompt_tokens")
    path = (
        F.when(k % 11 == 0, "/v1/usage")
        .when(k % 11 == 1, V.text("/x/", F.col("path"), "/more"))
        .otherwise(F.col("path"))
    )
    return r.select("request_id", R.classify_endpoint(path).alias("endpoint"))


@query
def validate_request(spark, sf):
    checked = telemetry.check_requests(V.raw_requests(spark, sf))
    return checked.select("request_id", "request_status", "request_error", "model", "stream")


@query
def validate_usage_report(spark, sf):
    r = V.requests(spark, sf)
    k = F.col("prompt_tokens")
    body = (
        F.when(k % 20 == 0, "")
        .when(k % 20 == 1, "{nope")
        .when(k % 20 == 2, V.text('{"prompt_tokens":', k, "}"))
        .when(k % 20 == 3, V.text('{"model":"m","prompt_tokens":-', k, "}"))
        .when(k % 20 == 4, V.text('{"model":"m","completion_tokens":"', k, '"}'))
        .when(k % 20 == 5, V.text('{"model":"m","prompt_tokens":', k, ".9}"))
        .otherwise(
            V.text('{"model":"', F.col("requested_model"), '","prompt_tokens":', k,
                   ',"completion_tokens":', F.col("completion_tokens"), "}")
        )
    )
    method = F.when(k % 20 == 6, "GET").otherwise("post")
    reports = r.select("request_id", method.alias("method"), body.alias("body"))
    return telemetry.check_usage_reports(reports).drop("method", "body")


@query
def redact_env(spark, sf):
    e = V.table(spark, sf, "events")
    env = F.create_map(
        F.lit("PUBLIC_VAR"), F.col("event_type"),
        F.lit("dbPassword"), F.col("event_type"),
        V.text("API_", F.col("user_id"), "_Token"), F.col("event_type"),
        V.text("NAME_", F.col("user_id")), F.col("event_type"),
    )
    return e.select("event_id", F.explode(S.redact(env)).alias("name", "shown"))


@query
def parse_query_string(spark, sf):
    p = V.page_urls(spark, sf)
    tail = V.text("&ref=z%20", F.col("page_id"), "&=bad&bad=&raw=%zz&plus=a+b")
    q = S.parse_query(F.concat(F.coalesce("query", F.lit("")), tail))
    return p.withColumn("q", q).select(
        "page_id",
        F.size("q").cast("bigint").alias("params"),
        *[F.col("q")[n].alias(n) for n in ("page", "ref", "utm_source", "raw", "plus", "bad")],
    )


@query
def safe_host(spark, sf):
    p = V.page_urls(spark, sf)
    n = F.col("page_id")
    hosts = F.array(
        F.col("host"),
        V.text(n % 256, ".", (n * 7) % 256, ".", (n * 3) % 300, ".1"),
        V.text("127.", n % 10, ".0.1"),
        V.text("169.254.", n % 256, ".1"),
        V.text(n % 300, ".1"),
        V.text("a..", F.col("host")),
        V.text("-", F.col("host")),
        V.text(F.col("host"), ";rm"),
        F.when(n % 3 == 0, "localhost").when(n % 3 == 1, ""),
    )
    return p.select("page_id", F.posexplode(hosts).alias("pos", "candidate")).select(
        "page_id", "pos", "candidate", S.safe_host("candidate").alias("safe")
    )


@query
def safe_path(spark, sf):
    p = V.page_urls(spark, sf)
    n = F.col("page_id")
    tail = F.substring_index("url", "://", -1)
    path = (
        F.when(n % 6 == 0, V.text("hdfs:///", tail))
        .when(n % 6 == 1, V.text("/", tail))
        .when(n % 6 == 2, tail)
        .when(n % 6 == 3, V.text("/", tail, "; rm"))
        .when(n % 6 == 4, V.text("/a\n", n))
    )
    address = V.text("10.0.0.", n, F.when(n % 2 == 0, " ").otherwise(""))
    return p.select(
        "page_id",
        S.safe_path(path).alias("safe"),
        S.safe_bind_address(address).alias("bind_ok"),
        S.repository_kind(F.coalesce(path, F.lit(""))).alias("repository"),
    )


@query
def audit_launcher_configs(spark, sf):
    p = V.table(spark, sf, "part")
    n = F.col("p_partkey")
    slices = F.array(*[F.lit(x) for x in ("1g.10gb", "0.5", ".25", "1.0", "2.0", "1g10gb", "")])
    configs = p.select(
        n.alias("config_id"),
        F.when(n % 9 == 0, "models").otherwise(V.text("hdfs:///m/", n)).alias("model_repository"),
        F.when(n % 10 == 1, "/s;x").alias("secrets_path"),
        F.when(n % 8 == 0, "0.0.0.0 x").otherwise("0.0.0.0").alias("bind_address"),
        (n % 70000).cast("int").alias("http_port"),
        F.lit(8001).alias("grpc_port"),
        (n % 11 - 1).cast("int").alias("metrics_port"),
        (F.lit(9000) + n % 3).cast("int").alias("admin_port"),
        (n % 5 - 1).cast("int").alias("min_containers"),
        (n % 7).cast("int").alias("max_containers"),
        ((n % 13) / 10.0).alias("scale_up_threshold"),
        ((n % 9) / 10.0 - 0.1).alias("scale_down_threshold"),
        (n % 4 == 0).alias("tls_enabled"),
        F.when(n % 8 == 0, "/ks").alias("tls_keystore"),
        (n % 2 == 0).alias("proxy_enabled"),
        F.when(n % 14 == 0, 0).otherwise(F.lit(9001)).cast("int").alias("proxy_port"),
        F.get(slices, (n % 7).cast("int")).alias("slice_size"),
        ((n % 12) / 10.0 - 0.05).alias("shadow_rate"),
        F.when(n % 3 == 0, "http://shadow").alias("shadow_endpoint"),
    )
    return policies.audit_launcher_configs(configs)


@query
def audit_deployments(spark, sf):
    return policies.audit_deployments(policies.read_deployments(V.deployment_docs(spark, sf)))


@query
def normalise_category(spark, sf):
    o = V.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("gpu-util", "Queue_Depth", "composite", "x", "")])
    accel = F.array(*[F.lit(x) for x in ("amd-gpu", "CPU_only", "aws_neuron", "?", "intel-gaudi")])
    return o.select(
        n,
        L.scaling_mode(F.get(kinds, (n % 6).cast("int"))).alias("mode"),
        L.accelerator_type(F.get(accel, (n % 7).cast("int"))).alias("accelerator"),
        L.yarn_resource(F.get(accel, (n % 7).cast("int"))).alias("resource"),
    )


@query
def normalised_load(spark, sf):
    e = V.table(spark, sf, "events").withColumn("k", V.k_of())
    args = (
        F.when(F.col("k") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 250 - 0.1),
        F.col("k") - 10, (F.col("user_id") % 4).cast("int"), F.col("k") % 3 * 8,
    )
    modes = {"gpu": "GPU_UTIL", "queue": "QUEUE_DEPTH", "composite": "COMPOSITE"}
    return e.select(
        "event_id",
        *[L.normalised_load(*args, F.lit(m)).alias(f"{n}_load") for n, m in modes.items()],
    )


@query
def retry_after(spark, sf):
    r = V.requests(spark, sf)
    return r.select("request_id", R.retry_after_sec(F.col("latency_us") - 1000).alias("seconds"))


@query
def safe_counter_key(spark, sf):
    r = V.requests(spark, sf)
    user = F.when(F.col("prompt_tokens") % 5 != 0, V.text(F.col("team"), "|", F.col("user_name")))
    return r.groupBy(R.safe_key(user).alias("user_name"), R.safe_key("lora").alias("model")).agg(
        F.count(F.lit(1)).alias("requests")
    )


@query
def sample_requests(spark, sf):
    r = V.requests(spark, sf)
    return r.filter(R.sample_fraction("request_id", 0.25, "http://shadow")).select("request_id")


# --- joins -------------------------------------------------------------------------------------


@query
def evaluate_access(spark, sf):
    out = access.evaluate_access(V.requests(spark, sf), V.grants(spark))
    return out.select("request_id", "base_allowed", "allowed")


def customer_grants(spark, sf):
    """One grant per customer: to a user or a team, exact or with wildcards."""
    c = V.table(spark, sf, "customer")
    n = F.col("c_custkey")
    glob = (
        F.when(n % 6 == 0, V.text("model-", n % 4))
        .when(n % 6 == 1, V.text("MODEL-", n % 4, "#*"))
        .when(n % 6 == 2, V.text("model-?#lora-", n % 2))
        .when(n % 6 == 3, V.text("*-", n % 4))
        .when(n % 6 == 4, V.text("mod%l-", n % 4))
        .otherwise(V.text("model-", n % 4, "#lora-", n % 2))
    )
    return c.select(
        F.when(n % 40 == 0, "group").otherwise("user").alias("principal_type"),
        F.when(n % 40 == 0, V.text("team-", n % 5))
        .otherwise(V.text("user-", n))
        .alias("principal"),
        F.when(n % 5 == 4, "list").otherwise("infer").alias("access"),
        glob.alias("resource_glob"),
    )


@query
def evaluate_access_large_policy(spark, sf):
    out = access.evaluate_access(V.requests(spark, sf), customer_grants(spark, sf))
    return out.select("request_id", "base_allowed", "allowed")


@query
def visible_catalog(spark, sf):
    users = V.requests(spark, sf).select("user_name", "groups").distinct()
    p = V.table(spark, sf, "part")
    n = F.col("p_partkey")
    names = p.select(V.text("model-", n).alias("model"))
    adapters = p.select(V.text("model-", n).alias("base"), V.text("lora-", n % 2).alias("adapter"))
    loaded = p.filter(n % 2 == 0).select(V.text("model-", n).alias("name"))
    c = V.table(spark, sf, "customer")
    m = F.col("c_custkey")
    kinds = F.array(F.lit("list"), F.lit("metadata"))
    grants = c.select(
        F.when(m % 50 == 0, "group").otherwise("user").alias("principal_type"),
        F.when(m % 50 == 0, V.text("team-", m % 5)).otherwise(V.text("user-", m)).alias("principal"),
        F.explode(kinds).alias("access"),
        F.when(m % 3 == 0, V.text("model-", m, "*")).otherwise(V.text("model-", m)).alias(
            "resource_glob"
        ),
    )
    return access.visible_catalog(users, names, adapters, loaded, grants)


@query
def match_quota_rule(spark, sf):
    rules = policies.load_quota_rules(V.rules_docs(spark))
    out = quota.match_quota_rule(V.requests(spark, sf), rules)
    return out.select("request_id", "rule_user", "rule_group", "rule_model", "rpm", "bucket")


def customer_rules(spark, sf):
    """One rule document with a rule per customer, as parsed rows."""
    c = V.table(spark, sf, "customer")
    n = F.col("c_custkey")
    shape = n % 8
    parsed = c.select(
        F.when(shape.bitwiseAND(4) > 0, V.text("user-", n)).alias("rule_user"),
        F.when(shape.bitwiseAND(2) > 0, V.text("team-", n % 5)).alias("rule_group"),
        F.when(shape.bitwiseAND(1) > 0, V.text("model-", n % 4)).otherwise("*").alias("rule_model"),
        (n % 9).cast("int").alias("rpm"),
        (shape * -1_000_000_000 + n).alias("rule_ord"),
    )
    return parsed


@query
def match_quota_rule_large_policy(spark, sf):
    out = quota.match_quota_rule(V.requests(spark, sf), customer_rules(spark, sf))
    return out.select("request_id", "rule_user", "rule_group", "rule_model", "rpm", "bucket")


@query
def rules_asof(spark, sf):
    """A rule version per nation, each in force from its own day."""
    n = F.col("n_nationkey")
    docs = V.table(spark, sf, "nation").select(
        n.cast("int").alias("version"),
        (F.lit(1_704_067_200_000) + n * DAY_MS + n * 1000).alias("valid_from_ms"),
        F.when(n % 4 == 1, '{"rules": [')
        .when(n % 4 == 2, "")
        .otherwise(V.text('{"rules":[{"requestsPerMinute":', n + 1, "}]}"))
        .alias("doc"),
    )
    versions = policies.valid_versions(docs, fallback='{"rules":[]}')
    asof = quota.rules_asof(V.requests(spark, sf), versions)
    return asof.select("request_id", "version")


@query
def rules_asof_many_versions(spark, sf):
    """A rule version per order, moved so that the first is in force when requests begin."""
    r = V.requests(spark, sf)
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("version"), at.alias("at"))
    shift = r.agg(F.min("ts_ms")).scalar() - orders.agg(F.min("at")).scalar()
    versions = orders.select("version", (F.col("at") + shift).alias("valid_from_ms"))
    return quota.rules_asof(r, versions).select("request_id", "version")


def _rule_versions(spark, sf):
    """A rule document per order, in force from its own moment on; some broken, some empty."""
    n = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        n.alias("version"),
        (F.lit(1_704_067_200_000) + n * 1000).alias("valid_from_ms"),
        F.when(n % 4 == 1, '{"rules": [').when(n % 4 == 2, "").otherwise('{"rules":[]}').alias("doc"),
    )


@query
def reload_alerts(spark, sf):
    """Alerts for the valid documents of the orders that took effect after the first hundred seconds."""
    seen = 1_704_067_200_000 + 100_000
    alerts = limiter.reload_alerts(policies.valid_versions(_rule_versions(spark, sf)), seen_until_ms=seen)
    return alerts.select("ts_ms", "alert_type", "message", "severity")


def _control_events(spark, sf):
    """Registry and authorization rows: each event plays a role by its number."""
    n, k = F.col("event_id"), V.k_of()
    kinds = ("ranger_degraded", "zk_init_failed", "zk_connection_lost", "zk_reconnected", "quota_reloaded", "probe")
    return V.table(spark, sf, "events").select(
        "event_id",
        V.epoch_ms("ts").alias("ts_ms"),
        F.get(F.array(*[F.lit(x) for x in kinds]), (n % 6).cast("int")).alias("event"),
        F.when(n % 6 == 2, F.when(k % 2 == 0, "LOST").otherwise("SUSPENDED"))
        .when(k % 3 != 0, V.text("detail ", k))
        .alias("detail"),
    )


@query
def control_alerts(spark, sf):
    """Alerts of the control rows where an unreachable policy service refuses calls, and where it doesn't."""
    parts = [
        fleet.control_alerts(_control_events(spark, sf), strict).withColumn("strict", F.lit(strict))
        for strict in (True, False)
    ]
    return parts[0].unionByName(parts[1])


@query
def access_modes(spark, sf):
    """Verdicts where no policy is configured or its service is away."""
    parts = [
        access.evaluate_access(V.requests(spark, sf), V.grants(spark), mode).select(
            F.lit(mode).alias("mode"), "allowed"
        )
        for mode in ("off", "degraded_strict", "degraded_lenient")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("allowed").alias("allowed")
    )


@query
def chargeback_from_bodies(spark, sf):
    """Usage from whole answers and from reports that the stream calls send of themselves."""
    r = V.requests(spark, sf).filter("stream")
    report = V.text(
        '{"model":"', F.col("requested_model"), '","prompt_tokens":', F.col("prompt_tokens") - 2,
        ',"completion_tokens":', F.col("completion_tokens"), "}",
    )
    raw = V.raw_requests(spark, sf)
    reports = r.select(
        "request_id", "ts_ms", F.lit("POST").alias("method"), F.lit("/v1/usage").alias("path"),
        F.create_map(F.lit("x-auth-user"), F.col("user_name")).alias("headers"),
        F.lit("192.0.2.1").alias("peer_ip"), report.alias("body"),
        F.lit(None).cast("string").alias("response_body"), "groups", "status", "latency_us",
    )
    identified = stage(adjudication.identify(raw.unionByName(reports)), "identified")
    return tokens.token_chargeback(adjudication.usage_records(identified))


@query
def route_least_loaded(spark, sf):
    out = routing.route_least_loaded(
        V.forwarded(spark, sf), V.depth(spark, sf), V.roster(spark, sf), tick_ms=HOUR_MS
    )
    return out.select("request_id", "routed_container", "routed_host", "routed_depth")


@query
def shadow_compare(spark, sf):
    return metrics.shadow_compare(V.with_shadow(spark, sf))


@query
def merge_token_counters(spark, sf):
    billed = tokens.token_chargeback(V.usage(spark, sf))
    has = lambda c: billed.filter(F.col(c) > 0).select("user_name", "model", c)
    return tokens.merge_token_counters(has("tokens_in"), has("tokens_out"))


@query
def reconcile_snapshot(spark, sf):
    p, s = V.table(spark, sf, "part"), V.table(spark, sf, "orders")
    n, m = F.col("p_partkey"), F.col("o_orderkey")
    desired = s.select(
        V.text("be-", m % 5).alias("backend"),
        V.text("inst-", m % 3000).alias("instance"),
        (m % 3000).alias("inst_ord"),
    ).distinct()
    slots = p.select(
        V.text("be-", n % 5).alias("backend"),
        V.text("slot-", n).alias("slot"),
        n.alias("slot_ord"),
        F.when(n % 3 == 0, V.text("inst-", n - n % 2)).otherwise(V.text("old-", n)).alias("instance"),
        (n % 4 % 2).cast("int").alias("admin_state"),
    )
    return fleet.reconcile_snapshot(desired, slots)


@query
def startup_times(spark, sf):
    return fleet.startup_times(V.container_events(spark, sf))


@query
def proxy_overhead(spark, sf):
    return traces.proxy_overhead(V.spans(spark, sf))


@query
def correlate_logs(spark, sf):
    return traces.correlate_logs(V.service_logs(spark, sf), V.spans(spark, sf))


def _deployments(spark, sf):
    return policies.read_deployments(V.deployment_docs(spark, sf))


@query
def effective_variants(spark, sf):
    return deployments.effective_variants(_deployments(spark, sf))


@query
def stale_variants(spark, sf):
    o = V.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    running = o.select(
        V.text("dep-", n).alias("name"),
        F.explode(F.array(F.lit(None).cast("string"), V.text("v", n % 6))).alias("variant"),
    )
    gone = o.filter(n % 50 == 0).select(V.text("old-", n), F.lit(None).cast("string"))
    return deployments.stale_variants(_deployments(spark, sf), running.union(gone))


@query
def accelerator_lookup(spark, sf):
    return deployments.with_accelerator(_deployments(spark, sf)).select(
        "name", "accelerator_type", "kubernetes_resource", "yarn_resource"
    )


# --- aggregations ------------------------------------------------------------------------------


@query
def request_counts(spark, sf):
    return metrics.request_counts(V.forwarded(spark, sf))


@query
def error_rate(spark, sf):
    return metrics.error_rate(V.with_shadow(spark, sf))


@query
def latency_histogram(spark, sf):
    out = metrics.latency_histogram(V.forwarded(spark, sf))
    return out.select("model", "le", "cum_count", "sum_us", "count")


@query
def histogram_quantile(spark, sf):
    per_host = metrics.latency_histogram(V.forwarded(spark, sf), keys=("model", "host"))
    return metrics.histogram_quantile(per_host, 0.9)


@query
def token_chargeback(spark, sf):
    return tokens.token_chargeback(V.usage(spark, sf))


@query
def chat_chargeback(spark, sf):
    return tokens.token_chargeback(V.chat_usage(spark, sf))


@query
def scrape_load(spark, sf):
    pages = V.scrapes(spark, sf)
    samples = telemetry.parse_exposition(pages, [fleet.GPU_UTILIZATION, fleet.PENDING_REQUESTS])
    keys = ("container_id", "scrape_id")
    return fleet.scrape_load(pages, samples, keys)


@query
def scrape_load_inline(spark, sf):
    return fleet.scrape_load_inline(V.scrapes(spark, sf), ("container_id", "scrape_id"))


def _loads(spark, sf):
    keys = ("deployment", "container_id", "host", "ts_ms", "scrape_id")
    return fleet.scrape_load_inline(V.scrapes(spark, sf), keys)


@query
def fleet_queue_depth(spark, sf):
    return fleet.fleet_queue_depth(_loads(spark, sf))


@query
def gpu_table(spark, sf):
    samples = telemetry.parse_exposition(V.scrapes(spark, sf), [fleet.GPU_FAMILY])
    table = fleet.gpu_table(samples)
    return table.select("host", "gpu", F.explode("metrics").alias("metric", "value"))


@query
def load_signal(spark, sf):
    return fleet.load_signal(_loads(spark, sf), tick_ms=HOUR_MS)


@query
def fleet_health(spark, sf):
    return fleet.fleet_health(V.probes(spark, sf), V.roster(spark, sf), keys=("deployment",))


@query
def fleet_health_modes(spark, sf):
    """Health of the whole fleet: as it is, without its policy service, without ready hosts, and empty."""
    probes, roster = V.probes(spark, sf), V.roster(spark, sf)
    modes = {
        "ok": (probes, roster, "ok"),
        "degraded_strict": (probes, roster, "degraded_strict"),
        "none_ready": (probes.withColumn("ready", F.lit(False)), roster, "ok"),
        "empty": (probes, roster.where("ord < 0"), "ok"),
    }
    parts = [fleet.fleet_health(p, r, authz).withColumn("mode", F.lit(mode)) for mode, (p, r, authz) in modes.items()]
    return reduce(DataFrame.unionByName, parts)


def _alerts(spark, sf):
    return fleet.container_alerts(V.container_events(spark, sf))


@query
def alert_rollup(spark, sf):
    events = V.container_events(spark, sf)
    late = fleet.readiness_alerts(fleet.readiness_deadlines(_starts(spark, sf)))
    return fleet.alert_rollup(fleet.all_alerts(fleet.container_alerts(events), late))


def _pods(spark, sf):
    o = V.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    return o.select(
        V.text("dep-", n).alias("name"),
        F.explode(F.array((n % 7).cast("int"), (n % 3).cast("int"))).alias("ready_replicas"),
    )


@query
def deployment_status(spark, sf):
    return deployments.deployment_status(_deployments(spark, sf), _pods(spark, sf))


@query
def capacity_demand(spark, sf):
    return deployments.capacity_demand(_deployments(spark, sf))


@query
def tracked_models(spark, sf):
    f = V.with_shadow(spark, sf)
    return metrics.tracked_models(f.filter(F.col("latency_us") > 0), f)


@query
def model_scorecard(spark, sf):
    return metrics.model_scorecard(V.forwarded(spark, sf))


@query
def fleet_progress(spark, sf):
    status = deployments.deployment_status(_deployments(spark, sf), _pods(spark, sf))
    ready = F.coalesce("ready_replicas", F.lit(0))
    return status.select("name", L.progress(ready, "target_replicas").alias("progress"))


# --- windows and top-k -------------------------------------------------------------------------


@query
def recent_percentiles(spark, sf):
    return metrics.recent_percentiles(V.forwarded(spark, sf))


@query
def rate_limit(spark, sf):
    rules = policies.load_quota_rules(V.rules_docs(spark))
    out = quota.quota_decisions(V.forwarded(spark, sf), rules, window_ms=DAY_MS)
    return out.select("request_id", "allowed", "retry_after_ms", "reason", "rule_desc")


@query
def allocate_replicas(spark, sf):
    return deployments.allocate_replicas(_deployments(spark, sf))


@query
def phase_transitions(spark, sf):
    r = V.requests(spark, sf)
    k = F.col("prompt_tokens")
    phase = F.when(k % 10 == 0, "Failed").when(k % 3 == 0, "Reconciling").otherwise("Ready")
    history = r.select(
        F.col("user_name").alias("name"), "ts_ms", F.col("request_id").alias("seq"), phase.alias("phase")
    )
    return deployments.phase_transitions(history)


@query
def last_alerts(spark, sf):
    return fleet.recent_alert_lines(_alerts(spark, sf)).select("alert_id", "line")


@query
def latest_depth(spark, sf):
    return metrics.latest_per_key(V.depth(spark, sf), ["container_id", "host"], "depth")


@query
def counter_increase(spark, sf):
    r = V.requests(spark, sf)
    samples = r.select(
        "container_id", "ts_ms", F.col("request_id").alias("seq"),
        (F.col("request_id") % 500).alias("value"),
    )
    return metrics.counter_increase(samples, ["container_id"], window_ms=DAY_MS)


@query
def top_consumers(spark, sf):
    return tokens.top_consumers(tokens.token_chargeback(V.usage(spark, sf)))


@query
def drain_candidate(spark, sf):
    return routing.drain_candidate(V.depth(spark, sf), V.roster(spark, sf))


# --- sources and sinks -------------------------------------------------------------------------


@query
def parse_exposition(spark, sf):
    samples = telemetry.parse_exposition(V.scrapes(spark, sf))
    return samples.select(
        "scrape_id", "line_no", "metric", F.col("labels")["gpu"].alias("gpu"),
        F.col("labels")["model"].alias("model"), "value",
    )


def _scrape_log(spark, sf):
    """The scrapes' lines written as a log, and its path."""
    scrape_log.register(spark)
    path = shared_dir(spark, "scrapes")
    lines = V.scrapes(spark, sf).select("host", "ts_ms", F.explode(F.split("body", "\n")).alias("line"))
    lines.where("line <> ''").write.format("scrape_log").mode("append").save(path)
    return path


@query
def scrape_log_family(spark, sf):
    """Samples of one metric family from a scrape log, whose reader gives no other lines out."""
    log = spark.read.format("scrape_log").load(_scrape_log(spark, sf))
    pending = log.where("metric = 'nv_inference_pending_request_count'")
    samples = telemetry.parse_exposition(pending.select("host", "ts_ms", F.col("line").alias("body")))
    return samples.select("host", "ts_ms", F.col("labels")["model"].alias("model"), "value")


@query
def stream_scrape_log(spark, sf):
    """The lines of a scrape log per host and family, read as a stream."""
    path = _scrape_log(spark, sf)
    lines = _drain_stream(spark.readStream.format("scrape_log").load(path), "scrape-lines")
    return lines.groupBy("host", "metric").agg(
        F.count(F.lit(1)).alias("lines"), F.max("ts_ms").alias("newest_ms")
    )


@query
def service_log_round_trip(spark, sf):
    lines = sinks.format_service_log(V.service_logs(spark, sf))
    back = telemetry.parse_service_log(lines)
    return back.select(
        "doc_id", "level", "logger", "message", "exception", "stack",
        F.size("mdc").cast("bigint").alias("context_keys"),
        F.col("mdc")["trace_id"].alias("trace_id"), F.col("mdc")["span_id"].alias("span_id"),
    )


@query
def load_quota_rules(spark, sf):
    return policies.load_quota_rules(V.rule_docs(spark, sf))


@query
def valid_rule_versions(spark, sf):
    docs = V.rule_docs(spark, sf).withColumn("version", F.col("o_orderkey"))
    valid = policies.valid_versions(docs, fallback='{"rules":[]}')
    return valid.select("o_orderkey", F.length("doc").cast("bigint").alias("doc_length"))


@query
def load_adapters(spark, sf):
    o = V.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    doc = F.when(n % 9 == 0, "{").otherwise(
        V.text('{"base-', n, '":["a","b-', n % 3, '"],"empty":[]}')
    )
    return telemetry.load_adapters(o.select("o_orderkey", doc.alias("doc")))


@query
def model_inventory(spark, sf):
    li = V.table(spark, sf, "lineitem")
    name = V.text("hdfs:///repo/", F.when(F.col("l_linenumber") == 1, "").otherwise(
        V.text("m", F.col("l_partkey"), "/")), F.col("l_orderkey"), "/",
        F.col("l_linenumber"), ".plan")
    flat = V.text("hdfs:///repo/lora-", F.col("l_orderkey"), ".json")
    path = F.when(F.col("l_linenumber") == 2, flat).otherwise(name)
    files = li.select(
        path.alias("path"), F.col("l_quantity").cast("bigint").alias("length"),
        F.col("l_orderkey").alias("modified"),
    )
    return telemetry.model_inventory(files, "hdfs:///repo")


def _listings(spark, sf):
    """Two listings with a file per order: a tenth of them go, a tenth come, a tenth change."""
    n = F.col("o_orderkey")
    files = V.table(spark, sf, "orders").select(
        n.alias("n"),
        V.text("hdfs:///models/m", F.floor(n / 7).cast("bigint"), "/", n).alias("path"),
        F.col("o_custkey").cast("bigint").alias("length"),
        F.timestamp_seconds(F.col("o_custkey").cast("bigint")).alias("modified"),
    )
    after = files.where("n % 10 <> 0").withColumn("length", F.col("length") + F.when(F.col("n") % 10 == 1, 5).otherwise(0))
    return files.where("n % 10 <> 2").drop("n"), after.drop("n")


@query
def inventory_changes(spark, sf):
    """Models that differ between a kept snapshot and a later listing."""
    before, after = _listings(spark, sf)
    snapshot = inventory.keep_snapshot(before, f"inventory_{uuid.uuid4().hex}", buckets=16)
    return inventory.model_changes(snapshot, after, "hdfs:///models")


@query
def loaded_models(spark, sf):
    r = V.requests(spark, sf)
    k = F.col("prompt_tokens")
    body = F.when(k % 10 == 0, "oops").otherwise(
        V.text('[{"name":"', F.col("base_model"), '","version":"', k, '","state":"READY"},'
               '{"name":"other"}]')
    )
    return telemetry.loaded_models(r.select("host", "request_id", body.alias("body")))


@query
def parse_requests(spark, sf):
    out = telemetry.parse_requests(V.raw_requests(spark, sf))
    return out.select(
        "request_id", "base_model", "lora", "stream", "prompt_tokens", "completion_tokens"
    )


@query
def read_deployments(spark, sf):
    return _deployments(spark, sf).select(
        "name", "image", "replicas", "tensor_parallelism", "pipeline_parallelism",
        "accelerator_type", "accelerator_count", "memory", "cpu", "proxy_enabled", "proxy_port",
        "scaling_mode", "min_replicas", "max_replicas", "up_threshold",
        F.size("traffic").cast("bigint").alias("variants"),
    )


@query
def to_exposition(spark, sf):
    f = V.forwarded(spark, sf)
    rows = (
        sinks.histogram_metrics(metrics.latency_histogram(f))
        .unionByName(sinks.scorecard_metrics(metrics.model_scorecard(f)))
        .unionByName(sinks.token_metrics(tokens.token_chargeback(V.usage(spark, sf))))
    )
    return sinks.to_exposition(stage(rows, "metrics"), prefix="fleet_").select("line")


@query
def fleet_exposition(spark, sf):
    """Container, GPU, fleet and alert families from scrapes and lifecycle events."""
    pages, events = V.scrapes(spark, sf), V.container_events(spark, sf)
    loads = _loads(spark, sf)
    latest = loads.groupBy("container_id", "host").agg(
        F.max_by("gpu_load", F.col("scrape_id")).alias("gpu_load"),
        F.max_by("queue_depth", F.col("scrape_id")).alias("queue_depth"),
    )
    started = fleet.startup_times(events).select("container_id", "startup_ms")
    gpus = fleet.gpu_table(telemetry.parse_exposition(pages, [fleet.GPU_FAMILY]))
    totals = latest.agg(
        F.lit(8).alias("target"), F.count(F.lit(1)).alias("running"),
        F.sum("queue_depth").alias("queue_depth"),
    )
    rows = (
        sinks.container_metrics(latest.join(started, "container_id", "left"))
        .unionByName(sinks.gpu_metrics(gpus.withColumn("container_id", F.replace(
            "host", F.lit("host-"), F.lit("container_")))))
        .unionByName(sinks.fleet_metrics(totals))
        .unionByName(sinks.alert_metrics(fleet.alert_rollup(_alerts(spark, sf))))
    )
    return sinks.to_exposition(stage(rows, "fleet-metrics")).select("line")


@query
def instance_list(spark, sf):
    return sinks.instance_list(fleet.instance_roster(V.container_events(spark, sf)))


# --- state and lifecycle -----------------------------------------------------------------------


@query
def breaker_transitions(spark, sf):
    return state.breaker_transitions(
        V.probes(spark, sf), threshold=2, reset_ms=HOUR_MS, chunk_ms=DAY_MS
    )


def _signal(spark, sf):
    signal = fleet.load_signal(_loads(spark, sf), tick_ms=HOUR_MS, mode="GPU_UTIL")
    return signal.withColumn("ts_ms", F.col("tick") * HOUR_MS)


@query
def scale_recommendations(spark, sf):
    return state.scale_recommendations(
        _signal(spark, sf), limits=state.ScalingLimits(up=0.6, down=0.4, cooldown_ms=2 * HOUR_MS)
    )


@query
def instance_roster(spark, sf):
    return fleet.instance_roster(V.container_events(spark, sf))


def _starts(spark, sf):
    """Every even event starts a container, the next one is its readiness probe."""
    e = V.table(spark, sf, "events")
    n = F.col("event_id")
    return e.select(
        (n / 2).cast("bigint").alias("start_id"),
        V.text("container_", (n / 2).cast("bigint") % 97).alias("container_id"),
        V.epoch_ms("ts").alias("ts_ms"),
        F.when(n % 2 == 0, "start")
        .when(F.col("event_type") != "error", "probe_ready")
        .alias("event"),
    )


@query
def readiness_deadlines(spark, sf):
    return fleet.readiness_deadlines(_starts(spark, sf))


@query
def drain_verdicts(spark, sf):
    r = V.requests(spark, sf).filter(F.col("path") == "/v1/models")
    drains = r.select(
        "container_id", F.col("request_id").alias("drain_id"), F.col("ts_ms").alias("drain_ms")
    )
    return fleet.drain_verdicts(drains, V.depth(spark, sf), timeout_ms=HOUR_MS)


@query
def all_alerts(spark, sf):
    rec = scale_recommendations(spark, sf)
    return fleet.all_alerts(
        fleet.container_alerts(V.container_events(spark, sf)),
        fleet.readiness_alerts(fleet.readiness_deadlines(_starts(spark, sf))),
        fleet.drain_alerts(drain_verdicts(spark, sf), timeout_ms=HOUR_MS),
        fleet.scaling_alerts(rec),
        fleet.control_alerts(_control_events(spark, sf)),
        limiter.reload_alerts(policies.valid_versions(_rule_versions(spark, sf))),
    ).groupBy("alert_type", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum(F.length("message")).alias("message_chars"),
        F.max("ts_ms").alias("newest_ms"),
    )


# --- scoring and the composite plan ------------------------------------------------------------


@query
def score_batch(spark, sf):
    e = V.table(spark, sf, "embeddings")
    out = scoring.score_batch(e, scoring.identity_model, "embedding", width=64)
    return out.select("vec_id", F.posexplode("score").alias("pos", "x")).select(
        "vec_id", "pos", F.col("x").cast("double").alias("x")
    )


def doubled_model():
    return lambda batch: batch * 2


@query
def score_routed(spark, sf):
    e = V.table(spark, sf, "embeddings").withColumn(
        "model", F.when(F.col("label") % 3 == 0, "double#a").when(F.col("label") % 3 == 1, "identity")
        .otherwise("absent")
    )
    models = {"identity": scoring.identity_model, "double": doubled_model}
    out = scoring.score_routed(e, models, "model", "embedding")
    return out.select("vec_id", F.posexplode_outer("score").alias("pos", "x")).select(
        "vec_id", "pos", F.col("x").cast("double").alias("x")
    )


def _outcomes(spark, sf):
    return adjudication.adjudicate(
        stage(adjudication.identify(V.raw_requests(spark, sf)), "identified"),
        policies.load_quota_rules(V.rules_docs(spark)),
        V.grants(spark),
        V.depth(spark, sf),
        V.roster(spark, sf),
        window_ms=DAY_MS,
        tick_ms=HOUR_MS,
    )


@query
def adjudicate(spark, sf):
    return _outcomes(spark, sf)


@query
def adjudication_summary(spark, sf):
    return adjudication.outcome_summary(_outcomes(spark, sf))


@query
def adjudicate_versions(spark, sf):
    """Outcomes under two rule documents, the second from the sixteenth day on, with upstreams that
    time out or break off."""
    k = F.col("latency_us") % 20
    calls = stage(
        adjudication.identify(V.raw_requests(spark, sf)).withColumn(
            "upstream_error", F.when(k == 7, "timeout").when(k == 11, "io")
        ),
        "identified",
    )
    starts = F.array(F.lit(0).cast("bigint"), F.lit(1_704_067_200_000 + 15 * DAY_MS))
    docs = V.rules_docs(spark).select("doc", F.explode(starts).alias("valid_from_ms")).withColumn(
        "version", F.when(F.col("valid_from_ms") == 0, 1).otherwise(2)
    )
    outcomes = adjudication.adjudicate(
        quota.rules_asof(calls, docs),
        policies.load_quota_rules(docs),
        V.grants(spark),
        V.depth(spark, sf),
        V.roster(spark, sf),
        window_ms=DAY_MS,
        tick_ms=HOUR_MS,
        version="version",
    )
    return outcomes.select("request_id", "outcome", "code", "container_id", "ok", "latency_us", "retry_after_sec")


# --- streams -----------------------------------------------------------------------------------


def _events_stream(spark, sf):
    """The events table as a file stream."""
    schema = V.table(spark, sf, "events").schema
    # A pattern, not a plain path: it serves a single file as well as a folder of parts.
    return spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")


def _requests_stream(spark, sf):
    return V.requests_from(_events_stream(spark, sf))


def _stream_of(df, label):
    """A file stream over what ``df`` holds."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _drain_stream(stream, label):
    """Run a stream over what is there and return the table it wrote."""
    spark, root = stream.sparkSession, shared_dir(stream.sparkSession, label)
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query
def windowed_chargeback(spark, sf):
    return aggregates.windowed_chargeback(V.usage(spark, sf), window="1 day")


@query
def windowed_metrics(spark, sf):
    return aggregates.windowed_metrics(V.forwarded(spark, sf), window="1 day")


@query
def stream_windowed_chargeback(spark, sf):
    """The stream writes windows that its watermark has closed; as the run is bounded, those still
    open at its end are settled from the rows after the last closed one."""
    usage = V.usage_from(_requests_stream(spark, sf))
    stream = aggregates.windowed_chargeback(usage, window="1 day", watermark="0 seconds")
    closed = _drain_stream(stream, "chargeback")
    rest = aggregates.open_rows(V.usage(spark, sf), closed, DAY_MS)
    return closed.unionByName(aggregates.windowed_chargeback(rest, window="1 day"))


@query
def stream_windowed_metrics(spark, sf):
    calls = V.forwarded_from(_requests_stream(spark, sf))
    stream = aggregates.windowed_metrics(calls, window="1 day", watermark="0 seconds")
    closed = _drain_stream(stream, "metrics")
    rest = aggregates.open_rows(V.forwarded(spark, sf), closed, DAY_MS)
    return closed.unionByName(aggregates.windowed_metrics(rest, window="1 day"))


@query
def stream_instance_roster(spark, sf):
    """The roster as the stream has it at its end; every trigger writes the whole table."""
    root = shared_dir(spark, "roster")
    roster = aggregates.running_roster(V.container_events_from(_events_stream(spark, sf)))

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{root}/out")

    started = (
        roster.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    live = spark.read.schema(roster.schema).parquet(f"{root}/out").filter(F.col("event") == "registered")
    return live.select("container_id", "host", "since_ms")


@query
def stream_scale_recommendations(spark, sf):
    limits = state.ScalingLimits(up=0.6, down=0.4, cooldown_ms=2 * HOUR_MS)
    signal = _stream_of(_signal(spark, sf), "signal")
    return _drain_stream(stateful.stream_scaling(signal, limits=limits), "scaling")


@query
def stream_readiness(spark, sf):
    """Verdicts of the stream's timers, keyed by container and start; starts whose timer the
    watermark has not reached at the end of the bounded run are settled in batch."""
    each = _starts(spark, sf).filter(F.col("event").isNotNull()).withColumn(
        "container_id", F.concat_ws("/", "container_id", "start_id")
    )
    events = aggregates.event_time(_stream_of(each, "starts"), "0 seconds")
    done = _drain_stream(stateful.stream_readiness(events, fleet.WARMUP_TIMEOUT_MS), "readiness")
    open_ = fleet.readiness_deadlines(each).join(done, "container_id", "left_anti")
    return done.unionByName(open_.select(*done.columns))


@query
def stream_breaker(spark, sf):
    probes = V.probes_from(_requests_stream(spark, sf))
    return _drain_stream(stateful.stream_breaker(probes, 2, HOUR_MS), "breaker")


@query
def stream_rate_limit_reload(spark, sf):
    """The same calls in three runs of one stream, ten days each; a second and a third rule document
    are published in between and start buckets of their own."""
    root = shared_dir(spark, "reload")
    start, days = 1_704_067_200_000, 10
    calls = V.forwarded(spark, sf)
    sink = limiter.StreamLimiter(f"{root}/versions", f"{root}/state", f"{root}/out", window_ms=DAY_MS)
    for run in range(3):
        since = start + run * days * DAY_MS if run else 0
        docs = V.rules_docs(spark).select(
            F.lit(run + 1).alias("version"), F.lit(since).cast("bigint").alias("valid_from_ms"), "doc"
        )
        policies.publish_rules(docs, f"{root}/versions")
        part = F.least(F.greatest(F.floor((F.col("ts_ms") - start) / (days * DAY_MS)), F.lit(0)), F.lit(2))
        calls.filter(part == run).write.mode("append").parquet(f"{root}/in")
        started = (
            spark.readStream.schema(calls.schema).parquet(f"{root}/in")
            .writeStream.foreachBatch(sink)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
    out = spark.read.parquet(f"{root}/out/epoch-*")
    return out.select("request_id", "version", "allowed", "retry_after_ms", "reason", "rule_desc")


@query
def stream_rate_limit(spark, sf):
    """Calls judged batch by batch under one published rule document."""
    root = shared_dir(spark, "limits")
    docs = V.rules_docs(spark).select(
        F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("valid_from_ms"), "doc"
    )
    policies.publish_rules(docs, f"{root}/versions")
    sink = limiter.StreamLimiter(f"{root}/versions", f"{root}/state", f"{root}/out", window_ms=DAY_MS)
    calls = V.forwarded_from(_requests_stream(spark, sf))
    started = (
        calls.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    out = spark.read.parquet(f"{root}/out/epoch-*")
    return out.select("request_id", "allowed", "retry_after_ms", "reason", "rule_desc")


RUNS = 3


def _in_runs(rows, arrival, end, label, start):
    """Give ``rows`` to a stream in the order of their arrival, a third in each of three runs that go
    on from one checkpoint. ``end`` is a row of a far later time: it moves the watermark past all
    others, and what becomes of it is left out by the caller. ``start(stream, root)`` starts a run.
    """
    spark, root = rows.sparkSession, shared_dir(rows.sparkSession, label)
    # A file is read by one task where it has one row group: a file for each core.
    spread = rows.withColumn("__arrival", arrival).repartition(spark.sparkContext.defaultParallelism)
    staged = stage(spread, label)
    first, last = staged.agg(F.min("__arrival"), F.max("__arrival")).first()
    run = F.least(F.floor((F.col("__arrival") - first) * RUNS / F.lit(max(last - first, 1))), F.lit(RUNS - 1))
    for k in range(RUNS):
        part = staged.where(run == k).drop("__arrival")
        part = part.unionByName(end) if k == RUNS - 1 else part
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        start(stream, root).awaitTermination()
    return root


def _appended(build):
    """A start for :func:`_in_runs` that appends what ``build`` makes of the stream, and the table."""
    state = {}

    def start(stream, root):
        out = build(stream)
        state["schema"] = out.schema
        return (
            out.writeStream.format("parquet")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    return start, state


def _shuffled(ts, lateness_ms):
    """An arrival time up to ``lateness_ms`` after the row's own, by a hash of its time."""
    return F.col(ts) + F.pmod(F.xxhash64(ts), F.lit(lateness_ms))


FAR_MS = 4_000_000_000_000


def _end_row(rows, **values):
    """One row of nulls with the given values, in the columns of ``rows``."""
    columns = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.sparkSession.range(1).select(*columns)


@query
def stream_adjudication_summary(spark, sf):
    """Raw calls in three runs, out of order by up to six hours, through the chained stream."""
    raw = V.raw_requests(spark, sf)
    end = _end_row(raw, request_id=-1, ts_ms=FAR_MS, method="POST", path="/end")
    inputs = (
        policies.load_quota_rules(V.rules_docs(spark)), V.grants(spark),
        stage(V.depth(spark, sf), "depth"), stage(V.roster(spark, sf), "roster"),
    )

    def build(stream):
        calls = one_stream.stream_adjudication(
            stream, *inputs, lateness_ms=6 * HOUR_MS, window_ms=DAY_MS, tick_ms=HOUR_MS
        )
        return one_stream.outcome_windows(calls, "1 day")

    start, made = _appended(build)
    root = _in_runs(raw, _shuffled("ts_ms", 6 * HOUR_MS), end, "adjudication", start)
    return one_stream.outcome_totals(spark.read.schema(made["schema"]).parquet(f"{root}/out"))


@query
def stream_rate_limit_keyed(spark, sf):
    """Calls in three runs, out of order by up to six hours, placed in keyed state."""
    calls = quota.match_quota_rule(V.forwarded(spark, sf), policies.load_quota_rules(V.rules_docs(spark)))
    names = [f for f in quota.RULE_FIELDS if f != "rpm"]
    rows = calls.select("request_id", "ts_ms", "bucket", "rpm", F.to_json(F.struct(*names)).alias("rule"))
    end = _end_row(rows, request_id=-1, ts_ms=FAR_MS)
    start, made = _appended(
        lambda s: keyed.place_requests(s, DAY_MS, lateness_ms=6 * HOUR_MS, payload="rule")
    )
    root = _in_runs(rows, _shuffled("ts_ms", 6 * HOUR_MS), end, "places", start)
    placed = spark.read.schema(made["schema"]).parquet(f"{root}/out").where("request_id >= 0")
    rule = F.from_json("payload", ", ".join(f"{n} string" for n in names))
    out = quota.decide(placed.withColumn("rule", rule).select("*", "rule.*"), DAY_MS)
    return out.select("request_id", "allowed", "retry_after_ms", "reason", "rule_desc")


@query
def stream_drain_verdicts(spark, sf):
    """Drains and depth readings in three runs, out of order by up to six hours."""
    r = V.requests(spark, sf)
    drains = r.filter(F.col("path") == "/v1/models").select(
        "container_id", F.col("request_id").alias("event_id"), "ts_ms", F.lit(None).cast("int").alias("depth"),
        F.lit(True).alias("drain"),
    )
    readings = V.depth(spark, sf).select("container_id", "event_id", "ts_ms", "depth", F.lit(False).alias("drain"))
    rows = drains.unionByName(readings)
    end = _end_row(rows, container_id="end", event_id=-1, ts_ms=FAR_MS, depth=0, drain=False)

    def build(stream):
        begun = stream.where("drain").select(
            "container_id", F.col("event_id").alias("drain_id"), F.col("ts_ms").alias("drain_ms")
        )
        return keyed.stream_drains(begun, stream.where("not drain"), 6 * HOUR_MS, HOUR_MS)

    start, made = _appended(build)
    root = _in_runs(rows, _shuffled("ts_ms", 6 * HOUR_MS), end, "drains", start)
    return spark.read.schema(made["schema"]).parquet(f"{root}/out")


@query
def stream_roster_changes(spark, sf):
    """The roster from a table of changes, after three runs with rows out of order."""
    events = V.container_events(spark, sf)
    end = _end_row(events, event_id=-1, ts_ms=FAR_MS, event="ready")
    table = RosterTable(shared_dir(spark, "roster-table"), ttl_ms=30 * DAY_MS, least_changes=100)

    def start(stream, root):
        changes = keyed.roster_changes(stream, fleet.LIFECYCLE, 6 * HOUR_MS, 30 * DAY_MS)
        return (
            changes.writeStream.outputMode("update")
            .foreachBatch(table)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    _in_runs(events, _shuffled("ts_ms", 6 * HOUR_MS), end, "roster", start)
    return table.read(spark)


@query
def stream_running_totals(spark, sf):
    """Totals per user and model over the windows of a stream in three runs."""
    usage = V.usage(spark, sf)
    end = _end_row(usage, ts_ms=FAR_MS, prompt_tokens=1)
    start, made = _appended(lambda s: aggregates.windowed_chargeback(s, "1 day", f"{6 * HOUR_MS} milliseconds"))
    root = _in_runs(usage, _shuffled("ts_ms", 6 * HOUR_MS), end, "totals", start)
    return aggregates.running_totals(spark.read.schema(made["schema"]).parquet(f"{root}/out"))


@query
def stream_reports_sent_twice(spark, sf):
    """Daily chargeback of a stream in which every report comes again up to six hours later."""
    usage = V.usage(spark, sf).withColumn("report_id", F.xxhash64("user_name", "model", "ts_ms"))
    sent = usage.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    later = F.col("ts_ms") + F.col("again") * F.pmod(F.col("report_id"), F.lit(6 * HOUR_MS))

    def build(stream):
        once = aggregates.distinct_reports(stream, f"{6 * HOUR_MS} milliseconds")
        return aggregates.windowed_chargeback(once, "1 day")

    start, made = _appended(build)
    end = _end_row(sent, ts_ms=FAR_MS, report_id=0, prompt_tokens=1, completion_tokens=1)
    root = _in_runs(sent, later, end, "reports", start)
    return spark.read.schema(made["schema"]).parquet(f"{root}/out")


@query
def stream_latency_quantiles(spark, sf):
    """Percentiles from sketches of daily windows; exact while a model has at most sketches.K calls."""
    calls = V.forwarded(spark, sf).select("ts_ms", "model", "latency_us")
    start, made = _appended(lambda s: sketches.windowed_sketches(s, "1 day", f"{6 * HOUR_MS} milliseconds"))
    end = _end_row(calls, ts_ms=FAR_MS, latency_us=1)
    root = _in_runs(calls, _shuffled("ts_ms", 6 * HOUR_MS), end, "sketches", start)
    windows = spark.read.schema(made["schema"]).parquet(f"{root}/out")
    return sketches.merged_quantiles(windows, {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99})


@query
def stream_proxy_overhead(spark, sf):
    """Server spans and upstream calls paired in a stream in three runs, out of order."""
    rows = V.spans(spark, sf)
    # Rows without keys are left out before they are timed, so both sides end with keys of their own.
    ids = {"trace_id": "end", "span_id": "end", "start_us": FAR_MS * 1000, "end_us": FAR_MS * 1000}
    sides = [_end_row(rows, kind=kind, parent_span_id="none", **ids) for kind in ("SERVER", "CLIENT")]
    start, made = _appended(lambda s: spans.span_overheads(s, 6 * HOUR_MS, HOUR_MS))
    arrival = F.col("start_us") + F.pmod(F.xxhash64("trace_id", "kind"), F.lit(6 * HOUR_MS * 1000))
    root = _in_runs(rows, arrival, sides[0].unionByName(sides[1]), "spans", start)
    return spans.overhead_quantiles(spark.read.schema(made["schema"]).parquet(f"{root}/out"))

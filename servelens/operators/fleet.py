"""Fleet state from scrapes, probes and container events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.functions.load import normalised_load
from servelens.operators.metrics import last_n
from servelens.operators.skew import asof_last, order_key, sliced_row_number

# Metric families read from scrapes and limits.
GPU_UTILIZATION = "nv_gpu_utilization"
GPU_FAMILY = "nv_gpu_"
PENDING_REQUESTS = "nv_inference_pending_request_count"
ACTIVITY_MARKER = "nv_inference_request_success"
ACTIVE_LOAD = 0.3
QUEUE_CAPACITY = 16
WARMUP_TIMEOUT_MS = 120_000
DRAIN_TIMEOUT_MS = 30_000
RECENT_ALERTS = 100
LIFECYCLE = ("registered", "completed", "stopped", "start_error", "drain", "session_lost")


def _count(value: Column) -> Column:
    """A scraped number as a whole one, at most the largest 32-bit one."""
    return F.least(value, F.lit(2147483647.0)).cast("bigint")


def scrape_load(
    scrapes: DataFrame, samples: DataFrame, keys=("host", "container_id", "ts_ms", "scrape_id")
) -> DataFrame:
    """One row per scrape with ``gpu_load`` and ``queue_depth``.

    GPU load is the mean utilisation over GPUs / 100; without GPU lines a scrape that mentions
    the activity marker counts as 0.3, else 0. Depth sums the pending counts, truncated each.
    """
    # Digits and dots only, as in the text form: a sign or exponent is not part of the grammar.
    plain = F.regexp_extract("value_text", r"^[\d.]+", 0).try_cast("double")
    usable = samples.filter(
        F.col("labelled") & F.col("metric").isin(GPU_UTILIZATION, PENDING_REQUESTS)
    ).withColumn("value", plain).filter(F.col("value").isNotNull())
    is_gpu = F.col("metric") == GPU_UTILIZATION
    measured = usable.groupBy(*keys).agg(
        F.avg(F.when(is_gpu, F.col("value"))).alias("__gpu"),
        F.sum(F.when(~is_gpu, _count(F.col("value")))).alias("__depth"),
    )
    # The page text stays behind: only the fallback value derived from it meets the samples.
    idle = F.when(F.contains("body", F.lit(ACTIVITY_MARKER)), ACTIVE_LOAD).otherwise(0.0)
    pages = scrapes.select(*keys, idle.alias("__idle"))
    return pages.join(measured, list(keys), "left").select(
        *keys,
        F.coalesce(F.col("__gpu") / 100.0, F.col("__idle")).alias("gpu_load"),
        F.coalesce("__depth", F.lit(0)).cast("bigint").alias("queue_depth"),
    )


def scrape_load_inline(scrapes: DataFrame, keys=("host", "container_id", "ts_ms", "scrape_id")) -> DataFrame:
    """Same result as :func:`scrape_load` straight from the text, without exploding or a shuffle."""

    def values(metric: str) -> Column:
        found = F.regexp_extract_all("body", F.lit(metric + r"\{[^}]*\}\s+([\d.]+)"), F.lit(1))
        parsed = F.transform(found, lambda v: v.try_cast("double"))
        return F.filter(parsed, lambda v: v.isNotNull())

    gpu = F.col("__gpu")
    zero = F.lit(0.0)
    mean = F.aggregate(gpu, zero, lambda a, v: a + v) / F.size(gpu) / 100.0
    idle = F.when(F.contains("body", F.lit(ACTIVITY_MARKER)), ACTIVE_LOAD).otherwise(0.0)
    return scrapes.withColumns(
        {"__gpu": values(GPU_UTILIZATION), "__pending": values(PENDING_REQUESTS)}
    ).select(
        *keys,
        F.when(F.size(gpu) > 0, mean).otherwise(idle).alias("gpu_load"),
        F.aggregate(
            F.col("__pending"), F.lit(0).cast("bigint"), lambda a, v: a + _count(v)
        ).alias("queue_depth"),
    )


def fleet_queue_depth(loads: DataFrame) -> DataFrame:
    """Sum over containers of the latest scraped depth."""
    latest = loads.groupBy("container_id").agg(
        F.max_by("queue_depth", order_key("ts_ms", "scrape_id")).alias("queue_depth")
    )
    return latest.agg(
        F.sum("queue_depth").alias("total_depth"), F.count(F.lit(1)).alias("containers")
    )


def gpu_table(samples: DataFrame) -> DataFrame:
    """Per host and GPU, a map of metric name (without family prefix) to its last value text."""
    gpu = samples.filter(
        F.startswith("metric", F.lit(GPU_FAMILY)) & F.col("labels")["gpu"].isNotNull()
    ).select(
        "host",
        F.col("labels")["gpu"].alias("gpu"),
        F.substring("metric", len(GPU_FAMILY) + 1, 1 << 20).alias("name"),
        "value_text",
        order_key("ts_ms", "scrape_id").alias("at"),
        "line_no",
    )
    # The last line of a page wins before pages meet.
    pages = gpu.groupBy("host", "gpu", "name", "at").agg(F.max_by("value_text", "line_no").alias("value"))
    return (
        pages.groupBy("host", "gpu", "name")
        .agg(F.max_by("value", "at").alias("value"))
        .groupBy("host", "gpu")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics"))
    )


def load_signal(
    loads: DataFrame,
    tick_ms: int,
    mode: str = "COMPOSITE",
    capacity: int = QUEUE_CAPACITY,
    running: DataFrame | None = None,
    keys=("deployment",),
) -> DataFrame:
    """Per deployment and tick: mean GPU load and total depth over the containers that answered
    (their last scrape of the tick), container count and normalised load.

    ``running`` (keys, tick, containers) gives the roster size; else the answering containers are
    counted.
    """
    tick = F.floor(F.col("ts_ms") / F.lit(tick_ms)).cast("bigint")
    at = order_key("ts_ms", "scrape_id")
    answered = loads.groupBy(*keys, tick.alias("tick"), "container_id").agg(
        F.max_by("gpu_load", at).alias("gpu_load"),
        F.max_by("queue_depth", at).alias("queue_depth"),
    )
    # Loads are summed as integer millionths so that the mean does not depend on row order.
    micro = F.round(F.col("gpu_load") * 1_000_000).cast("bigint")
    totals = answered.groupBy(*keys, "tick").agg(
        (F.sum(micro) / F.count(F.lit(1)) / 1_000_000).alias("gpu_util"),
        F.sum("queue_depth").alias("queue_depth"),
        F.count(F.lit(1)).alias("answered"),
    )
    if running is None:
        sized = totals.withColumn("containers", F.col("answered"))
    else:
        sized = (
            running.select(*keys, "tick", "containers")
            .join(totals, [*keys, "tick"], "left")
            .fillna(0, ["queue_depth", "answered"])
            .fillna(0.0, ["gpu_util"])
        )
    load = normalised_load("gpu_util", "queue_depth", "containers", F.lit(capacity), F.lit(mode))
    return sized.withColumn("load", load)


def fleet_health(probes: DataFrame, roster: DataFrame, authz: str = "ok", keys=()) -> DataFrame:
    """Health code from the latest probe of each rostered host.

    ``authz='degraded_strict'`` overrides everything. The proxy is healthy with any backend.
    """
    latest = probes.groupBy("host").agg(
        F.max_by("ready", order_key("ts_ms", "event_id")).alias("ready")
    )
    state = roster.select(*keys, "host").distinct().join(latest, "host", "left")
    any_ready = F.coalesce(F.bool_or("ready"), F.lit(False))
    backends = F.count(F.lit(1))
    summary = state.groupBy(*keys).agg(
        backends.alias("backends"),
        F.count_if("ready").alias("ready_hosts"),
        any_ready.alias("any_ready"),
    )
    code = F.when(F.col("any_ready"), "OK").otherwise("NO_INSTANCES_READY")
    if authz == "degraded_strict":
        code = F.lit("RANGER_UNAVAILABLE")
    proxy = F.when(F.col("backends") > 0, "OK").otherwise("NO_BACKENDS")
    return summary.select(
        *keys, "backends", "ready_hosts", code.alias("health"), proxy.alias("proxy_health")
    )


def startup_times(events: DataFrame) -> DataFrame:
    """Last ready minus last start per container, null when either is missing."""
    at = lambda name: F.max(F.when(F.col("event") == name, F.col("ts_ms")))
    return (
        events.groupBy("container_id")
        .agg(at("start").alias("start_ms"), at("ready").alias("ready_ms"))
        .withColumn("startup_ms", F.col("ready_ms") - F.col("start_ms"))
    )


def instance_roster(events: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Containers whose last event is a registration; everything else removes them.

    Removing events: completed, stopped, start_error, drain, session_lost.
    """
    seen = events.filter(F.col("event").isin(*LIFECYCLE))
    if as_of_ms is not None:
        seen = seen.filter(F.col("ts_ms") <= as_of_ms)
    return (
        seen.groupBy("container_id", "host")
        .agg(
            F.max_by("event", order_key("ts_ms", "event_id")).alias("event"),
            F.max("ts_ms").alias("since_ms"),
        )
        .filter(F.col("event") == "registered")
        .select("container_id", "host", "since_ms")
    )


def readiness_deadlines(events: DataFrame, timeout_ms: int = WARMUP_TIMEOUT_MS) -> DataFrame:
    """Warm-up verdict per start: ready within the deadline, or registered late with a warning.

    ``events`` holds one start per ``start_id``; ``probe_ready`` rows carry the same id.
    """
    start = F.min(F.when(F.col("event") == "start", F.col("ts_ms")))
    ready = F.min(F.when(F.col("event") == "probe_ready", F.col("ts_ms")))
    runs = events.groupBy("container_id", "start_id").agg(
        start.alias("start_ms"), ready.alias("ready_ms")
    )
    took = F.col("ready_ms") - F.col("start_ms")
    ok = F.coalesce(took < timeout_ms, F.lit(False))
    return runs.filter(F.col("start_ms").isNotNull()).select(
        "container_id",
        "start_id",
        "start_ms",
        F.when(ok, "warmup_ok").otherwise("warmup_timeout").alias("verdict"),
        F.when(ok, took).alias("took_ms"),
        F.when(ok, F.col("ready_ms"))
        .otherwise(F.col("start_ms") + timeout_ms)
        .alias("registered_ms"),
    )


def drain_verdicts(
    drains: DataFrame, depth: DataFrame, timeout_ms: int = DRAIN_TIMEOUT_MS
) -> DataFrame:
    """Whether each drain (container_id, drain_id, drain_ms) reached depth 0 before its deadline.

    A container without a reading counts as empty. Two points per drain are looked up in the
    readings: the depth in force when it begins, and at the deadline the depth in force together
    with the time of the last empty reading.
    """
    marks = depth.select(
        "container_id", "ts_ms", "event_id", "depth",
        F.when(F.col("depth") <= 0, F.col("ts_ms")).alias("empty_ms"),
    )
    ends = F.array(
        F.struct(F.col("drain_ms").alias("ts_ms"), F.lit(True).alias("inclusive")),
        F.struct((F.col("drain_ms") + timeout_ms).alias("ts_ms"), F.lit(False).alias("inclusive")),
    )
    points = drains.select("container_id", "drain_id", "drain_ms", F.inline(ends))
    looked_up = asof_last(marks, points, ["container_id"], ["depth", "empty_ms"])
    begins = F.col("ts_ms") == F.col("drain_ms")
    both = looked_up.groupBy("container_id", "drain_id", "drain_ms").agg(
        F.max(F.when(begins, F.col("depth"))).alias("__entry"),
        F.max(F.when(~begins, F.col("depth"))).alias("__final"),
        F.max(F.when(~begins, F.col("empty_ms"))).alias("__empty"),
    )
    emptied = (F.coalesce("__entry", F.lit(0)) <= 0) | (F.col("__empty") >= F.col("drain_ms"))
    remaining = F.when(emptied, F.lit(0)).otherwise(F.col("__final"))
    return both.select(
        "container_id", "drain_id", "drain_ms",
        F.when(remaining > 0, "drain_timeout").otherwise("drained").alias("verdict"),
        remaining.cast("int").alias("remaining"),
    )


def alert_rollup(alerts: DataFrame, n: int = RECENT_ALERTS) -> DataFrame:
    """Totals among the newest ``n`` alerts, and over all of them."""
    counted = [
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("alert_type") == "container_failure").alias("container_failures"),
        F.count_if(F.col("alert_type") == "scaling_event").alias("scaling_events"),
    ]
    recent = last_n(alerts, n, order=("ts_ms", "alert_id"))
    return (
        recent.agg(*counted).select(F.lit("recent").alias("scope"), "*")
        .unionByName(alerts.agg(*counted).select(F.lit("all").alias("scope"), "*"))
    )


def recent_alert_lines(alerts: DataFrame, n: int = RECENT_ALERTS) -> DataFrame:
    """``# [time] SEVERITY - type: message`` for the newest ``n`` alerts."""
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat(
        F.lit("# ["), stamp, F.lit("] "), F.upper("severity"), F.lit(" - "),
        F.col("alert_type"), F.lit(": "), F.col("message"),
    )
    return last_n(alerts, n, order=("ts_ms", "alert_id")).select("alert_id", "ts_ms", line.alias("line"))


def container_alerts(events: DataFrame) -> DataFrame:
    """Failure alerts from lifecycle rows: non-zero exits and start errors."""
    failed_exit = (F.col("event") == "completed") & (F.col("exit_status") != 0)
    why = F.when(
        failed_exit, F.concat(F.lit("exit code "), F.col("exit_status").cast("string"),
                              F.lit(" - "), F.coalesce("detail", F.lit("")))
    ).otherwise(F.concat(F.lit("no start - "), F.coalesce("detail", F.lit("null"))))
    return events.filter(failed_exit | (F.col("event") == "start_error")).select(
        F.col("event_id").alias("alert_id"),
        "ts_ms",
        F.lit("container_failure").alias("alert_type"),
        F.concat(F.lit("Failure of container "), F.col("container_id"), F.lit(": "), why).alias("message"),
        F.lit("critical").alias("severity"),
    )


def scaling_alerts(recommendations: DataFrame) -> DataFrame:
    return recommendations.select(
        F.col("tick").alias("alert_id"),
        "ts_ms",
        F.lit("scaling_event").alias("alert_type"),
        F.concat(
            F.col("action"), F.lit(" from "), F.col("from_target").cast("string"),
            F.lit(" to "), F.col("to_target").cast("string"), F.lit(" containers"),
        ).alias("message"),
        F.lit("info").alias("severity"),
    )


def readiness_alerts(verdicts: DataFrame, timeout_ms: int = WARMUP_TIMEOUT_MS) -> DataFrame:
    ok = F.col("verdict") == "warmup_ok"
    cid = F.concat(F.lit("Container "), F.col("container_id"))
    return verdicts.select(
        F.col("start_id").alias("alert_id"),
        F.col("registered_ms").alias("ts_ms"),
        F.col("verdict").alias("alert_type"),
        F.when(ok, F.concat(
            cid, F.lit(" took "), F.col("took_ms").cast("string"), F.lit(" ms to get ready")
        ))
        .otherwise(F.concat(cid, F.lit(
            f" was not ready after {timeout_ms} ms and is listed all the same"
        )))
        .alias("message"),
        F.when(ok, "info").otherwise("warning").alias("severity"),
    )


def drain_alerts(verdicts: DataFrame, timeout_ms: int = DRAIN_TIMEOUT_MS) -> DataFrame:
    return verdicts.filter(F.col("verdict") == "drain_timeout").select(
        F.col("drain_id").alias("alert_id"),
        (F.col("drain_ms") + timeout_ms).alias("ts_ms"),
        F.lit("drain_timeout").alias("alert_type"),
        F.concat(
            F.lit("Drain of container "), F.col("container_id"), F.lit(" ended with "),
            F.col("remaining").cast("string"), F.lit(" requests open"),
        ).alias("message"),
        F.lit("warning").alias("severity"),
    )


def control_alerts(events: DataFrame, strict: bool = True) -> DataFrame:
    """Alerts from registry, authorization and rule-reload rows (event_id, ts_ms, event, detail).

    ``detail`` of a lost connection is LOST or SUSPENDED.
    """
    by_mode = "critical" if strict else "warning"
    severity = (
        F.when(F.col("event").isin("ranger_degraded", "zk_init_failed"), by_mode)
        .when(F.col("event") == "zk_connection_lost",
              F.when(F.col("detail") == "LOST", "critical").otherwise("warning"))
        .when(F.col("event").isin("zk_reconnected", "quota_reloaded"), "info")
    )
    return events.select(
        F.col("event_id").alias("alert_id"), "ts_ms", F.col("event").alias("alert_type"),
        F.coalesce("detail", F.lit("")).alias("message"), severity.alias("severity"),
    ).filter(F.col("severity").isNotNull())


def all_alerts(*sources: DataFrame) -> DataFrame:
    columns = ["alert_id", "ts_ms", "alert_type", "message", "severity"]
    out = sources[0].select(*columns)
    for extra in sources[1:]:
        out = out.unionByName(extra.select(*columns))
    return out


def reconcile_snapshot(desired: DataFrame, slots: DataFrame, slice_rows: int = 100_000) -> DataFrame:
    """Plan per backend: which slot serves which instance.

    ``desired`` (backend, instance, inst_ord), ``slots`` (backend, slot, slot_ord, instance,
    admin_state 0 = ready). An instance already in a ready slot keeps it, else an existing slot is
    enabled; what is left is assigned to the free slots in order; free slots beyond that go to
    maintenance unless they are there; instances beyond the free slots are ``unplaced``.
    """
    pair = ["backend", "instance"]
    in_ready = F.col("admin_state") == 0
    # One instance may be listed once and may sit in several slots: ready first, then slot order.
    chosen = (
        slots.join(desired.select(*pair), pair, "left_semi")
        .groupBy(*pair)
        .agg(F.min(F.struct((~in_ready).alias("not_ready"), "slot_ord", "slot")).alias("s"))
        .select(
            *pair,
            F.col("s.slot").alias("slot"),
            F.when(F.col("s.not_ready"), "enable").otherwise("keep").alias("action"),
        )
    )
    free = slots.join(chosen.select("backend", "slot"), ["backend", "slot"], "left_anti")
    new = desired.join(chosen.select(*pair), pair, "left_anti")
    free_ranked = sliced_row_number(
        free.select("backend", "slot", "slot_ord", "admin_state"),
        ["backend"], ["slot_ord", "slot"], F.floor(F.col("slot_ord") / slice_rows), "rank",
    )
    new_ranked = sliced_row_number(
        new.select("backend", "instance", "inst_ord"),
        ["backend"], ["inst_ord", "instance"], F.floor(F.col("inst_ord") / slice_rows), "rank",
    )
    rest = free_ranked.join(new_ranked, ["backend", "rank"], "full_outer").select(
        "backend",
        "instance",
        "slot",
        F.when(F.col("slot").isNull(), "unplaced")
        .when(F.col("instance").isNotNull(), "assign")
        .when(F.col("admin_state") != 1, "maint")
        .alias("action"),
    )
    return chosen.select("backend", "instance", "slot", "action").unionByName(
        rest.filter(F.col("action").isNotNull())
    )

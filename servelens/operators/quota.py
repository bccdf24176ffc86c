"""Quota rules: matching, rule versions over time, fixed-window rate limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from servelens.operators.skew import (
    SALTS,
    asof_last,
    order_key,
    order_key_ts,
    salted,
    salted_join,
    sliced_row_number,
    time_slice,
)

# Fixed values.
WINDOW_MS = 60_000
ZERO_QUOTA_RETRY_MS = 60_000
RULE_FIELDS = ("rule_user", "rule_group", "rule_model", "rpm")


def _bucket(user: Column, group: Column, model: Column) -> Column:
    caller = F.coalesce(F.concat(F.lit("u:"), user), F.concat(F.lit("g:"), group), F.lit("*"))
    return F.concat_ws("|", caller, model)


def rule_text(
    user: Column | str, group: Column | str, model: Column | str, rpm: Column | str
) -> Column:
    def shown(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(c.cast("string"), F.lit("null"))

    return F.concat(
        F.lit("rule[user="), shown(user), F.lit(",group="), shown(group),
        F.lit(",model="), shown(model), F.lit(",rpm="), shown(rpm), F.lit("]"),
    )


def match_quota_rule(
    requests: DataFrame,
    rules: DataFrame,
    user: str = "user_name",
    groups: str = "groups",
    model: str = "base_model",
    version: str | None = None,
) -> DataFrame:
    """Add the first matching rule in ``rule_ord`` order (rule_user, rule_group, rule_model, rpm,
    bucket), all null when none matches.

    ``rules`` is the output of ``load_quota_rules``; ``rule_ord`` is most specific first. With
    ``version``, both sides carry that column and only rules of the same version apply.

    Each distinct caller is resolved once by equi-joins on the rule's fixed parts. Rules of equal
    ``rule_ord`` are taken in the order of their fields, whatever their number. The join back is the
    only one over all requests; adaptive execution splits a caller that holds many of them, since no
    operator above needs the join's partitioning.
    """
    who = [*([version] if version else []), user, groups, model]
    callers = requests.select(*who).distinct()
    wild = F.lit("*")
    shapes = (
        callers.withColumn("__ku", F.explode(F.array(F.concat(F.lit("="), F.col(user)), wild)))
        .withColumn(
            "__kg",
            F.explode(
                F.concat(
                    F.transform(
                        F.coalesce(F.col(groups), F.array().cast("array<string>")),
                        lambda g: F.concat(F.lit("="), g),
                    ),
                    F.array(wild),
                )
            ),
        )
        .withColumn("__km", F.explode(F.array(F.concat(F.lit("="), F.col(model)), wild)))
    )
    keyed = rules.select(
        *([version] if version else []),
        F.coalesce(F.concat(F.lit("="), F.col("rule_user")), wild).alias("__ku"),
        F.coalesce(F.concat(F.lit("="), F.col("rule_group")), wild).alias("__kg"),
        F.when(F.col("rule_model") == "*", wild)
        .otherwise(F.concat(F.lit("="), F.col("rule_model")))
        .alias("__km"),
        F.struct("rule_ord", *RULE_FIELDS).alias("__r"),
    )
    on = [*([version] if version else []), "__ku", "__kg", "__km"]
    best = keyed.groupBy(*on).agg(F.min("__r").alias("__r"))
    resolved = shapes.join(best, on).groupBy(*who).agg(F.min("__r").alias("__r"))
    # Null fields of a struct are equal to each other, so callers with nulls find their rule.
    key = F.struct(*who)
    resolved = resolved.select(key.alias("__who"), "__r")
    joined = requests.withColumn("__who", key).join(resolved, "__who", "left")
    out = joined.select(
        *requests.columns, *[F.col(f"__r.{f}").alias(f) for f in RULE_FIELDS]
    )
    return with_bucket(out, version)


def with_bucket(df: DataFrame, version: str | None = None) -> DataFrame:
    """Add the bucket that the columns of a matched rule name; null where none counts."""
    bucket = _bucket(F.col("rule_user"), F.col("rule_group"), F.col("rule_model"))
    if version:
        bucket = F.concat_ws("@", bucket, F.col(version).cast("string"))
    return df.withColumn("bucket", F.when(F.col("rpm") > 0, bucket))


def rank_requests(
    requests: DataFrame,
    window_ms: int = WINDOW_MS,
    slice_ms: int | None = None,
    ts_ms: str = "ts_ms",
    row_id: str = "request_id",
    carried: DataFrame | None = None,
) -> DataFrame:
    """Place requests matched by :func:`match_quota_rule` in their bucket's windows.

    Adds ``window_start_ms, place, capacity, late``. A bucket's windows start at its first request,
    whose rule sets the capacity. ``carried`` (bucket, first_ms, capacity, window_start_ms, used)
    continues buckets from earlier batches; a request of a window before the carried one is late.
    A window is ranked in about a thousand slices of at least a second, or in ``slice_ms`` ones.
    """
    slice_ms = slice_ms or max(1000, window_ms // 1024)
    first_seen = F.min(order_key(ts_ms, row_id))
    fresh = (
        requests.filter(F.col("bucket").isNotNull())
        .groupBy("bucket", "rpm")
        .agg(first_seen.alias("__first"))
        .groupBy("bucket")
        .agg(
            order_key_ts(F.min("__first")).alias("__t0"),
            F.min_by("rpm", "__first").alias("capacity"),
        )
    )
    none = F.lit(None).cast("bigint")
    if carried is None:
        starts = fresh.withColumns({"__kept_w": none, "__used": none})
    else:
        kept = carried.select(
            "bucket", F.col("first_ms").alias("__kept_t0"), F.col("capacity").alias("__kept_cap"),
            F.col("window_start_ms").alias("__kept_w"), F.col("used").alias("__used"),
        )
        starts = fresh.join(kept, "bucket", "left").select(
            "bucket",
            F.coalesce("__kept_t0", "__t0").alias("__t0"),
            F.coalesce("__kept_cap", "capacity").alias("capacity"),
            "__kept_w",
            "__used",
        )
    # A bucket, and requests without one, may hold most of the rows: the small side is repeated.
    anchored = salted_join(requests, starts, ["bucket"], [row_id])
    # Requests outside any bucket ride along on plain time windows, so they stay spread too.
    since = F.coalesce(F.col(ts_ms) - F.col("__t0"), F.col(ts_ms))
    keyed = anchored.withColumns(
        {
            "__b": F.coalesce(F.col("bucket"), F.lit("")),
            "__w": F.coalesce(F.floor(since / window_ms), F.lit(0)),
        }
    )
    inside = F.coalesce(F.pmod(since, F.lit(window_ms)), F.lit(0))
    ranked = sliced_row_number(
        keyed,
        ["__b", "__w"],
        [ts_ms, row_id],
        F.coalesce(time_slice(inside, slice_ms), F.lit(0)),
        "__rank",
    )
    start = F.col("__t0") + F.col("__w") * window_ms
    before = F.when(start == F.col("__kept_w"), F.col("__used")).otherwise(0)
    return ranked.withColumns(
        {
            "window_start_ms": start,
            "first_ms": F.col("__t0"),
            "place": F.when(F.col("bucket").isNotNull(), F.col("__rank") + before),
            "late": F.coalesce(start < F.col("__kept_w"), F.lit(False)),
        }
    ).drop("__b", "__w", "__rank", "__t0", "__kept_w", "__used")


def decide(placed: DataFrame, window_ms: int = WINDOW_MS, ts_ms: str = "ts_ms") -> DataFrame:
    """Add ``allowed, retry_after_ms, reason, rule_desc`` to placed requests."""
    zero = F.coalesce(F.col("rpm") == 0, F.lit(False))
    # A late request's window is over and its count is gone: it doesn't pass.
    late = F.col("late") & ~zero
    over = F.coalesce(F.col("place") > F.col("capacity"), F.lit(False)) | late
    wait = F.col("window_start_ms") + window_ms - F.col(ts_ms)
    return placed.withColumns(
        {
            "allowed": ~(zero | over),
            "retry_after_ms": F.when(zero, F.lit(ZERO_QUOTA_RETRY_MS))
            .when(over, F.greatest(F.lit(1), wait))
            .otherwise(F.lit(0))
            .cast("bigint"),
            "reason": F.when(zero, "quota_zero").when(late, "late").when(over, "rate_limited"),
            "rule_desc": F.when(
                zero | over, rule_text("rule_user", "rule_group", "rule_model", "rpm")
            ),
        }
    )


def rate_limit(
    requests: DataFrame,
    window_ms: int = WINDOW_MS,
    slice_ms: int | None = None,
    ts_ms: str = "ts_ms",
    row_id: str = "request_id",
) -> DataFrame:
    """Decide every request matched by :func:`match_quota_rule`.

    The first ``rpm`` requests of a bucket's window pass.
    """
    placed = rank_requests(requests, window_ms, slice_ms, ts_ms, row_id)
    return decide(placed, window_ms, ts_ms).drop(
        "window_start_ms", "first_ms", "place", "capacity", "late"
    )


def carry_buckets(placed: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """State for the next batch: each bucket's newest window and the requests seen in it."""
    keys = ["bucket", "first_ms", "capacity"]
    seen = (
        placed.filter(F.col("bucket").isNotNull() & ~F.col("late"))
        .groupBy(*keys, "window_start_ms")
        .agg(F.max("place").alias("used"))
    )
    if carried is not None:
        seen = seen.unionByName(carried.select(*keys, "window_start_ms", "used"))
    # The newest window wins; within it the batch's count already includes the carried one.
    newest = F.max(F.struct("window_start_ms", "used")).alias("n")
    return seen.groupBy(*keys).agg(newest).select(*keys, "n.window_start_ms", "n.used")


def quota_decisions(
    requests: DataFrame, rules: DataFrame, window_ms: int = WINDOW_MS, version: str | None = None,
    slice_ms: int | None = None,
) -> DataFrame:
    """Match and limit in one call."""
    matched = match_quota_rule(requests, rules, version=version)
    return rate_limit(matched, window_ms=window_ms, slice_ms=slice_ms)


def rules_asof(
    requests: DataFrame,
    versions: DataFrame,
    ts_ms: str = "ts_ms",
    slice_ms: int = 3_600_000,
    row_id: str = "request_id",
) -> DataFrame:
    """Add ``version``: the latest valid rule document at request time, null before the first.

    ``versions`` holds (version, valid_from_ms) of the *valid* documents only; of equal times the
    larger version wins. Versions are carried forward along the merged time order, in ``SALTS``
    strands of requests with a copy of the versions each, so no request meets more than one.
    """
    newest = versions.groupBy("valid_from_ms").agg(F.max("version").alias("version"))
    marks = newest.select(
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__strand"),
        F.col("valid_from_ms").alias("__at"),
        F.lit(0).cast("bigint").alias("__id"),
        "version",
    )
    points = requests.select(
        salted([row_id]).alias("__strand"),
        F.col(ts_ms).alias("__at"),
        F.lit(True).alias("inclusive"),
        F.struct(*requests.columns).alias("__q"),
    )
    found = asof_last(
        marks, points, ["__strand"], ["version"], ts_ms="__at", row_id="__id", slice_ms=slice_ms
    )
    return found.select("__q.*", "version")

"""Deployment specs: replica allocation, variants, status and demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.functions.load import kubernetes_resource, yarn_resource
from servelens.operators.skew import sliced_lag, time_slice

# Phases, conditions and event reasons.
READY, RECONCILING, FAILED = "Ready", "Reconciling", "Failed"
INVALID_SPEC = "InvalidSpec"
INVALID_SPEC_TEXT = "spec.image and spec.modelRepository are required"


def is_invalid(image: str = "image", repository: str = "model_repository") -> Column:
    return (F.coalesce(F.length(image), F.lit(0)) == 0) | (
        F.coalesce(F.length(repository), F.lit(0)) == 0
    )


def allocate_replicas(deployments: DataFrame, key: str = "name") -> DataFrame:
    """(key, pos, variant, weight, replicas) per variant of the ``traffic`` array.

    Largest remainder with floor; an active variant gets at least one, leftovers go one each by
    remainder, then list order. All weights zero or null: one each. The shares are worked out on
    the array inside its row, so no variant is shuffled.
    """
    zero = F.lit(0).cast("bigint")
    total = F.aggregate("__w", zero, lambda a, w: a + w)
    weighed = deployments.select(
        key,
        "traffic",
        F.col("replicas").alias("__n"),
        F.transform(
            "traffic", lambda v: F.greatest(F.coalesce(v["weight"], F.lit(0)), F.lit(0))
        ).alias("__w"),
    ).withColumn("__total", total)
    exact = lambda w: w.cast("double") * F.col("__n") / F.nullif(F.col("__total"), F.lit(0))
    shared = weighed.withColumn(
        "__floors",
        F.transform(
            "__w",
            lambda w: F.greatest(F.floor(exact(w)), F.when(w > 0, 1).otherwise(0)),
        ),
    ).withColumn("__left", F.col("__n") - F.aggregate("__floors", zero, lambda a, f: a + f))
    # Active positions by falling remainder, then position; inactive ones sort behind them.
    ranked = shared.withColumn(
        "__order",
        F.when(
            F.col("__left") > 0,
            F.array_sort(
                F.transform(
                    "__w",
                    lambda w, i: F.struct(
                        (w == 0).alias("off"), (F.floor(exact(w)) - exact(w)).alias("rem"), i.alias("pos")
                    ),
                )
            ),
        ),
    )
    winners = F.transform(
        F.slice("__order", F.lit(1), F.greatest(F.col("__left"), F.lit(0)).cast("int")),
        lambda x: F.when(~x["off"], x["pos"]),
    )
    # The outer form keeps the optimiser from testing (and so parsing) the array a second time.
    exploded = ranked.withColumn("__winners", winners).select(
        key, "__total", "__floors", "__winners", F.posexplode_outer("traffic").alias("pos", "v")
    ).filter(F.col("pos").isNotNull())
    extra = F.coalesce(F.array_contains("__winners", F.col("pos")), F.lit(False))
    return exploded.select(
        key,
        "pos",
        F.col("v.name").alias("variant"),
        F.col("v.weight").alias("weight"),
        F.when(F.col("__total") == 0, 1)
        .otherwise(F.get("__floors", F.col("pos")) + extra.cast("int"))
        .cast("int")
        .alias("replicas"),
    )


def effective_variants(deployments: DataFrame) -> DataFrame:
    """Variants with their own image / repository where set, else the deployment's."""
    own = lambda field, base: F.coalesce(
        F.nullif(F.col(f"v.{field}"), F.lit("")), F.col(base)
    )
    return deployments.select(
        "name", "image", "model_repository", F.posexplode_outer("traffic").alias("pos", "v")
    ).filter(F.col("pos").isNotNull()).select(
        "name",
        "pos",
        F.col("v.name").alias("variant"),
        F.concat_ws("-", "name", "v.name").alias("deployment_name"),
        own("image", "image").alias("image"),
        own("model_repository", "model_repository").alias("model_repository"),
    )


def stale_variants(deployments: DataFrame, running: DataFrame) -> DataFrame:
    """Running (name, variant) rows that the spec no longer wants.

    All of a deployment that is gone is stale. A labelled variant is stale unless the spec lists it; the unlabelled single deployment is
    stale once the spec has variants.
    """
    listed = deployments.select(
        "name", F.transform("traffic", lambda v: v["name"]).alias("__names"), F.lit(True).alias("__found")
    )
    names = F.coalesce("__names", F.array().cast("array<string>"))
    stale = F.when(F.col("variant").isNull(), F.size(names) > 0).otherwise(
        ~F.coalesce(F.array_contains(names, F.col("variant")), F.lit(False))
    )
    gone = F.col("__found").isNull()
    return running.join(listed, "name", "left").filter(gone | stale).drop("__names", "__found")


def deployment_status(deployments: DataFrame, pods: DataFrame) -> DataFrame:
    """Phase and condition per deployment from ready replicas summed over its variants."""
    ready = pods.groupBy("name").agg(F.sum("ready_replicas").alias("ready"))
    invalid = is_invalid()
    r = F.coalesce("ready", F.lit(0))
    full = (r >= F.col("replicas")) & (F.col("replicas") > 0)
    counted = F.concat(
        r.cast("string"), F.lit("/"), F.col("replicas").cast("string"), F.lit(" replicas ready")
    )
    return deployments.join(ready, "name", "left").select(
        "name",
        F.col("replicas").alias("target_replicas"),
        F.when(~invalid, r).alias("ready_replicas"),
        F.when(invalid, FAILED).when(full, READY).otherwise(RECONCILING).alias("phase"),
        F.when(invalid, INVALID_SPEC)
        .when(full, "DeploymentReady")
        .otherwise("WaitingForReplicas")
        .alias("reason"),
        F.when(invalid, INVALID_SPEC_TEXT).otherwise(counted).alias("message"),
    )


def accelerators_per_replica() -> Column:
    count = F.coalesce("accelerator_count", F.lit(1))
    return F.greatest(
        F.lit(1), count * F.col("tensor_parallelism") * F.col("pipeline_parallelism")
    )


def with_accelerator(deployments: DataFrame) -> DataFrame:
    return deployments.withColumns(
        {
            "kubernetes_resource": kubernetes_resource("accelerator_type"),
            "yarn_resource": yarn_resource("accelerator_type"),
        }
    )


def capacity_demand(deployments: DataFrame) -> DataFrame:
    """Accelerators wanted per resource: per replica times replicas; cpu-only asks for none.

    ``yarn_units`` is the launcher's form, which takes parallelism only.
    """
    yarn_each = F.greatest(
        F.lit(1), F.col("tensor_parallelism") * F.col("pipeline_parallelism")
    )
    return (
        with_accelerator(deployments)
        .filter(F.col("kubernetes_resource").isNotNull())
        .groupBy(F.col("kubernetes_resource").alias("resource"))
        .agg(
            F.sum(accelerators_per_replica() * F.col("replicas")).alias("units"),
            F.sum(yarn_each * F.col("replicas")).alias("yarn_units"),
            F.count(F.lit(1)).alias("deployments"),
        )
    )


def phase_transitions(history: DataFrame, slice_ms: int = 86_400_000) -> DataFrame:
    """Events for phase changes in (name, ts_ms, seq, phase).

    ``Ready`` is reported whenever the previous phase differs or there is none, ``Reconciling``
    only after a different previous phase, a failed spec every time.
    """
    prev = sliced_lag(
        history, ["name"], ["ts_ms", "seq"], time_slice("ts_ms", slice_ms), {"phase": "previous"}
    )
    changed = ~F.col("phase").eqNullSafe(F.col("previous"))
    emit = (
        (F.col("phase") == FAILED)
        | ((F.col("phase") == READY) & changed)
        | ((F.col("phase") == RECONCILING) & changed & F.col("previous").isNotNull())
    )
    return prev.filter(emit).select(
        "name",
        "ts_ms",
        "seq",
        "previous",
        "phase",
        F.when(F.col("phase") == FAILED, "Warning").otherwise("Normal").alias("event_type"),
        F.when(F.col("phase") == FAILED, INVALID_SPEC).otherwise(F.col("phase")).alias("reason"),
    )

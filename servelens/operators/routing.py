"""Container choice from queue depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from servelens.operators.skew import order_key

TICK_MS = 15_000
# Ticks lie within 2**LEVELS of 0; END is the far end of a reading that holds on.
LEVELS = 44
END = (1 << LEVELS) - 1


def tick_of(col: str, tick_ms: int):
    return F.floor(F.col(col) / F.lit(tick_ms)).cast("bigint")


def _enclosing(first: Column, last: Column) -> Column:
    """The largest aligned blocks of ticks that make up [first, last], as (level, number).

    At each level the blocks inside are ``low..high``; those whose parent isn't inside, too, are an
    odd first and an even last one. So a long span gives a few blocks, two for each level at most.
    """

    def blocks(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", last + 1, k) - 1
        inside = low <= high
        return F.array_compact(
            F.array(
                F.when(inside & (low % 2 != 0), F.struct(k.alias("level"), low.alias("number"))),
                F.when(inside & (high % 2 == 0), F.struct(k.alias("level"), high.alias("number"))),
            )
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), blocks))


def tick_routes(
    depth: DataFrame, roster: DataFrame, ticks: DataFrame, tick_ms: int = TICK_MS
) -> DataFrame:
    """Best container for each row of ``ticks(tick)``: smallest depth, then host, then list position.

    A depth read during one tick is in force from the next tick on until the next reading; a
    container without a reading so far counts as empty. ``roster`` holds (container_id, host, ord).
    The span of each reading is put down under a few aligned blocks of ticks, and a tick looks at
    the blocks around it, so nothing is formed per container and tick.
    """
    readings = (
        depth.groupBy("container_id", (tick_of("ts_ms", tick_ms) + 1).alias("tick"))
        .agg(F.max_by("depth", order_key("ts_ms", "event_id")).alias("depth"))
    )
    before = roster.select("container_id", F.lit(-END).alias("tick"), F.lit(0).alias("depth"))
    series = W.partitionBy("container_id").orderBy("tick")
    held = readings.unionByName(before).withColumn(
        "until", F.coalesce(F.lead("tick").over(series) - 1, F.lit(END))
    )
    best = F.min(F.struct("depth", "host", "ord", "container_id")).alias("best")
    blocks = (
        held.join(roster, "container_id")
        .withColumn("block", F.explode(_enclosing(F.col("tick"), F.col("until"))))
        .groupBy("block.level", "block.number")
        .agg(best)
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    around = ticks.select("tick").distinct().withColumn("level", level).withColumn(
        "number", F.call_function("shiftright", F.col("tick"), F.col("level"))
    )
    return (
        around.join(blocks, ["level", "number"])
        .groupBy("tick")
        .agg(F.min("best").alias("best"))
        .select("tick", F.col("best.container_id").alias("routed_container"),
                F.col("best.host").alias("routed_host"), F.col("best.depth").alias("routed_depth"))
    )


def route_least_loaded(
    requests: DataFrame,
    depth: DataFrame,
    roster: DataFrame,
    tick_ms: int = TICK_MS,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Add the container each request goes to, null when the roster is empty.

    ``ticks`` (ts_ms) names the times that occur where ``requests`` is costly to compute twice.
    """
    times = requests if ticks is None else ticks
    routes = tick_routes(
        depth, roster, times.select(tick_of("ts_ms", tick_ms).alias("tick")), tick_ms
    )
    return (
        requests.withColumn("tick", tick_of("ts_ms", tick_ms))
        .join(routes, "tick", "left")
        .drop("tick")
    )


def drain_candidate(depth: DataFrame, roster: DataFrame) -> DataFrame:
    """Per deployment, the running container with the smallest depth; ties go to list order."""
    latest = depth.groupBy("container_id").agg(
        F.max_by("depth", order_key("ts_ms", "event_id")).alias("depth")
    )
    return (
        roster.join(latest, "container_id", "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
        .groupBy("deployment")
        .agg(F.min(F.struct("depth", "ord", "container_id")).alias("best"))
        .select("deployment", F.col("best.container_id").alias("container_id"),
                F.col("best.depth").alias("depth"))
    )

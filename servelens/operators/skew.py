"""Building blocks that stay balanced when one key holds a large share of the rows.

Each gives exactly the answer of the plain window or join it replaces. Work on a hot key is
spread over time slices, hash salts or value bins, and only per-slice summaries meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 32
ID_RANGE = Decimal(10**20)
ID_SHIFT = Decimal(2**63)


def order_key(ts_ms: Column | str, row_id: Column | str) -> Column:
    """(ts_ms, row_id) packed in one decimal, so min/max/max_by stay in hash aggregation.

    A struct buffer would force a sort before the map-side combine. Ids are shifted to be positive,
    so negative ones (half of all hash ids) keep their place inside their millisecond.
    """
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return ts.cast("decimal(15,0)") * F.lit(ID_RANGE) + (
        rid.cast("decimal(19,0)") + F.lit(ID_SHIFT)
    )


def order_key_ts(key: Column) -> Column:
    return F.floor(key / F.lit(ID_RANGE)).cast("bigint")


def group_key(keys: Sequence[str]) -> Column:
    """The keys as one struct. Null fields of structs are equal to each other, so windows, groupings
    and joins on it agree on rows with null keys, and share a hash partitioning."""
    return F.struct(*[F.col(k) for k in keys])


def time_slice(ts_ms: Column | str, slice_ms: int) -> Column:
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.floor(ts / F.lit(slice_ms)).cast("bigint")


def salted(row_id: Sequence[str], salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")


def sliced_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column, out: str
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without gathering a key.

    ``slice_col`` must not decrease along ``order``; null keys are keys. Rows are ranked inside
    (keys, slice) and shifted by the number of rows in earlier slices. The ranking window
    and the join share one hash partitioning, so the rows are shuffled once.
    """
    parts = ["__key", "__slice"]
    sliced = df.withColumns({"__key": group_key(keys), "__slice": slice_col})
    earlier = W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .drop("__n")
    )
    ranked = sliced.withColumn(
        "__rn", F.row_number().over(W.partitionBy(*parts).orderBy(*order))
    )
    return (
        ranked.join(offsets, parts)
        .withColumn(out, (F.col("__before") + F.col("__rn")).cast("bigint"))
        .drop("__key", "__slice", "__before", "__rn")
    )


def sliced_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    values: dict[str, str],
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` for each {value: output name}.

    ``order`` is a time in milliseconds, alone or with an id. Only the last row of every (keys,
    slice) travels to the neighbour slice; null keys are keys.
    """
    parts = ["__key", "__slice"]
    sliced = df.withColumns({"__key": group_key(keys), "__slice": slice_col})
    inner = W.partitionBy(*parts).orderBy(*order)
    at = order_key(order[0], order[1] if len(order) > 1 else F.lit(0))
    last = sliced.groupBy(*parts).agg(
        *[F.max_by(v, at).alias(f"__last_{n}") for v, n in values.items()]
    )
    along = W.partitionBy("__key").orderBy("__slice")
    carried = last.select(
        *parts, *[F.lag(f"__last_{n}").over(along).alias(f"__carry_{n}") for n in values.values()]
    )
    lagged = sliced.withColumn("__first", F.row_number().over(inner) == 1)
    for value, name in values.items():
        lagged = lagged.withColumn(name, F.lag(value).over(inner))
    out = lagged.join(carried, parts)
    for value, name in values.items():
        carry = F.col(f"__carry_{name}")
        out = out.withColumn(name, F.when(F.col("__first"), carry).otherwise(F.col(name)))
    return out.drop("__key", "__slice", "__first", *[f"__carry_{n}" for n in values.values()])


def asof_last(
    marks: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    ts_ms: str = "ts_ms",
    row_id: str = "event_id",
    slice_ms: int = 3_600_000,
) -> DataFrame:
    """For each point (keys, ts_ms, inclusive, ...) the last non-null ``values`` of the marks
    (keys, ts_ms, row_id, values) before it; ``inclusive`` points also see marks of their own time.

    Marks and points are merged in time order and values carried forward, inside slices and then
    over one summary row per slice: no pair of a point and a mark is ever formed. Null keys are keys.
    """
    rest = [c for c in points.columns if c not in (*keys, ts_ms, "inclusive")]
    kinds = {v: marks.schema[v].dataType for v in values}
    no_point = F.lit(None).cast(points.select(F.struct(*rest).alias("p")).schema["p"].dataType)
    merged = (
        marks.select(
            *keys, ts_ms, F.lit(1).alias("__side"), F.col(row_id).alias("__id"), *values,
            no_point.alias("__point"),
        )
        .unionByName(
            points.select(
                *keys, ts_ms, F.when(F.col("inclusive"), 2).otherwise(0).alias("__side"),
                F.lit(0).cast("bigint").alias("__id"),
                *[F.lit(None).cast(k).alias(v) for v, k in kinds.items()],
                F.struct(*rest).alias("__point"),
            )
        )
        .withColumns({"__key": group_key(keys), "__slice": time_slice(ts_ms, slice_ms)})
    )
    parts = ["__key", "__slice"]
    at = order_key(ts_ms, "__id")
    summary = merged.groupBy(*parts).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values]
    )
    earlier = W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *parts, *[F.last(v, ignorenulls=True).over(earlier).alias(f"__c_{v}") for v in values]
    )
    inner = (
        W.partitionBy(*parts)
        .orderBy(ts_ms, "__side", "__id")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    held = merged.withColumns(
        {f"__h_{v}": F.last(v, ignorenulls=True).over(inner) for v in values}
    ).filter(F.col("__side") != 1)
    return held.join(carried, parts).select(
        *keys,
        ts_ms,
        *[F.col(f"__point.{c}").alias(c) for c in rest],
        *[F.coalesce(f"__h_{v}", f"__c_{v}").alias(v) for v in values],
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """``left`` with the columns of ``right`` (at most one row per ``keys``, much smaller) or nulls.

    Rows of a key are spread over ``salts`` tasks by ``row_id`` and ``right`` is repeated for each;
    null keys are keys.
    """
    rest = [c for c in right.columns if c not in keys]
    small = right.select(
        group_key(keys).alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), *rest
    )
    keyed = left.withColumns({"__key": group_key(keys), "__salt": salted(row_id, salts)})
    return keyed.join(small, ["__key", "__salt"], "left").drop("__key", "__salt")


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, row_id: Sequence[str]
) -> DataFrame:
    """First ``n`` rows per key. A salted pass keeps at most ``n`` rows per (key, salt), so the
    final pass sees at most ``n * SALTS`` rows of a key; both are pruned before their shuffle."""
    first = W.partitionBy(*keys, "__salt").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", salted(row_id))
        .withColumn("__rn", F.row_number().over(first))
        .filter(F.col("__rn") <= n)
        .drop("__salt", "__rn")
        .withColumn("__rn", F.row_number().over(final))
        .filter(F.col("__rn") <= n)
        .drop("__rn")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    totals: tuple[str, str] | None = None,
) -> DataFrame:
    """Nearest-rank quantiles of a non-negative integer column, one column per entry of ``probs``;
    with ``totals`` also the number of values and their sum under these names.

    Rows are combined to counts per (key, value) before the shuffle. A first pass finds the
    logarithmic bin each rank falls in, a second orders only the distinct values of that bin.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group_key(keys).alias("__key"), value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bin", F.floor(F.log2(F.col(value) + 1) * 32).cast("int"))
    )
    running = W.partitionBy("__key").orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("__key")
    prob_rows = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in probs.items()]
    )
    bins = (
        counts.groupBy("__key", "__bin")
        .agg(F.sum("__n").alias("__bn"), F.sum(F.col("__n") * F.col(value)).alias("__bs"))
        .withColumn("__cum", F.sum("__bn").over(running))
        .withColumn("__total", F.sum("__bn").over(whole))
        .withColumn("__sum", F.sum("__bs").over(whole))
        .withColumn("__q", F.explode(prob_rows))
        .withColumn(
            "__rank",
            F.greatest(F.lit(1), F.ceil(F.col("__q.p") * F.col("__total"))).cast("bigint"),
        )
        .filter(
            (F.col("__cum") >= F.col("__rank"))
            & (F.col("__cum") - F.col("__bn") < F.col("__rank"))
        )
        .select(
            "__key",
            "__bin",
            F.col("__q.name").alias("__name"),
            (F.col("__rank") - (F.col("__cum") - F.col("__bn"))).alias("__need"),
            "__total",
            "__sum",
        )
    )
    inside = W.partitionBy("__key", "__bin", "__name").orderBy(value).rowsBetween(
        W.unboundedPreceding, 0
    )
    picked = (
        counts.join(bins, ["__key", "__bin"])
        .withColumn("__run", F.sum("__n").over(inside))
        .filter(F.col("__run") >= F.col("__need"))
    )
    out = picked.groupBy("__key").agg(
        *[F.min(F.when(F.col("__name") == n, F.col(value))).alias(n) for n in probs],
        F.first("__total").alias("__total"),
        F.first("__sum").alias("__sum"),
    )
    # Number and sum of the values come with the bins, so nothing is read again for them.
    more = [] if totals is None else [
        F.col("__total").alias(totals[0]), F.col("__sum").alias(totals[1])
    ]
    return out.select(*[F.col("__key")[k].alias(k) for k in keys], *more, *probs)

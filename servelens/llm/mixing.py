"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Shares of a word budget go to the sources by weight; no source gets more than ``max_epochs`` times
its size, and what it can't take goes to the others by weight. With the sources in the order of
cap / weight, those that stop at their cap come first, so the common level of the others follows
from running sums (:func:`targets`). Inside a source every document is taken whole as often as the
target goes into the source's size; the rest of the target is filled in the order of a seeded hash
of the doc_id, so that a source's words come out exact but for rounding. Only per-source and
per-slice sums are shuffled, never texts. The per-source table is written first, so that Spark knows its size when it
chooses how to join it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelens.llm.common import WORD, pick
from servelens.session import stage

WEIGHTS = (3, 1, 2)
#: Hex digits of the hash that make a slice: 4096 slices for each source.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, seed: int) -> Column:
    """Seeded order of documents; rows of the same doc_id share a place."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """Add weight and target to ``sizes(source, source_size)``, one row per source.

    The window without a partition holds one row per source, no documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("turn", F.row_number().over(by_ratio))
        .withColumn("free", F.col("ratio") > F.col("level"))
        # The first source that isn't stopped by its cap sets the level of all behind it.
        .withColumn(
            "common", F.min(F.when(F.col("free"), F.struct("turn", "level"))).over(everything)
        )
    )
    return leveled.select(
        "source",
        "source_size",
        "weight",
        F.least("cap", F.coalesce(F.col("common.level") * F.col("weight"), F.col("cap"))).alias(
            "target"
        ),
    )


def mix(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``df(doc_id, text, source)``: doc_id, size (words), source_size, target
    and taken (words that the mix takes from it, repeats counted).

    A null text has size 0; null is a source of its own, the last one. Rows with the same doc_id in
    one source share their place in the order: at the border each gets the same fraction, rounded
    down. Taken words of a source are below its target by less than one word for each such row. An
    empty table gives no rows. The same input and seed always give the same result.
    """
    docs = pick(df, "doc_id", "text", "source").select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        order_hash(F.col("doc_id"), seed).alias("place"),
    )
    border = stage(borders(docs, weights, share, max_epochs), "mix")
    return docs.join(border, docs["source"].eqNullSafe(border["_source"]), "left").select(
        "doc_id", "size", "source_size", "target", taken().alias("taken")
    )


def taken() -> Column:
    """Words to take of a row with size and place, given its source's row of :func:`borders`."""
    size, place = F.col("size"), F.col("place")
    part = (
        F.when(place < F.col("border"), size)
        .when(place == F.col("border"), F.expr("size * remainder div border_size"))
        .otherwise(0)
    )
    return (size * F.col("epochs") + F.coalesce(part, F.lit(0))).cast("long")


def borders(
    docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float
) -> DataFrame:
    """Per source: whole epochs, and the place up to which one more repetition goes.

    ``docs(doc_id, source, size, place)``. The border is found in the slice of the hash where the
    running sum of slices passes the remainder, so a large source is summed in many tasks.
    """
    slices = docs.groupBy("source", F.substring("place", 1, SLICE_DIGITS).alias("slice")).agg(
        F.sum("size").alias("slice_size")
    )
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    goal = targets(sizes, weights, share, max_epochs)
    goal = goal.withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    ).withColumn(
        "rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    )
    running = Window.partitionBy("source").orderBy("slice")
    before = slices.withColumn(
        "before", F.sum("slice_size").over(running) - F.col("slice_size")
    ).withColumnRenamed("source", "_s")
    at = (
        goal.join(before, goal["source"].eqNullSafe(before["_s"]))
        .where("rest > before and rest <= before + slice_size")
        .select("_s", F.col("slice").alias("_slice"), "before", "rest")
    )
    near = (
        docs.withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
        .join(at, docs["source"].eqNullSafe(at["_s"]) & (F.col("slice") == F.col("_slice")))
        .groupBy("_s", "place", "before", "rest")
        .agg(F.sum("size").alias("place_size"))
    )
    running = Window.partitionBy("_s").orderBy("place")
    last = (
        near.withColumn("passed", F.col("before") + F.sum("place_size").over(running))
        .withColumn("remainder", F.col("rest") - (F.col("passed") - F.col("place_size")))
        .where("remainder > 0 and rest <= passed")
        .select("_s", F.col("place").alias("border"), "remainder", F.col("place_size").alias("border_size"))
    )
    return goal.join(last, goal["source"].eqNullSafe(last["_s"]), "left").select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        "epochs",
        "border",
        "remainder",
        "border_size",
    )


def mix_documents(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, all columns as they are.

    Documents stay whole: one that is taken in part at a source's border is repeated once more if
    at least half of it is taken. Texts without words are taken by the same order.
    """
    here = df.columns
    names = [f"_{i}" for i in range(len(here))]
    bare = df.toDF(*names)
    docs = pick(df, "doc_id", "text", "source").select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        order_hash(F.col("doc_id"), seed).alias("place"),
    )
    border = stage(borders(docs, weights, share, max_epochs), "mix")
    key = {n: bare[f"_{here.index(n)}"] for n in ("doc_id", "text", "source")}
    again = (
        F.when(F.col("place") < F.col("border"), 1)
        .when(
            F.col("place") == F.col("border"),
            (2 * F.col("remainder") >= F.col("border_size")).cast("int"),
        )
        .otherwise(0)
    )
    return (
        bare.withColumn("place", order_hash(key["doc_id"], seed))
        .join(border, key["source"].eqNullSafe(border["_source"]), "left")
        .withColumn("copies", F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(again, F.lit(0)))
        .where("copies > 0")
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select(*names)
        .toDF(*here)
    )

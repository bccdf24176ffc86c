"""Model inventories over time: listings kept as bucketed tables, and what changed between them.

A snapshot is written once, in buckets of the path and sorted by it. A later listing is dealt to the same
buckets, so a comparison shuffles the new listing alone; two snapshots are compared without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servelens.session import shared_dir
from servelens.sources.telemetry import model_files

BUCKETS = 64


def keep_snapshot(files: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write ``files(path, length, modified)`` as the table ``name``, in the shared folder unless ``path``
    says otherwise. A name is used once; paths without a name are left out. The number of buckets is
    that of all snapshots which are compared with each other: choose it by the largest."""
    spark = files.sparkSession
    rows = files.where("path is not null").select("path", "length", "modified")
    (
        rows.repartition(buckets, "path")
        .write.bucketBy(buckets, "path")
        .sortBy("path")
        .option("path", path or shared_dir(spark, f"snapshot-{name}"))
        .saveAsTable(name)
    )
    return spark.table(name)


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, bytes_before, bytes_after) of the files that were added, removed or changed (another
    length or time); paths are unique in a listing."""
    old = before.select("path", F.struct("length", "modified").alias("__old"))
    new = after.where("path is not null").select("path", F.struct("length", "modified").alias("__new"))
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    )
    joined = old.join(new, "path", "full_outer").withColumn("change", change)
    return joined.where("change is not null").select(
        "path", "change", F.col("__old.length").alias("bytes_before"), F.col("__new.length").alias("bytes_after")
    )


def model_changes(before: DataFrame, after: DataFrame, root: str) -> DataFrame:
    """Per model below the root that differs: added, removed or changed, with the number of its files of
    each kind and by how many bytes it has grown.

    A model is added if the first listing has no file of it, and removed if the second has none.
    """
    differs = model_files(file_changes(before, after), root).where("model is not null")
    grown = F.coalesce("bytes_after", F.lit(0)) - F.coalesce("bytes_before", F.lit(0))
    counted = differs.groupBy("model").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")],
        F.sum(grown).alias("bytes_grown"),
    )
    # One row for each model, from narrow columns.
    whole = lambda files: model_files(files, root).select("model").where("model is not null").distinct()
    was = whole(before).withColumn("__was", F.lit(True))
    now = whole(after).withColumn("__now", F.lit(True))
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__now").isNull(), "removed").otherwise("changed")
    return (
        counted.join(was, "model", "left")
        .join(now, "model", "left")
        .select(
            "model",
            change.alias("change"),
            *[F.col(c).alias(f"files_{c}") for c in ("added", "removed", "changed")],
            "bytes_grown",
        )
    )


def drop_snapshot(spark: SparkSession, name: str) -> None:
    """Forget a snapshot; its files go with the folder that holds them."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")

"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servelens.session import discard, shared_dir

#: Most rows (of two numbers) that are broadcast.
BROADCAST_ROWS = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def large_star(edges: DataFrame, path: str) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours.

    Nothing changes for the neighbours of a node without a smaller one, so those (the roots, which
    have most edges) are only looked up among the nodes that do have one. That table is written
    to ``path`` first: where it is small, as in all late rounds, it is broadcast and the edges aren't shuffled.
    """
    spark = edges.sparkSession
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = down.select(F.col("v").alias("u")).distinct()
    least.join(ends, "u").select(F.col("u").alias("v"), "m").write.parquet(path)
    moved = spark.read.schema("v long, m long").parquet(path)
    if moved.count() <= BROADCAST_ROWS:
        moved = F.broadcast(moved)
    return down.join(moved, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # A node with many smaller neighbours is rare: roots, which have most edges, have none.
    near = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return near.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(u long, v long)`` but the roots themselves; a root is
    the smallest node of its component.

    Each round is written to the shared folder, so a lost executor costs one round at most; the one
    before is removed then. Rounds grow with the logarithm of the longest path. A null end or a loop
    is no edge.
    """
    spark = edges.sparkSession

    def written(rows: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = shared_dir(spark, label)
        rows.write.parquet(path)
        table = spark.read.schema("u long, v long").parquet(path)
        return table, path, _state(table)

    now, path, state = written(edges.select("u", "v").where("u != v").distinct())
    while True:
        old_path, old_state, moved = path, state, shared_dir(spark, f"{label}-moved")
        now, path, state = written(small_star(large_star(now, moved).where("u != v").distinct()).distinct())
        discard(spark, old_path)
        discard(spark, moved)
        if state == old_state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""A roster kept as a table of changes.

Every trigger writes the containers that changed, and nothing else, as one more set of rows. When the
changes since the last snapshot come to half of its rows, they are folded into a new one, so all
that is written stays in proportion to the changes. Containers that have left are dropped from a
snapshot once their last event is older than the time to live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servelens.operators.skew import order_key
from servelens.streaming.keyed import CHANGES

#: Fewest changes that are worth a snapshot.
LEAST_CHANGES = 1000


class RosterTable:
    """``foreachBatch`` target for ``keyed.roster_changes``, in update mode, and the table it keeps.

    A trigger that is replayed after a failure writes the same rows under the same epoch again; a
    snapshot counts only once it is complete, and what it replaces is removed one snapshot later.
    """

    def __init__(self, root: str, ttl_ms: int | None = None, least_changes: int = LEAST_CHANGES):
        self.root, self.ttl_ms, self.least_changes = root.rstrip("/"), ttl_ms, least_changes

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.select(*[c.split()[0] for c in CHANGES.split(", ")]).write.mode("overwrite").parquet(
            f"{self.root}/changes/epoch={epoch}"
        )
        # A replayed epoch may find the snapshot that it made itself before.
        since = max((e for e in self._snapshots(spark) if e < epoch), default=-1)
        held = self._read(spark, f"snapshots/epoch={since}").count() if since >= 0 else 0
        if self._changes(spark, since, epoch).count() >= max(self.least_changes, held / 2):
            self._fold(spark, since, epoch)

    def _epochs(self, spark: SparkSession, kind: str) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        # Only what its writer has finished counts.
        done = spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName()[6:]) for p in found if files.exists(done(p, "_SUCCESS")))

    def _snapshots(self, spark: SparkSession) -> list[int]:
        return self._epochs(spark, "snapshots")

    def _read(self, spark: SparkSession, *names: str) -> DataFrame:
        return spark.read.schema(CHANGES).parquet(*[f"{self.root}/{n}" for n in names])

    def _changes(self, spark: SparkSession, after: int, until: int | None = None) -> DataFrame | None:
        epochs = [e for e in self._epochs(spark, "changes") if e > after and (until is None or e <= until)]
        return self._read(spark, *[f"changes/epoch={e}" for e in epochs]) if epochs else None

    def _latest(self, spark: SparkSession, since: int, until: int | None = None) -> DataFrame:
        """The newest row of each container over a snapshot and the changes after it."""
        parts = [self._read(spark, f"snapshots/epoch={since}")] if since >= 0 else []
        changes = self._changes(spark, since, until)
        parts += [changes] if changes is not None else []
        if not parts:
            return spark.createDataFrame([], CHANGES)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        at = order_key("order_ms", "order_id")
        values = ("event", "since_ms", "order_ms", "order_id")
        newest = rows.groupBy(F.struct("container_id", "host").alias("key")).agg(
            *[F.max_by(v, at).alias(v) for v in values]
        )
        return newest.select("key.*", *values)

    def _fold(self, spark: SparkSession, since: int, epoch: int) -> None:
        rows = self._latest(spark, since, epoch)
        if self.ttl_ms is not None:
            # Event time goes by the newest change, which a snapshot always keeps or is newer than.
            newest = self._changes(spark, since, epoch).agg(F.max("since_ms")).first()[0]
            gone = (F.col("event") != "registered") & (F.col("since_ms") + self.ttl_ms <= newest)
            rows = rows.where(~gone)
        rows.write.mode("overwrite").parquet(f"{self.root}/snapshots/epoch={epoch}")
        for old in self._snapshots(spark):
            if old < since:
                self._remove(spark, f"snapshots/epoch={old}")
        for old in self._epochs(spark, "changes"):
            if old <= since:
                self._remove(spark, f"changes/epoch={old}")

    def _remove(self, spark: SparkSession, name: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def read(self, spark: SparkSession) -> DataFrame:
        """The live roster as of the last trigger: container_id, host, since_ms."""
        snapshot = self._snapshots(spark)
        rows = self._latest(spark, snapshot[-1] if snapshot else -1)
        return rows.where("event = 'registered'").select("container_id", "host", "since_ms")

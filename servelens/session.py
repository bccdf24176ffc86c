"""Session defaults. Every setting is one a cluster user could pass to spark-submit."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Keyed stream state lives off-heap and is checkpointed as a change log.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_store(spark: SparkSession) -> None:
    """Custom keyed state needs this store; set it on sessions that were built elsewhere."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def get_session(app: str = "servelens", master: str | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session; ``conf`` overrides the defaults.

    ``master`` stays unset on a cluster, where spark-submit names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **STATE_STORE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's functions with the jobs that use them.

    Needed where executors (or the stream driver's helper process) do not have it installed;
    with ``--py-files`` or an installed package it changes nothing.
    """
    cloudpickle.register_pickle_by_value(sys.modules["servelens"])


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    In local mode, where there is one machine only, a temporary folder takes its place if it is
    unset; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="servelens-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/servelens/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later plans start from a columnar table: costly parsing is done once, columns are pruned, and
    a lost executor costs a re-read instead of a recomputation.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of one's own below the shared folder that nothing reads any more."""
    if not path.startswith(f"{shared_root(spark)}/servelens/"):
        raise ValueError(f"not a table of the shared folder: {path}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

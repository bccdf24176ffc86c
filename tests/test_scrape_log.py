"""The scrape log's format: what is written is read, failed jobs leave nothing, a stream equals the batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from servelens.sources import scrape_log

ROWS = "host string, ts_ms long, line string"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    scrape_log.register(spark)


def write(df, path, mode="append"):
    df.write.format("scrape_log").mode(mode).save(str(path))


def read(spark, path):
    return spark.read.format("scrape_log").load(str(path))


def key(df):
    return sorted(map(str, df.select("host", "ts_ms", "metric", "line").collect()))


LINES = [
    ("h1", 5, 'nv_gpu_utilization{gpu="0"} 0.5'), ("h2", 6, "# HELP x y"), ("h1", 7, "up 1"), ("", -1, ""),
    ("h\t3", 8, "a\nb 2"), ("h1", 9, "é 🙂 1"), ("h1", 9, "nv_gpu_memory 3\twith tab"),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([*LINES, (None, 1, "x 1"), ("h", None, "x 1"), ("h", 1, None)], ROWS)
    write(df.repartition(3), tmp_path / "log")
    found = {(r.host, r.ts_ms, r.metric, r.line) for r in read(spark, tmp_path / "log").collect()}
    assert found == {
        ("h1", 5, "nv_gpu_utilization", LINES[0][2]), ("h2", 6, None, "# HELP x y"), ("h1", 7, "up", "up 1"), ("", -1, None, ""),
        ("h 3", 8, "a", "a b 2"), ("h1", 9, None, "é 🙂 1"), ("h1", 9, "nv_gpu_memory", LINES[6][2]),
    }
    write(df.limit(1), tmp_path / "log", "overwrite")
    assert read(spark, tmp_path / "log").count() == 1


def test_filters_are_handled_by_the_reader(spark, tmp_path):
    write(spark.createDataFrame(LINES, ROWS), tmp_path / "log")
    log = read(spark, tmp_path / "log")
    for condition, metrics in (
        (F.col("metric") == "up", {"up"}),
        (F.col("metric").isin("up", "a", "none"), {"up", "a"}),
        (F.col("metric").startswith("nv_gpu_"), {"nv_gpu_utilization", "nv_gpu_memory"}),
        ((F.col("metric") == "up") & (F.col("ts_ms") > 7), set()),
    ):
        assert {r.metric for r in log.where(condition).collect()} == metrics
    reader = scrape_log.LogReader(str(tmp_path / "log"))
    asked = [scrape_log.EqualTo(("metric",), "up"), scrape_log.EqualTo(("host",), "h1")]
    assert list(reader.pushFilters(asked)) == asked[1:]
    assert [r[3] for p in reader.partitions() for r in reader.read(p)] == ["up"]


def test_failed_jobs_leave_no_lines(spark, tmp_path):
    write(spark.createDataFrame(LINES[:2], ROWS), tmp_path / "log")
    before = key(read(spark, tmp_path / "log"))
    bad = spark.range(0, 4000, 1, 4).select(
        F.lit("h").alias("host"), F.col("id").alias("ts_ms"),
        F.when(F.col("id") == 3999, F.raise_error(F.lit("broken row"))).otherwise("up 1").alias("line"),
    )
    with pytest.raises(Exception, match="broken row|WRITE|abort"):
        write(bad, tmp_path / "log")
    assert key(read(spark, tmp_path / "log")) == before
    with pytest.raises(Exception, match="host, ts_ms and line"):
        write(spark.range(3).toDF("x"), tmp_path / "log")


def test_stream_equals_batch(spark, tmp_path):
    def run():
        started = (
            read_stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        started.awaitTermination(120)

    read_stream = spark.readStream.format("scrape_log").load(str(tmp_path / "log"))
    for part in (LINES[:3], LINES[3:5], LINES[5:]):
        write(spark.createDataFrame(part, ROWS).repartition(2), tmp_path / "log")
        run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert key(out) == key(read(spark, tmp_path / "log")) and out.count() == len(LINES)


def test_empty_log(spark, tmp_path):
    assert read(spark, tmp_path / "none").count() == 0
    write(spark.createDataFrame([], ROWS), tmp_path / "log")
    assert read(spark, tmp_path / "log").count() == 0

"""Scrape logs as a data source of their own: ``spark.read.format("scrape_log")``, and streams and writes.

A log is a folder of files whose lines are host, time in milliseconds and one line of metric text,
separated by tabs. A file is one partition. Filters on the metric's name are handled while reading, so
lines of other families never leave the reader. A task writes below ``_tasks``; the driver moves its
file into the log when all tasks are done and deletes it otherwise, so that failed tasks leave no
lines. File names grow with the time of their commit, which is what a stream goes by: let one job
write at a time.

Register it with :func:`register`. Files are opened by the schemes that pyarrow.fs knows.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "host string, ts_ms bigint, line_no int, metric string, line string"
SUFFIX = ".scrapes"
METRIC = re.compile(r"[A-Za-z_:][A-Za-z0-9_:]*")
READ = 1 << 20


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def _names(path: str) -> list[str]:
    """The log's files in the order of their commits."""
    files, root = _open(path)
    found = files.get_file_info(FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == FileType.File and f.base_name.endswith(SUFFIX))


@dataclass
class LogFile(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    """The file that a task has written below ``_tasks``; none if it had no rows."""

    task: str | None


def _lines(stream) -> Iterator[str]:
    """Lines of a file, of which a few pieces are in memory."""
    rest = b""
    while piece := stream.read(READ):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def _rows(path: str, name: str, wanted: Callable[[str | None], bool]) -> Iterator[tuple]:
    files, root = _open(path)
    with files.open_input_stream(f"{root}/{name}") as stream:
        for number, text in enumerate(_lines(stream)):
            host, _, rest = text.partition("\t")
            at, tab, line = rest.partition("\t")
            if not tab or not re.fullmatch(r"-?[0-9]{1,18}", at):
                continue  # no line of a log
            named = METRIC.match(line)
            metric = named[0] if named else None
            if wanted(metric):
                yield host, int(at), number, metric, line


def _any(metric: str | None) -> bool:
    return True


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("metric",):
                self.tests.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("metric",):
                self.tests.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("metric",):
                self.tests.append(("starts", f.value))
            else:
                yield f

    def wanted(self, metric: str | None) -> bool:
        for kind, value in self.tests:
            if metric is None or (metric not in value if kind == "in" else not metric.startswith(value)):
                return False
        return True

    def partitions(self) -> list[LogFile]:
        return [LogFile(name) for name in _names(self.path)]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        # An empty log is read as one partition without a name.
        if partition is not None and getattr(partition, "name", None):
            yield from _rows(self.path, partition.name, self.wanted)


class LogStream(DataSourceStreamReader):
    """Offsets are file names: all files up to one of them have been read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"until": ""}

    def latestOffset(self) -> dict:
        return {"until": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        return [LogFile(n) for n in _names(self.path) if start["until"] < n <= end["until"]]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        yield from _rows(self.path, partition.name, _any)


class LogWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        files, root = _open(self.path)
        name, sink = f"{root}/_tasks/{uuid.uuid4().hex}", None
        for row in rows:
            if row["host"] is None or row["ts_ms"] is None or row["line"] is None:
                continue
            if sink is None:
                files.create_dir(f"{root}/_tasks", recursive=True)
                sink = files.open_output_stream(name)
            # A line is one line, and a host has no tab.
            host, line = re.sub(r"[\t\r\n]", " ", row["host"]), re.sub(r"[\r\n]", " ", row["line"])
            sink.write(f"{host}\t{row['ts_ms']}\t{line}\n".encode())
        if sink is not None:
            sink.close()
        return Written(name if sink is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        if self.overwrite:
            for name in _names(self.path):
                files.delete_file(f"{root}/{name}")
        at = max(time.time_ns() // 1_000_000, *[int(n.split("-")[0]) + 1 for n in _names(self.path)[-1:]], 0)
        for message in messages:
            if message is not None and message.task:
                files.move(message.task, f"{root}/{at:015d}-{uuid.uuid4().hex}{SUFFIX}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.path)
        for message in messages:
            if message is not None and message.task:
                files.delete_file(message.task)


class ScrapeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scrape_log"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a scrape log needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self._path())

    def streamReader(self, schema: StructType) -> LogStream:
        return LogStream(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        missing = {"host", "ts_ms", "line"} - set(schema.names)
        if missing:
            raise ValueError(f"a scrape log is written from host, ts_ms and line; there is no {sorted(missing)}")
        return LogWriter(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScrapeLog)

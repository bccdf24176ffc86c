"""WARC archives of pages, and a capture index of two levels over them.

Every task writes archives of its own (one gzip member for each record). A page whose payload another
page has, too, becomes a revisit that names the page it is equal to. The index lists all captures by a
key with the host reversed (``com,example,www)/path``), sorted over the whole set and cut into
compressed blocks of some hundred lines; a directory of each index file holds the first key, offset
and length of every block. A lookup finds its index file, then its block by binary search in the
directory, reads that block alone, and then the record's range of the archive.

Tables hold only file names, offsets and lengths; the files lie in the shared folder, and names are
drawn anew in each attempt of a task, so that a repeated task never writes over another's file. They
are opened by the schemes that pyarrow.fs knows (local paths, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import pick, text_bytes
from servelens.operators.skew import salted_join
from servelens.session import shared_dir, stage

#: An archive that has grown beyond this is closed and another begun; bytes of a task that reads ranges.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 64 << 20
#: Lines of an index block.
BLOCK = 512
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "key string, record_id string, record_type string, file string, start bigint, length bigint"
RECORDS = (
    "record_id string, record_type string, uri string, refers_to string, refers_to_uri string, "
    "payload_bytes bigint, payload_digest string"
)


@dataclass
class Archives:
    """``captures`` has a row for each record; ``parts`` one for each index file, in their order:
    first key and record id, file of blocks, directory file. There are no more index files than
    shuffle partitions."""

    folder: str
    captures: DataFrame
    parts: list[tuple[bytes, str, str]]


def url_key(uri: Column) -> Column:
    """The key of a URI: host reversed and in lower case, path and query; scheme, user, port and
    fragment left out. What has no host is its own key. White space and control characters count as
    %20."""
    uri = F.regexp_replace(uri, r"[\x00-\x20\x7f]", "%20")
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^#]*)"
    host = F.reverse(F.split(F.lower(F.regexp_extract(uri, shape, 1)), r"\."))
    rest = F.regexp_extract(uri, shape, 2)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(uri.rlike(shape), F.concat(F.array_join(host, ","), F.lit(")"), rest)).otherwise(uri)


def _place(page_id: Column, url: Column) -> Column:
    """The URI that a page is archived under."""
    own = F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")))
    return F.when(F.length(url) > 0, F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")).otherwise(own)


def record_id(page_id: Column, sha1: Column) -> Column:
    return F.concat(
        F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), sha1
    )


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(rid: str, uri: str, payload: bytes, refers: tuple[str, str] | None) -> bytes:
    """The record of a page; with ``refers`` (record id, URI) a revisit of that record."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = [
        ("WARC-Record-ID", f"<{rid}>"),
        ("WARC-Target-URI", uri),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is None:
        return _record("response", fields, http.encode() + payload)
    fields += [
        ("WARC-Profile", REVISIT),
        ("WARC-Refers-To", f"<{refers[0]}>"),
        ("WARC-Refers-To-Target-URI", refers[1]),
        ("WARC-Refers-To-Date", DATE),
    ]
    return _record("revisit", fields, http.encode())


def packed(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (what follows the HTTP header) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """What each gzip member of a stream holds; one member is in memory at a time."""
    data = stream.read(piece)
    while data:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(piece)):
                raise ValueError("an archive ends inside a record")
            out.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(out)
        data = data or stream.read(piece)


def _files(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder)


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[t]) for c, t in zip(columns, types)], names=list(names)
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> Archives:
    """Write a record for each row of ``pages(page_id, url, html)`` and the index over all of them.

    Of rows with equal payloads (html in UTF-8, null as empty) those with the largest page_id are
    responses, null being the smallest, and the others are revisits. Pages without a url are archived
    under ``urn:x-page:<page_id>``. Rows with equal ids and payloads have equal record ids. An empty
    table gives no archive. Other columns don't matter.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id",
        _place(F.col("page_id"), F.col("url")).alias("uri"),
        text_bytes("html").alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("_read", F.monotonically_increasing_id())
    # Only payloads that occur more than once are looked up, so this table is small where copies are few.
    first = stage(
        rows.groupBy("sha1")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "uri")).alias("first"))
        .where("n > 1")
        .select("sha1", F.lit(True).alias("found"), "first"),
        "warc-copies",
    )
    # A payload may belong to a third of all pages: its pages are spread over salts.
    met = salted_join(rows, first, ["sha1"], ["_read"])
    copy = F.coalesce("found", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    ready = met.select(
        url_key(F.col("uri")).alias("key"),
        record_id(F.col("page_id"), F.col("sha1")).alias("record_id"),
        "uri",
        F.when(copy, record_id(F.col("first.page_id"), F.col("sha1"))).alias("refers_to"),
        F.when(copy, F.col("first.uri")).alias("refers_to_uri"),
        "payload",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, sink = "", None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, rid, uri, to, to_uri, payload = (c[i].as_py() for c in batch.columns)
                if sink is None or sink.tell() >= ARCHIVE_BYTES:
                    if sink is not None:
                        sink.close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    about = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                             ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    sink.write(packed(_record("warcinfo", about, b"format: WARC File Format 1.1\r\n")))
                start = sink.tell()
                sink.write(packed(page_record(rid, uri, payload, to and (to, to_uri))))
                kind = "revisit" if to else "response"
                out.append((key, rid, kind, name, start, sink.tell() - start))
            yield _table(CAPTURES, out)
        if sink is not None:
            sink.close()

    captures = stage(ready.mapInArrow(write, CAPTURES), "warc-captures")
    return Archives(folder, captures, build_index(captures, folder))


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, str, str]]:
    """Write the capture index and return its parts, one for each index file."""
    parts = "first binary, blocks string, directory string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        sink, listed, lines = None, [], []
        name = uuid.uuid4().hex

        def close_block() -> None:
            start = sink.tell()
            sink.write(zlib.compress(b"\n".join(lines)))
            listed.append(b"%s\t%d\t%d" % (b"\t".join(lines[0].split(b"\t")[:2]), start, sink.tell() - start))
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/{name}.blocks", compression=None)
                lines.append("\t".join(map(str, row)).encode())
                if len(lines) == BLOCK:
                    close_block()
        if sink is None:
            return
        if lines:
            close_block()
        sink.close()
        with files.open_output_stream(f"{root}/{name}.directory", compression=None) as directory:
            directory.write(b"\n".join(listed))
        first = b"\t".join(listed[0].split(b"\t")[:2])
        yield _table(parts, [(first, f"{name}.blocks", f"{name}.directory")])

    by = ["key", "record_id", "file", "start"]
    ordered = captures.repartitionByRange(*by).sortWithinPartitions(*by)
    found = stage(ordered.mapInArrow(write, parts), "warc-index").collect()
    return sorted((bytes(r["first"]), r["blocks"], r["directory"]) for r in found)


def _ordered(line: bytes) -> tuple[bytes, bytes]:
    key, rid, _ = line.split(b"\t", 2)
    return key, rid


def locate(archives: Archives, wanted: DataFrame) -> DataFrame:
    """(key, record_id, record_type, file, start, length) of the captures that ``wanted(key,
    record_id)`` names; all captures of a key where the record id is null. Names that the index lacks
    give no row, those that come more than once are looked up once."""
    parts, folder = archives.parts, archives.folder
    firsts = [_ordered(first + b"\t") for first, _, _ in parts]
    blank = wanted.sparkSession.createDataFrame([], CAPTURES)
    if not parts:
        return blank

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part that may hold captures of the key."""
        for batch in batches:
            out = []
            for key, rid in zip(*(c.to_pylist() for c in batch.columns)):
                low = (key.encode(), (rid or "").encode())
                high = low if rid is not None else (key.encode(), b"\xff")
                start = max(bisect_left(firsts, low) - 1, 0)
                out += [(part, key, rid) for part in range(start, bisect_right(firsts, high))]
            yield _table("part int, key string, record_id string", out)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        held = at = None
        blocks, directory, lines, order = None, [], [], []
        for batch in batches:
            out = []
            for part, key, rid in zip(*(c.to_pylist() for c in batch.columns)):
                if part != held:
                    held, at = part, None
                    with files.open_input_file(f"{root}/{parts[part][2]}") as f:
                        entries = [line.split(b"\t") for line in f.read().split(b"\n")]
                    directory = [(e[0], e[1]) for e in entries]
                    spans = [(int(e[2]), int(e[3])) for e in entries]
                    blocks = files.open_input_file(f"{root}/{parts[part][1]}")
                low = (key.encode(), (rid or "").encode())
                high = low if rid is not None else (low[0], b"\xff")
                # From the last block that begins before the first wanted line.
                number = max(bisect_left(directory, low) - 1, 0)
                while number < len(directory) and directory[number] <= high:
                    if number != at:
                        start, length = spans[number]
                        blocks.seek(start)
                        lines = zlib.decompress(blocks.read(length)).split(b"\n")
                        order, at = [_ordered(line) for line in lines], number
                    for line in lines[bisect_left(order, low) : bisect_right(order, high)]:
                        name, own, kind, file, start, length = line.decode().split("\t")
                        out.append((name, own, kind, file, int(start), int(length)))
                    number += 1
            yield _table(CAPTURES, out)

    asked = wanted.select("key", "record_id").where("key is not null").distinct()
    return (
        asked.mapInArrow(assign, "part int, key string, record_id string")
        .repartition("part", F.substring("key", 1, 48))
        .sortWithinPartitions("part", "key", "record_id")
        .mapInArrow(look, CAPTURES)
    )


def _described(record: bytes) -> tuple:
    fields, payload = parsed(record)
    bare = lambda name: fields.get(name, "")[1:-1] or None
    kind = fields["WARC-Type"]
    told = (len(payload), base32(hashlib.sha1(payload).digest())) if kind == "response" else (None, None)
    own, to = bare("WARC-Record-ID"), bare("WARC-Refers-To")
    return own, kind, fields.get("WARC-Target-URI"), to, fields.get("WARC-Refers-To-Target-URI"), *told


def read_archives(archives: Archives) -> DataFrame:
    """A row for each page record of the archives, read from end to end: record_id, record_type, uri,
    refers_to and refers_to_uri, and of responses bytes and digest of the payload as it is there."""
    folder = archives.folder
    names = stage(archives.captures.select("file").distinct(), "warc-files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        if not record.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo"):
                            out.append(_described(record))
                        if len(out) == 4096:
                            yield _table(RECORDS, out)
                            out = []
                yield _table(RECORDS, out)

    return names.repartition(max(names.count(), 1)).mapInArrow(read, RECORDS)


def read_ranges(archives: Archives, located: DataFrame) -> DataFrame:
    """The records at ``located(file, start, length)``, as :func:`read_archives` has them, read by
    their ranges alone. Rows are dealt by the bytes that they ask for."""
    folder = archives.folder
    located = stage(located.select("file", "start", "length").distinct(), "warc-ranges")
    asked = located.agg(F.sum("length")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for name, spans in groupby(rows, key=lambda r: r[0]):
                with files.open_input_file(f"{root}/{name}") as file:
                    out = []
                    for _, start, length in spans:
                        file.seek(start)
                        out.append(_described(zlib.decompress(file.read(length), 31)))
                yield _table(RECORDS, out)

    parts = int(asked // RANGE_BYTES) + 1
    return (
        located.repartitionByRange(parts, "file", "start")
        .sortWithinPartitions("file", "start")
        .mapInArrow(read, RECORDS)
    )


def look_up(archives: Archives, urls: DataFrame) -> DataFrame:
    """The captures of ``urls(url)``: the key of the url and the record, as :func:`read_archives` has
    it. Urls that differ in scheme, port or fragment only have the same captures."""
    wanted = urls.select(url_key(F.col("url")).alias("key"), F.lit(None).cast("string").alias("record_id"))
    found = read_ranges(archives, locate(archives, wanted))
    return found.withColumn("key", url_key(F.col("uri")))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of ``pages``,
    as the archives written from them tell: a revisit's payload is that of the record which it refers
    to, found by the index.

    See :func:`write_archives` for nulls, ties and repeated rows.
    """
    archives = write_archives(pages)
    records = stage(read_archives(archives), "warc-records")
    revisits = records.where("refers_to is not null")
    targets = revisits.select(url_key(F.col("refers_to_uri")).alias("key"), F.col("refers_to").alias("record_id"))
    payloads = (
        read_ranges(archives, locate(archives, targets))
        .groupBy(F.col("record_id").alias("refers_to"))
        .agg(F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    )
    # A record may be the one that a third of all pages refer to.
    full = salted_join(
        revisits.withColumn("_read", F.monotonically_increasing_id()), stage(payloads, "warc-payloads"),
        ["refers_to"], ["_read"],
    )
    page = lambda rid: F.expr(f"try_cast(split_part({rid}, ':', 3) as bigint)")

    def told(rows: DataFrame, size: str, digest: str) -> DataFrame:
        return rows.select(
            page("record_id").alias("page_id"),
            F.col(size).alias("payload_bytes"),
            F.col(digest).alias("payload_digest"),
            "record_type",
            page("refers_to").alias("refers_to"),
        )

    responses = records.where("refers_to is null")
    return told(responses, "payload_bytes", "payload_digest").unionByName(told(full, "bytes", "digest"))

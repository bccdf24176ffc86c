"""Archives and their index against plain reading of the files and of the rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from servelens.llm import warc
from servelens.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            kind = ("response", None) if i == first else ("revisit", first)
            out.append((i, len(payload), digest, *kind))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def made(n=400, seed=1):
    rng = random.Random(seed)
    bodies = ["", None, "<p>é</p>", "a\r\n\r\nb", "x" * 300_000, "hot"]
    rows = []
    for i in range(n):
        body = rng.choice(bodies) if rng.random() < 0.3 else "hot" if rng.random() < 0.4 else f"page {i}"
        host = rng.choice(["a.example.com", "WWW.Example.org:8080", "b.a.example.com"])
        url = rng.choice([None, "", "no host", f"http://{host}/p/{i % 50}?q=1#top", f"https://{host}"])
        rows.append((rng.choice([i, i, i, None, i - 1]), url, body))
    return rows


def test_round_trip_equals_plain_rules(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 500)
    rows = made()
    assert result(warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(6))) == brute(rows)


def test_one_payload_only(spark):
    rows = [(i, f"http://h.example/{i}", "same") for i in range(700)] + [(5, "http://h.example/5", "same")]
    assert result(warc.round_trip(spark.createDataFrame(rows, PAGES))) == brute(rows)


@pytest.fixture(scope="module")
def archives(spark):
    return warc.write_archives(spark.createDataFrame(made(900, 2), PAGES).repartition(3))


def test_archives_are_plain_gzip(archives):
    """Python's gzip reads the files, and each capture's range is one whole record."""
    folder, seen = archives.folder.removeprefix("file://"), 0
    for file, rows in _by_file(archives).items():
        with open(f"{folder}/{file}", "rb") as f:
            raw = f.read()
        whole = gzip.decompress(raw)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for r in rows:
            record = gzip.decompress(raw[r.start : r.start + r.length])
            assert record in whole and record.endswith(b"\r\n\r\n")
            fields, payload = warc.parsed(record)
            assert fields["WARC-Type"] == r.record_type and fields["WARC-Record-ID"] == f"<{r.record_id}>"
            seen += 1
            if r.record_type == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + warc.base32(hashlib.sha1(payload).digest())
    assert seen == 900


def _by_file(archives):
    out = defaultdict(list)
    for r in archives.captures.collect():
        out[r.file].append(r)
    return out


def test_index_finds_every_capture(spark, monkeypatch, archives):
    captures = archives.captures
    found = warc.locate(archives, captures)
    key = lambda df: sorted(set(tuple(r) for r in df.select(*captures.columns).collect()))
    assert key(found) == key(captures)
    missing = spark.createDataFrame([("com,nowhere)/", "x"), ("zz", None), (None, None), ("", "")], "key string, record_id string")
    assert warc.locate(archives, missing).count() == 0


def test_look_up_by_url(spark, archives):
    urls = spark.createDataFrame([("HTTP://B.A.example.com/p/7?q=1",), ("http://example.com/none",), (None,)], "url string")
    found = warc.look_up(archives, urls).collect()
    want = archives.captures.where(F.col("key") == "com,example,a,b)/p/7?q=1")
    assert len(found) == want.count() > 1
    assert {r.record_id for r in found} == {r.record_id for r in want.collect()}


@pytest.mark.parametrize(
    ("uri", "key"),
    [
        ("http://www.Example.com/a?b=C#d", "com,example,www)/a?b=C"),
        ("https://user@example.com:81", "com,example)/"),
        ("https://example.com?x", "com,example)/?x"),
        ("urn:x-page:5", "urn:x-page:5"),
        ("http://a.b/c d\te", "b,a)/c%20d%20e"),
    ],
)
def test_keys(spark, uri, key):
    df = spark.createDataFrame([(uri,)], "u string")
    assert df.select(warc.url_key(F.col("u"))).first()[0] == key


def test_awkward_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, None, ""), (2, "http://x.y/\n\t", "a" * 5_000_000), (2, "http://x.y/", "b"), (2, "http://x.y/", "b"), (-3, "", "b")]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("key", "record_id", "uri", "sha1", "payload", "found", "first", "_read"):
        df = df.withColumn(name, F.lit("x"))
    assert result(warc.round_trip(df)) == brute(rows)
    assert warc.round_trip(df.where("1 = 0")).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(QUERIES["op12_warc_index"](spark, sf_dir)) == brute(rows)

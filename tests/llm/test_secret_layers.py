"""Encoded layers over several lines, after separators, in several members, and flawed ones."""

import base64
import gzip
import random
import time
import zlib

import pytest

from servelens.llm import secret_scan

SECRET = "some words before it, then token = hunter2hunter2 and some more words after it " * 2


def found(text):
    return {(kind, start, end) for start, kind, end in secret_scan.find_secrets(text)[1]}


def noise(n):
    return random.Random(n).randbytes(n)


@pytest.mark.parametrize("data", [SECRET.encode(), gzip.compress(noise(400).hex().encode() + b" " + SECRET.encode())])
@pytest.mark.parametrize("newline", ["\n", "\r\n  "])
def test_wrapped_lines(data, newline):
    block = base64.encodebytes(data).decode().strip().replace("\n", newline)
    assert ("assign", 4, 4 + len(block)) in found(f"é = {block}\n\nend")
    assert ("assign", 4, 4 + len(block)) in found(f"é = {block}")


@pytest.mark.parametrize("before", ["v1_", "cfg-", "a/bc/", "x-y_z-"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_after_separators(before, pack):
    run = base64.b64encode(pack(SECRET.encode())).decode()
    assert "assign" in {kind for kind, *_ in found(f"see {before}{run} end")}


def test_members_and_flaws():
    for data in (
        gzip.compress(b"plain words") + gzip.compress(SECRET.encode()),
        gzip.compress(SECRET.encode() + noise(5000).hex().encode())[:2000],
        gzip.compress(SECRET.encode()) + b"\x00\x01",
        b"\x00\x01\xff" + SECRET.encode() + b"\xfe\x00",
    ):
        run = base64.b64encode(data).decode()
        assert ("assign", 1, 1 + len(run)) in found(f" {run} ")


def test_long_run_ends():
    assert found(base64.urlsafe_b64encode(noise(100_000)).decode()) == set()


@pytest.mark.parametrize("bad", ["%FF", "\\ud83d", "\\xff", "%C3", "\\xe2\\x82"])
def test_bad_escapes_hide_nothing(bad):
    """A byte that is no text before, in and after a run of escapes."""
    shape = {"%": "%{:02x}", "u": "\\u{:04x}", "x": "\\x{:02x}"}[bad[0] if bad[0] == "%" else bad[1]]
    run = bad + "".join(shape.format(ord(c)) for c in "token = hunter2hunter2") + bad
    assert "assign" in {kind for kind, *_ in found(f"a {run} b")}


def test_code_points_in_braces():
    run = "".join(f"\\u{{{ord(c):x}}}" for c in "token=hunter2hunter2é🙂") + "\\u{110000}"
    assert ("assign", 1, 1 + len(run)) in found(f" {run}")


def test_escaped_escape_signs():
    deep = "%" + "25" * 500
    run = "".join(f"{deep}{ord(c):02x}" for c in "token=hunter2hunter2")
    assert "assign" in {kind for kind, *_ in found(run)}
    assert found("100%25 %2525 %25zz") == set()


@pytest.mark.parametrize("text", ["%" + "25" * 200_000, "-H4sI" * 80_000, "%2525" * 80_000, "A-" * 200_000])
def test_hostile_texts_end_in_seconds(text):
    begun = time.process_time()
    secret_scan.find_secrets(text)
    assert time.process_time() - begun < 10


def test_cut_runs_are_marked(monkeypatch):
    monkeypatch.setattr(secret_scan, "UNPACKED_BYTES", 5000)
    for fill, expected in ((1000, False), (6000, True)):
        cut = []
        run = base64.b64encode(gzip.compress(b"x " * (fill // 2) + SECRET.encode())).decode()
        secret_scan.find_secrets(run, cut)
        assert any(cut) == expected

"""Secrets in texts and in what the texts encode.

A worklist holds layers of a text: the text itself, then whatever its URL escapes, Unicode escapes,
base64 runs and compressed data unwrap to. Each layer is scanned by the same rules and unwrapped
again until no layer gives a new one; a layer whose content was seen is not taken up again, so
cycles end. Every character of a layer carries the span of the original text that it came from.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame

from servelens.llm.common import map_rows

#: Kinds in their order, with the length that a match (or its group) needs (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}")
#: Runs of equal escapes. An escape sign that is escaped again and again is one, so that it takes
#: one layer and not one for each time.
RUN = re.compile(
    r"%(?:25)+(?=[0-9A-Fa-f]{2})|(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+"
    r"|(?:\\u\{[0-9A-Fa-f]{1,6}\})+|(?:\\x[0-9A-Fa-f]{2})+"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 lines that follow each other, and the parts of such a block.
LINE, GAP = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[\x20\t\r\n]+")
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
SEPARATOR = re.compile(r"[-_/]+")
UNPRINTABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]+")
#: No secret and no encoded secret is shorter ("token=" and 8 characters).
LEAST = 14
#: Bytes that are unpacked at a time, and how often data may be packed in itself.
FED, UNPACKED_TIMES = 1 << 12, 64
PRINTABLE = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]*")
#: Most bytes that one compressed run may unpack to (a guard against decompression bombs; a text with
#: a run that goes on behind them is marked).
UNPACKED_BYTES = 1 << 26

Span = tuple[int, str, int]


@dataclass
class Layer:
    """A decoded text; ``starts[i]`` is where its part ``i`` begins, ``spans[i]`` that part's span
    of the original. A part's characters stand for the original's one by one where ``exact``."""

    text: str
    starts: list[int]
    spans: list[tuple[int, int]]
    exact: list[bool]

    def original(self, start: int, end: int) -> tuple[int, int]:
        return self._edge(start)[0], self._edge(end - 1)[1]

    def _edge(self, at: int) -> tuple[int, int]:
        part = bisect_right(self.starts, at) - 1
        first, last = self.spans[part]
        if self.exact[part]:
            first += at - self.starts[part]
            last = first + 1
        return first, last


def scan(text: str) -> list[Span]:
    """(start, kind, end) of the secrets in one layer, leftmost and without overlap per kind."""
    found: list[Span] = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            found.append((m.start(), "assign", m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), "access", m.end()))
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _unescape(run: str) -> str | None:
    """The characters of a run of equal escapes, bytes that are no text as lone surrogates; None if
    there is no text at all."""
    if run[0] == "%":
        if set(run[1:].split("25")) == {""}:
            return "%"
        plain = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    elif run[1] == "x":
        plain = bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "surrogateescape")
    elif run[2] == "{":
        codes = [int(code, 16) for code in run[3:-1].split("}\\u{")]
        plain = "".join(chr(c) if c <= 0x10FFFF else "\ufffd" for c in codes)
    else:
        plain = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
    return None if all("\ud800" <= c <= "\udfff" for c in plain) else plain


def _packed(data: bytes | memoryview) -> bool:
    head = bytes(data[:3])
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and not int.from_bytes(head[:2]) % 31


def _inflate(data: bytes | memoryview, cut: list[bool]) -> bytes | None:
    """Unpack gzip or zlib data, all members one after the other; what follows them is appended.

    A stream that breaks off or turns bad gives what was unpacked up to there. ``cut`` is told if the
    most bytes were reached before the end.
    """
    out, left = [], UNPACKED_BYTES
    while left > 0 and _packed(data):
        stream, at = zlib.decompressobj(47), 0
        try:
            while (at < len(data) or stream.unconsumed_tail) and left > 0 and not stream.eof:
                fed = stream.unconsumed_tail or data[at : at + FED]
                at += 0 if stream.unconsumed_tail else FED
                piece = stream.decompress(fed, left)
                out.append(piece)
                left -= len(piece)
        except zlib.error:
            break
        if not stream.eof:
            break
        data = stream.unused_data + bytes(data[at:])
    else:
        out.append(bytes(data) if left > 0 else b"")
        cut.append(left <= 0 and len(data) > 0)
        return b"".join(out) if len(out) > 1 else None
    cut.append(left <= 0)
    return b"".join(out) or None


def _texts(data: bytes, cut: list[bool]) -> list[str]:
    """All of the data if it is text, else its stretches of text that are long enough for a secret."""
    for _ in range(UNPACKED_TIMES):
        if (inner := _inflate(data, cut)) is None or inner == data:
            break
        data = inner
    else:
        cut.append(_packed(data))
    text = data.decode("utf-8", "surrogateescape")
    if PRINTABLE.fullmatch(text):
        return [text] if text else []
    return [t for t in UNPRINTABLE.split(text) if len(t) >= LEAST]


def _unbase64(run: str) -> bytes:
    """The bytes of a base64 run of either alphabet; a digit that is left over is dropped."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _layers_of(run: str, cut: list[bool]) -> list[tuple[int, str]]:
    """(start, text) of what a base64 run decodes to, from its start and after its separators.

    Starts that are a multiple of four apart give the same bytes, so each of the four remainders is
    decoded once: its first start gives all of them, a later one only what is packed there.
    """
    out: list[tuple[int, str]] = []
    decoded: dict[int, tuple[int, bytes]] = {}
    for start in [0, *[m.end() for m in SEPARATOR.finditer(run)]]:
        if len(run) - start < 16:
            break
        if start % 4 not in decoded:
            data = _unbase64(run[start:])
            decoded[start % 4] = start, data
            texts = _texts(data, cut)
        else:
            first, data = decoded[start % 4]
            rest = memoryview(data)[(start - first) // 4 * 3 :]
            inner = _inflate(rest, cut) if _packed(rest) else None
            texts = [] if inner is None else _texts(inner, cut)
        out += [(start, t) for t in texts]
        if not start and len(texts) == 1 and (_packed(data) or texts[0] == data.decode("utf-8", "replace")):
            break
    return out


def blocks(text: str):
    """(start, end) of base64 lines that follow each other: full lines of one width, then the last."""
    at = 0
    while (m := WRAPPED.search(text, at)) is not None:
        width = None
        runs = list(LINE.finditer(text, m.start(), m.end()))
        last = runs[0]
        for run in runs[1:]:
            size = run.end() - run.start()
            if width is not None and size > width:
                break
            last = run
            if width is not None and size < width:
                break
            width = size
        end = last.end()
        while end < len(text) and text[end] == "=" and end - last.end() < 2:
            end += 1
        yield m.start(), end
        at = end


def unescaped(layer: Layer) -> Layer | None:
    """The whole layer with its escapes replaced; the rest of it keeps its place."""
    text, parts, at, changed = layer.text, [], 0, False
    for m in RUN.finditer(text):
        plain = _unescape(m[0])
        if plain is None:
            continue
        changed = True
        if m.start() > at:
            parts.append((text[at : m.start()], at, m.start(), True))
        parts.append((plain, m.start(), m.end(), False))
        at = m.end()
    if not changed:
        return None
    if at < len(text):
        parts.append((text[at:], at, len(text), True))
    out = Layer("".join(p[0] for p in parts), [], [], [])
    size = 0
    for plain, start, end, same in parts:
        for cut, piece_exact, span in _pieces(layer, start, end, same):
            out.starts.append(size + cut)
            out.spans.append(span)
            out.exact.append(piece_exact)
        size += len(plain)
    return out


def _pieces(layer: Layer, start: int, end: int, same: bool):
    """(offset, exact, original span) of the parts of ``layer[start:end]``."""
    if not same:
        yield 0, False, layer.original(start, end)
        return
    part = bisect_right(layer.starts, start) - 1
    while part < len(layer.starts) and layer.starts[part] < end:
        from_ = max(start, layer.starts[part])
        to = min(end, layer.starts[part + 1] if part + 1 < len(layer.starts) else end)
        yield from_ - start, layer.exact[part], layer.original(from_, to)
        part += 1


def unwrapped(layer: Layer, cut: list[bool]) -> list[Layer]:
    out = []
    text = layer.text
    if ("%" in text or "\\u" in text or "\\x" in text) and ESCAPED.search(text):
        inner = unescaped(layer)
        if inner is not None:
            out.append(inner)
    for m in BASE64.finditer(text):
        for start, plain in _layers_of(m[0], cut):
            out.append(Layer(plain, [0], [layer.original(m.start() + start, m.end())], [False]))
    for start, end in blocks(text) if "\n" in text else ():
        for first, plain in _layers_of(GAP.sub("", text[start:end]), cut):
            # Gaps are not counted, so a start after a separator is that of the block's first line.
            from_ = start + first if "\n" not in text[start : start + first + 1] else start
            out.append(Layer(plain, [0], [layer.original(from_, end)], [False]))
    return out


def find_secrets(text: str, cut: list[bool] | None = None) -> tuple[list[Span], list[Span]]:
    """Spans in the text itself, and all spans with those of its layers mapped back. ``cut`` gets a
    True for each compressed run that was not unpacked to its end."""
    cut = [] if cut is None else cut
    base = scan(text)
    every = set(base)
    work = deque([Layer(text, [0], [(0, len(text))], [True])] if text else [])
    seen: set[tuple] = set()
    while work:
        layer = work.popleft()
        for inner in unwrapped(layer, cut):
            key = (hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), inner.spans[0])
            if key in seen or not inner.text:
                continue
            seen.add(key)
            work.append(inner)
            for start, kind, end in scan(inner.text):
                first, last = inner.original(start, end)
                every.add((first, kind, last))
    order = {k: i for i, k in enumerate(KINDS)}
    by = lambda s: (s[0], order[s[1]], s[2])
    return sorted(base, key=by), sorted(every, key=by)


def written(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for start, kind, end in spans])


def scan_secrets(df: DataFrame) -> DataFrame:
    """One row per row of ``df(doc_id, text)``: n_assign, n_access, n_hex and base_sha256 of the
    spans in the text itself, spans, which adds those found in decoded layers, and cut, which says that
    some compressed run unpacks to more than 64 MB or is packed in itself more than 64 times: secrets
    behind that are not listed.

    Layers are URL escapes, ``\\uXXXX``, ``\\u{...}`` and ``\\xXX`` escapes, base64 of either alphabet
    (runs of 16 characters or more, from their start, after separators in them, and over lines of one
    width), and gzip or zlib data in base64. Bytes that are no text are passed over. Base64 behind
    a letter or digit that doesn't belong to it, UTF-16 and other packings are not unwrapped.

    Spans are kind:start:end in code points of the original, end exclusive, by start, then kind;
    a secret in an encoded run has the run's span. A null text counts as empty: no spans, and the
    hash of the empty string. No shuffle; a text is read whole.
    """

    def make():
        def run(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "cut")}
            for text in texts:
                cut: list[bool] = []
                base, every = find_secrets(text.decode(), cut)
                out["cut"].append(any(cut))
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[1] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(every))
            return out

        return run

    return map_rows(
        df,
        make,
        "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, cut boolean",
    )

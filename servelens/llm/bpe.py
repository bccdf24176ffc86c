"""Byte-level BPE by prefix dynamic programming, exact appends and edits, and decoding.

A byte string's BPE encoding has this property: cutting it after any of its tokens leaves the
encoding of the shorter prefix. So each prefix has one last token, and the encoding is read off
backwards from the table of last tokens. A token that ends a prefix is the right one when the last
token before it is followed by it in the encoding of the two together, which
:meth:`PrefixEncoder.adjacent` decides from the merge order alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import public_tokenizers
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from servelens.llm.common import map_rows
from servelens.worker import per_worker

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces that one worker remembers before it starts again with an empty table.
REMEMBERED = 400_000


#: Any character for which :func:`latin_pattern` does not hold.
BEYOND_LATIN = re.compile("[^\\x00-\u024f]")


def latin_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes spelled out up to U+024F, for the faster ``re``."""
    classes = {
        r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-\u024f",
        r"\p{N}": "0-9²³¹¼½¾",
        r"\s": r"\t-\r \x85\xa0",
    }
    out = pattern.replace(r"(?!\S)", f"(?![^{classes[r'\s']}])")
    for name, chars in classes.items():
        # Inside a bracket the characters alone, elsewhere as a bracket of their own.
        out = re.sub(r"(\[\^[^\]]*)" + re.escape(name), lambda m: m[1] + chars, out)
        out = out.replace(name, f"[{chars}]")
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class PrefixEncoder:
    """Encode single pieces (matches of the splitting pattern) with a table of last tokens.

    ``ranks`` may hold tokens that no sequence of merges makes; like the usual encoders, a whole
    piece that is such a token becomes that token, and it is used nowhere else.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.lost: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                # Shorter tokens of smaller rank are known by now, so this uses earlier merges only.
                parts = self._merged(token, rank)
                if len(parts) == 2:
                    self.halves[rank] = (parts[0], parts[1])
                    self.joined[parts[0], parts[1]] = rank
                else:
                    self.lost.add(rank)
        self.usable = {token: rank for token, rank in ranks.items() if rank not in self.lost}

    def _merged(self, text: bytes, below: int) -> list[int]:
        """Merge lowest rank first, using merges of a rank under ``below`` (a plain reference)."""
        parts = [self.ranks[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [self.joined.get(pair, below) for pair in zip(parts, parts[1:])]
            best = min(ranked)
            if best >= below:
                break
            at = ranked.index(best)
            parts[at : at + 2] = [best]
        return parts

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes together is these two tokens.

        While both grow by their own merges, the token that touches the border from the left runs
        through the right ends of ``left``, and likewise on the other side. Going back in time, the
        one made last is taken apart; a pair that would have merged before either grew on is a
        contradiction. Of equal ranks the merge further left comes first.
        """
        key = (left, right)
        grew_left = grew_right = 1 << 40  # rank of the merge that ends the token at the border
        answer = True
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < grew_left and rank <= grew_right:
                answer = False
                break
            parts_left, parts_right = self.halves.get(left), self.halves.get(right)
            if parts_left is None and parts_right is None:
                break
            if parts_right is None or parts_left is not None and left >= right:
                grew_left, left = left, parts_left[1]
            else:
                grew_right, right = right, parts_right[0]
        self.known[key] = answer
        return answer

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (last token of the prefix of each length) up to the end of ``piece``.

        Entries already there are kept, so an append costs only the bytes that it adds.
        """
        get, longest, known, adjacent = self.usable.get, self.longest, self.known, self.adjacent
        for end in range(len(last), len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(piece[start:end])
                if token is None:
                    continue
                if start:
                    fits = known.get((last[start], token))
                    if not (adjacent(last[start], token) if fits is None else fits):
                        continue
                last.append(token)
                break
        return last

    def table(self, piece: bytes) -> list[int]:
        """``table[i]``: the last token of the first ``i`` bytes; entry 0 is unused."""
        return self.extend(piece, [-1])

    def edit(
        self, piece: bytes, last: list[int], start: int, stop: int, new: bytes
    ) -> tuple[bytes, list[int]]:
        """Replace ``piece[start:stop]`` by ``new``; the table is kept up to ``start``, and taken
        over behind the edit once it meets the old one over the length of the longest token."""
        changed = piece[:start] + new + piece[stop:]
        table, shift, same = last[: start + 1], len(changed) - len(piece), 0
        while len(table) <= len(changed):
            end = len(table)
            self.extend(changed[:end], table)
            old = end - shift
            same = same + 1 if old > stop and table[end] == last[old] else 0
            if same >= 2 * self.longest:
                table += last[old + 1 :]
        return changed, table

    def read_off(self, piece: bytes, last: list[int]) -> list[int]:
        out, end = [], len(piece)
        if end and (whole := self.ranks.get(piece)) is not None:
            return [whole]
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.read_off(piece, self.table(piece))


class TextEncoder:
    """Split texts by the pattern, encode each piece, and remember pieces that were seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.pieces = regex.compile(pattern)
        self.latin = re.compile(latin_pattern(pattern))
        self.encoder = PrefixEncoder(ranks)
        self.memory: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memory = self.memory
        parts = (self.pieces if BEYOND_LATIN.search(text) else self.latin).findall(text)
        try:
            return b"".join([memory[p] for p in parts])
        except KeyError:
            pass
        out = []
        for p in parts:
            got = memory.get(p)
            if got is None:
                ids = self.encoder.encode_piece(p.encode())
                got = b"".join([i.to_bytes(4, "little") for i in ids])
                if len(memory) >= REMEMBERED:
                    memory.clear()
                    self.encoder.known.clear()
                if len(p) <= 64:
                    memory[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> array:
        return unpack(self.packed(text))

    def decode(self, packed: bytes) -> bytes:
        of = self.encoder.bytes_of
        return b"".join([of[i] for i in unpack(packed)])

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of ``text + more`` from those of ``text``; only the last pieces are done again.

        The last two matches may change when text follows (a longer run, or a contraction that
        was cut into two), earlier ones do not.
        """
        starts = [m.start() for m in self.pieces.finditer(text)][-2:]
        cut = starts[0] if starts else 0
        kept, size = list(ids), 0
        drop = len(text[cut:].encode())
        while size < drop:
            size += len(self.encoder.bytes_of[kept.pop()])
        return kept + self.encode(text[cut:] + more).tolist()


def unpack(packed: bytes) -> array:
    out = array("I")
    out.frombytes(packed)
    return out


def encode_documents(df: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``df(doc_id, text)``: n_tokens, ids (packed little-endian uint32), their
    SHA-256, and the SHA-256 of the bytes that the ids decode to.

    A null text counts as empty (no ids); ids may be null or repeated, each row stands for itself.
    ``path`` is a rank file that every executor can open; a file given to ``SparkContext.addFile``
    may be named alone. No shuffle: memory is a batch plus at most REMEMBERED pieces.
    """
    path = path or public_tokenizers.path(RANKS)

    def make():
        file = path if "/" in path else SparkFiles.get(path)
        encoder = per_worker("bpe", file, lambda: TextEncoder(read_ranks(file)))

        def run(texts: list[bytes]) -> dict[str, list]:
            ids = [encoder.packed(t.decode()) for t in texts]
            return {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids": ids,
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids],
            }

        return run

    schema = "n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"
    return map_rows(df, make, schema)

"""Token counts by a vocabulary's own library, without keeping the tokens.

Long texts are cut at safe boundaries, places that no token can span, and the pieces of a batch
are handed to the library in lists of about equal bytes. For a ``sentencepiece`` model whose pieces
hold the space mark at their start only, the place before a space that follows another character
is safe; each such unit (leading spaces and a word) is counted once and remembered. For other
vocabularies a text is one unit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import map_rows
from servelens.worker import per_worker

MODEL = "piece_bpe_32k.model"
#: Most bytes that go to the library in one call.
CALL_BYTES = 1 << 18
#: Distinct units that one worker remembers before it starts again.
REMEMBERED = 800_000
#: Units longer than this are counted but not remembered.
REMEMBERED_CHARS = 64


def balanced(units: Iterable[str], most_bytes: int = CALL_BYTES) -> Iterator[list[str]]:
    """Lists of units of at most ``most_bytes`` together (a longer unit is a list of its own)."""
    held: list[str] = []
    size = 0
    for unit in units:
        own = 4 * len(unit)
        if held and size + own > most_bytes:
            yield held
            held, size = [], 0
        held.append(unit)
        size += own
    if held:
        yield held


class PieceCounter:
    """Counts for a ``sentencepiece`` model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        bare = len(self.model.encode("a")) == len(self.model.encode(" a")) - 1
        # Safe only if no piece has the mark behind another character and nothing is normalised.
        self.splits = not any("▁" in n.lstrip("▁") for n in names) and bare
        self.units = re.compile(" *[^ ]+| +$")
        # A last space alone: the library gives nothing for an empty text.
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.memory: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [n for part in balanced(texts) for n in self.lengths(part)]
        memory = self.memory
        # The library puts a space before every text it gets, so a unit goes in without its first.
        # The mark itself means a space, too.
        cut = [self.units.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        memory[" "] = self.space
        new = {u for units in cut for u in units if u not in memory}
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            memory[" "] = self.space
            new = {u for units in cut for u in units if u != " "}
        once = {}
        for part in balanced(new):
            for unit, n in zip(part, self.lengths([u[1:] for u in part])):
                (memory if len(unit) <= REMEMBERED_CHARS else once)[unit] = n
        if once:
            of = memory | once if len(once) > 64 else _Either(memory, once)
        else:
            of = memory
        return [sum(map(of.__getitem__, units)) for units in cut]


class _Either(dict):
    """``first``, with what it lacks taken from ``second``; spares a copy of the large one."""

    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


class JsonCounter:
    """Counts for a ``tokenizers`` file; special strings in a text are treated as its default."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        encode = self.tokenizer.encode_batch
        return [
            len(e.ids) for part in balanced(texts) for e in encode(part, add_special_tokens=False)
        ]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    kind = PieceCounter if path.endswith(".model") else JsonCounter
    return per_worker("token_counts", path, lambda: kind(path)).count


def count_tokens(df: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of ``df(doc_id, text)``: n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated ids are kept as they are.
    ``path`` is a ``.model`` or ``.json`` file that every executor can open; a file given to
    ``SparkContext.addFile`` may be named alone. No shuffle.
    """
    path = path or public_tokenizers.path(MODEL)

    def make():
        count = counter(path if "/" in path else SparkFiles.get(path))

        def run(texts: list[bytes]) -> dict[str, list]:
            sizes, counts = [len(t) for t in texts], []
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + sizes[stop] <= 16 * CALL_BYTES):
                    size += sizes[stop]
                    stop += 1
                counts += count([t.decode() for t in texts[at:stop]])
                at = stop
            return {"n_bytes": sizes, "n_tokens": counts}

        return run

    counted = map_rows(df, make, "n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

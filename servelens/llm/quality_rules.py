"""Rules on repetition inside a text, by suffix arrays over words.

For the texts of a batch one suffix array is built by prefix doubling: only suffixes whose order is
still open are sorted again, so the work follows the repeated part. Comparing the ranks of the
doubling rounds gives the longest common prefix (LCP) of neighbours; maximal stretches of neighbours
with an LCP of at least ``min_words`` are the LCP intervals, and an interval whose suffixes do not
all follow the same word is a maximal repeated substring. The spans of all maximal repeats together
cover exactly the places of every suffix's longest repeat, the larger LCP of its two neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from servelens.llm.common import map_rows, parts

#: Characters that count as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
CONTINUATION = bytes(range(0x80, 0xC0))
#: Words of texts that share one suffix array; a longer text has its own.
CHUNK_WORDS = 1 << 17


def first_ranks(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of positions by (text, word), the rank of each position (first place of its group),
    and the places where groups begin."""
    n = len(ids)
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, rank, new


def suffix_arrays(ids: np.ndarray, doc: np.ndarray, end: np.ndarray):
    """Suffix array over several texts (``doc`` ascending, ``end`` the end of each position's text)
    and the LCP of each entry with the one before it; suffixes of two texts share nothing."""
    n = len(ids)
    order, rank, new = first_ranks(ids, doc)
    levels, step = [rank.copy()], 1
    while True:
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        open_groups = sizes > 1
        if not open_groups.any():
            break
        places = np.flatnonzero(np.repeat(open_groups, sizes))
        members = order[places]
        after = members + step
        inside = after < end[members]
        second = np.where(inside, rank[np.where(inside, after, 0)].astype(np.int64) + 1, 0)
        key = rank[members].astype(np.int64) * (n + 2) + second
        by = np.argsort(key, kind="stable")
        order[places] = members[by]
        key = key[by]
        fresh = np.empty(len(key), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        new[places] |= fresh
        rank[order[places]] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank.copy())
        step *= 2
    lcp = np.zeros(n, np.int32)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right = order[pairs - 1].copy(), order[pairs].copy()
    common = np.zeros(len(pairs), np.int32)
    for level in range(len(levels) - 1, -1, -1):
        inside = (left < end[order[pairs - 1]]) & (right < end[order[pairs]])
        ranks = levels[level]
        equal = inside & (ranks[np.where(inside, left, 0)] == ranks[np.where(inside, right, 0)])
        grown = equal.astype(np.int32) << level
        common += grown
        left, right = left + grown, right + grown
    lcp[pairs] = common
    return order, lcp


def maximal_repeats(
    order: np.ndarray, lcp: np.ndarray, before: np.ndarray, min_words: int
) -> Iterator[tuple[int, int, int]]:
    """(length, first, last place in ``order``) of each maximal repeat; ``before`` is a number for
    the word before each position, different from all others at a text's start."""
    differs = np.zeros(len(order), np.int64)
    differs[1:] = before[order[1:]] != before[order[:-1]]
    differs = np.cumsum(differs)
    long = np.flatnonzero(lcp >= min_words)
    breaks = np.flatnonzero(np.diff(long) > 1) + 1
    for run in np.split(long, breaks) if len(long) else ():
        stack: list[tuple[int, int]] = []
        values = lcp[run].tolist() + [0]
        for place, value in enumerate(values, int(run[0])):
            start = place - 1
            while stack and stack[-1][0] > value:
                length, start = stack.pop()
                if differs[place - 1] > differs[start]:
                    yield length, start, place - 1
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, start))


def repetition(texts: list[list[bytes]], min_words: int) -> dict[str, np.ndarray]:
    """For each list of words: words covered by repeats of at least ``min_words``, the longest
    repeat in words, how many maximal repeats there are, and words in repeated five-word windows."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("covered", "longest", "repeats", "windows")}
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return out
    flat = [numbers.setdefault(w, len(numbers)) for t in texts for w in t]
    ids = np.array(flat, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    stops = np.cumsum(sizes)
    order, lcp = suffix_arrays(ids, doc, np.repeat(stops, sizes))
    n = len(ids)
    longest_here = np.zeros(n, np.int64)
    longest_here[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    before = np.empty(n, np.int64)
    before[1:] = ids[:-1]
    starts = (stops - sizes)[sizes > 0]
    before[starts] = -1 - np.arange(len(starts))
    for length, first, _ in maximal_repeats(order, lcp, before, min_words):
        at = doc[order[first]]
        out["repeats"][at] += 1
        out["longest"][at] = max(out["longest"][at], length)
    out["covered"] = _covered(longest_here, min_words, doc, len(texts))
    five = np.where(longest_here >= 5, 5, 0)
    out["windows"] = _covered(five, 5, doc, len(texts))
    return out


def _covered(length: np.ndarray, least: int, doc: np.ndarray, texts: int) -> np.ndarray:
    """Positions per text under the union of the spans [p, p + length[p])."""
    at = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=texts)


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """Code points in words, symbols, and repeated lines of one text."""
    joined = b"".join(words)
    chars = len(joined.translate(None, CONTINUATION))
    symbols = len(text.translate(None, NOT_SYMBOLS))
    lines = [line for line in text.split(b"\n") if not line.isspace() and line] if b"\n" in text else ()
    return chars, symbols, len(lines) - len(set(lines))


def chunks(words: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for w in words:
        if held and size + len(w) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w)
    if held:
        yield held


def judge(
    texts: list[bytes], min_words: int, max_fraction: float, max_longest: int
) -> dict[str, list]:
    words = [t.split() for t in texts]
    base = [base_counts(t, w) for t, w in zip(texts, words)]
    parts = [repetition(part, min_words) for part in chunks(words)]
    found = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = np.array([len(w) for w in words])
    failed = (n < 10) | (100 * found["windows"] > 20 * n)
    kept = ~failed & (found["covered"] <= max_fraction * n) & (found["longest"] <= max_longest)
    return {
        "n_words": n.tolist(),
        "word_chars": [b[0] for b in base],
        "n_symbols": [b[1] for b in base],
        "n_dup_lines": [b[2] for b in base],
        "n_repeat_words": found["windows"].tolist(),
        "base_failed": failed.tolist(),
        "kept": kept.tolist(),
        "covered_words": found["covered"].tolist(),
        "longest_repeat": found["longest"].tolist(),
        "n_repeats": found["repeats"].tolist(),
    }


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, covered_words bigint, "
    "longest_repeat bigint, n_repeats bigint"
)


def quality_rules(
    df: DataFrame, min_words: int = 8, max_fraction: float = 0.2, max_longest: int = 60
) -> DataFrame:
    """One row per row of ``df(doc_id, text)`` with counts and a verdict.

    Words are runs of anything but ASCII white space. A text fails the base rule below 10 words or
    if over 20 % of its words lie in five-word windows that occur twice in it. Others are kept if
    maximal repeats of at least ``min_words`` words cover at most ``max_fraction`` of the words and
    none is longer than ``max_longest`` words; a limit that is met exactly keeps. A null text is
    empty and fails the base rule. No shuffle: each text is judged alone.
    """

    def make():
        return lambda texts: judge(texts, min_words, max_fraction, max_longest)

    return map_rows(df, make, SCHEMA)


def keep_good(
    df: DataFrame, min_words: int = 8, max_fraction: float = 0.2, max_longest: int = 60
) -> DataFrame:
    """The rows of ``df`` that :func:`quality_rules` keeps, all columns as they are."""
    here = df.columns
    bare = df.toDF(*[f"_{i}" for i in range(len(here))])
    at = here.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in parts(batch.column(at)):
                part = batch.slice(start, stop - start)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(judge(texts, min_words, max_fraction, max_longest)["kept"]))

    return bare.mapInArrow(run, bare.schema).toDF(*here)

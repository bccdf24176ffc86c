"""Document quality by Bradley-Terry ranking on text features.

From labelled documents, pairs of a better and a worse one are drawn; in the Bradley-Terry model the
chance that the first is preferred is the logistic function of the difference of their scores. With
scores linear in the features this is logistic loss on feature differences, without an intercept.
The quantile of the training scores at the share of worse documents is the threshold; scores are
given on a logistic scale whose threshold value is ``CUT``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import map_rows, pick, text_bytes
from servelens.llm.labels import held_out, training_labels
from servelens.session import stage

#: Labelled documents of a group, fewest of a class in one, and pairs drawn for each of its documents.
GROUP, LEAST, PAIRS_EACH = 2_000, 100, 3
#: Pairs of a fit without groups.
PAIRS = 60_000
#: Bins of a pass over the training scores.
BINS = 4096
CUT = 0.3
SYMBOLS = b"#*$%&|<>!=~^_{}[]\\/@+"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
ENDS = b".,;:?!"
EVERY = bytes(range(256))
WITHOUT = {
    name: bytes(set(EVERY) - set(kept))
    for name, kept in {"symbol": SYMBOLS, "upper": UPPER, "lower": LOWER, "digit": DIGITS, "end": ENDS}.items()
}
PIPE = re.compile(rb" [|] |[|]{2}|\t")
URL = re.compile(rb"https?://|www\.")
NAMES = (
    "symbols", "upper", "digits", "ends", "pipes", "same_word", "unique", "two_unique", "top_word",
    "word_length", "long_words", "marked_words", "bang_words", "dup_lines", "line_words", "words",
    "packed", "other", "urls", "shouted", "worst_symbols", "worst_upper", "worst_pipes", "worst_unique",
)
#: Words of a window for the worst-part features.
PART = 40


def features(text: bytes) -> list[float]:
    """Shares and logarithms that describe a text's form, all 0 for an empty text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    count = {name: len(text.translate(None, others)) for name, others in WITHOUT.items()}
    letters = count["upper"] + count["lower"] + 1
    times = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split(b"\n")
    filled = [x for x in lines if x and not x.isspace()]
    shouted = sum(1 for w in words if w.isupper() and len(w) > 2)
    marked = sum(1 for w in words if w[-1] in SYMBOLS)
    # The worst part: junk may be mixed into a good text.
    worst_symbols = worst_upper = worst_pipes = 0.0
    worst_unique = 1.0
    for at in range(0, n, PART):
        part = words[at : at + PART]
        joined = b"".join(part)
        m = len(joined)
        worst_symbols = max(worst_symbols, len(joined.translate(None, WITHOUT["symbol"])) / m)
        worst_upper = max(worst_upper, len(joined.translate(None, WITHOUT["upper"])) / m)
        worst_pipes = max(worst_pipes, part.count(b"|") / len(part))
        worst_unique = min(worst_unique, (len(set(part)) + PART - len(part)) / PART)
    return [
        count["symbol"] / size,
        count["upper"] / letters,
        count["digit"] / size,
        count["end"] / n,
        len(PIPE.findall(text)) / n,
        same / n,
        len(times) / n,
        pairs / n,
        max(times.values()) / n,
        (size - n) / n / 10,
        sum(1 for w in words if len(w) > 20) / n,
        marked / n,
        text.count(b"!") / n,
        1 - len(set(filled)) / max(1, len(filled)),
        math.log1p(n / max(1, len(filled))) / 5,
        math.log1p(n) / 10,
        len(zlib.compress(text, 1)) / (size + 20),
        1 - sum(count[k] for k in ("symbol", "upper", "lower", "digit", "end")) / size,
        len(URL.findall(text)) / n,
        shouted / n,
        worst_symbols,
        worst_upper,
        worst_pipes,
        worst_unique,
    ]


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, and ``CUT`` at the threshold."""
        z = self.slope * (self.raw(x) - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def preference_pairs(y: np.ndarray, seed: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of (better, worse) documents; every document is in at least one pair if there are
    enough pairs."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    return tuple(
        np.concatenate([rng.permutation(side) for _ in range(-(-pairs // len(side)))])[:pairs]
        for side in (good, bad)
    )


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, pairs: int = PAIRS, ridge: float = 1.0) -> Ranking:
    """Bradley-Terry weights by Newton's method on feature differences of preference pairs."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return Ranking(mean, scale, w, 0.0, 1.0)
    better, worse = preference_pairs(y, seed, pairs)
    d = z[better] - z[worse]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        hessian = (d.T * (p * (1 - p) + 1e-9)) @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, d.T @ (p - 1) + ridge * w)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # The threshold: the quantile of scores at the share of worse documents, between two scores.
    order = np.sort(raw)
    at = min(max(int(np.sum(y == 0)), 1), len(y) - 1)
    threshold = float(order[at - 1] + order[at]) / 2
    # Steepness: the spread of pair differences is on the logistic scale already.
    return Ranking(mean, scale, w, threshold, 1.0)


def labelled_features(documents: DataFrame, featured: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, x, y) for ``marks(doc_id, y)``, one row at most for each: of rows with equal ids the
    smallest text counts. ``featured(doc, x)`` has all rows of ``documents``; null texts teach nothing."""
    own = featured.where("doc.known").select(F.col("doc.doc_id").alias("doc_id"), "x").join(marks, "doc_id")
    again = stage(own.groupBy("doc_id", "y").count().where("count > 1").select("doc_id", "y"), "quality-repeats")
    if again.isEmpty():
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x", "y"])

    least = (
        pick(documents, "doc_id", "text").where("text is not null").join(again, "doc_id")
        .groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        .select("doc_id", text_bytes().alias("text"), "y")
        .mapInArrow(run, "doc_id bigint, x array<double>, y int")
    )
    return own.join(again, ["doc_id", "y"], "left_anti").select("doc_id", "x", "y").unionByName(least)


def groups(marked: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(part, x, y, first) as packed arrays: the rows of ``marked(doc_id, x, y)`` dealt to groups of about
    ``GROUP`` by a hash of the id. Rows of a rare class go to several groups, so that each group has
    both classes; ``first`` marks a row's place in its first one."""
    number = -(-sum(counts.values()) // GROUP)
    copies = F.lit(1)
    for label, n in counts.items():
        copies = F.when(F.col("y") == label, min(number, -(-LEAST * number // n))).otherwise(copies)
    home = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(number))
    dealt = (
        marked.withColumn("copies", copies)
        .select("x", "y", home.alias("home"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("k"))
        .withColumn("part", F.expr(f"cast((home + k * {number} div copies) % {number} as int)"))
        .select("part", "x", "y", (F.col("k") == 0).alias("first"))
    )

    def pack(rows: pa.Table) -> pa.Table:
        x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(NAMES))
        y, first = rows["y"].to_numpy(), rows["first"].to_numpy()
        # In a fixed order, so that pairs don't depend on how rows arrive.
        order = np.lexsort([*x.T, first, y])
        packed = [x[order].tobytes(), y[order].astype(np.int8).tobytes(), first[order].astype(np.int8).tobytes()]
        return pa.table({"part": rows["part"][:1], **{n: [v] for n, v in zip(("x", "y", "first"), packed)}})

    shape = "part int, x binary, y binary, first binary"
    return stage(dealt.groupBy("part").applyInArrow(pack, shape), "quality-groups")


def over_groups(packed: DataFrame, function) -> list[np.ndarray]:
    """What ``function(part, x, y, first)`` gives for each group, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part, x, y, first in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, float).reshape(-1, len(NAMES))
                found = function(part, x, np.frombuffer(y, np.int8), np.frombuffer(first, np.int8) == 1)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    got = packed.select("part", "x", "y", "first").mapInArrow(run, "v binary").toArrow()
    return [np.frombuffer(v, float) for v in got["v"].to_pylist()]


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of tasks' sums, the same in whatever order they come but for the last digits."""
    return np.array([math.fsum(v) for v in zip(*parts)])


def kth(packed: DataFrame, raw, rank: int, low: float, high: float) -> float:
    """The score of the given rank (from 0) among ``raw`` of all rows, between ``low`` and ``high``, by counts in
    ever narrower bins."""
    while low < high:
        edges = np.linspace(low, high, BINS + 1)
        if not (np.diff(edges) > 0).all():
            break

        def count(part, x, y, first):
            places = np.searchsorted(edges, raw(x[first]), "right")
            return np.bincount(places, minlength=BINS + 2).astype(float)

        below = np.cumsum(summed(over_groups(packed, count)))
        # Place k holds scores from edge k - 1 up to edge k.
        k = int(np.searchsorted(below, rank, "right"))
        if k > BINS:
            return high
        low, high = edges[k - 1], np.nextafter(edges[k], -np.inf)
        if high - low < 1e-12 * max(1.0, abs(low)):
            break
    return float(low)


def rounded(x: np.ndarray) -> np.ndarray:
    """Without the last digits, in which sums differ by the order of tasks."""
    with np.errstate(divide="ignore"):
        step = 10.0 ** (np.floor(np.log10(np.maximum(np.abs(x), 1e-30))) - 9)
    return np.round(x / step) * step


def train(marked: DataFrame, seed: int = 5, ridge: float = 1.0) -> Ranking:
    """Fit on all rows of ``marked(doc_id, x, y)``: the weights on ``PAIRS_EACH`` preference pairs for
    each row, drawn inside groups of rows, the means and the threshold on all rows.

    Each step of Newton's method is a Spark job over the groups that sends a gradient and a matrix
    of the size of the features to the driver.
    """
    size = len(NAMES)
    marked = stage(marked, "quality-labelled")
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Ranking(np.zeros(size), np.ones(size), np.zeros(size), 0.0, 1.0)
    packed, n = groups(marked, counts), sum(counts.values())
    mean = rounded(summed(over_groups(packed, lambda part, x, y, first: x[first].sum(axis=0))) / n)
    spread = summed(over_groups(packed, lambda part, x, y, first: ((x[first] - mean) ** 2).sum(axis=0)))
    scale = rounded(np.sqrt(spread / n)) + 1e-9
    w = np.zeros(size)
    for _ in range(60):

        def slopes(part, x, y, first, w=w):
            if y.min() == y.max():
                return np.zeros(size + size * size)
            z = np.clip((x - mean) / scale, -8, 8)
            better, worse = preference_pairs(y, seed + part, PAIRS_EACH * len(y))
            d = z[better] - z[worse]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            return np.concatenate([d.T @ (p - 1), ((d.T * (p * (1 - p) + 1e-9)) @ d).ravel()])

        total = summed(over_groups(packed, slopes))
        step = np.linalg.solve(total[size:].reshape(size, size) + ridge * np.eye(size), total[:size] + ridge * w)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    w = rounded(w)
    ranking = Ranking(mean, scale, w, 0.0, 1.0)
    # The threshold: the quantile of scores at the share of worse documents, between two scores.
    bound = float(np.abs(w).sum()) * 8 + 1
    at = min(max(counts[0], 1), n - 1)
    threshold = (kth(packed, ranking.raw, at - 1, -bound, bound) + kth(packed, ranking.raw, at, -bound, bound)) / 2
    # Steepness: the spread of pair differences is on the logistic scale already.
    return Ranking(mean, scale, w, threshold, 1.0)


def rank_quality(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per row of ``documents(doc_id, text)``: held_out, score (0 to 1, higher is better) and
    predicted (score at or above ``cut``).

    A null text counts as empty; an empty text is scored with all features 0. Without labels of both
    classes every text gets the score ``CUT``. Labels, lang, source and doc_id are no input.
    """
    doc = F.struct("doc_id", F.col("text").isNotNull().alias("known"))
    named = pick(documents, "doc_id", "text").select(doc.alias("doc"), "text")

    def describe():
        return lambda texts: {"x": [features(t) for t in texts]}

    # Features are computed once, for learning and for scoring.
    featured = stage(
        map_rows(named, describe, "x array<double>", keep="doc struct<doc_id: bigint, known: boolean>"),
        "quality-features",
    )
    ranking = train(labelled_features(documents, featured, training_labels(labels, "quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            columns = [batch.column(0), pa.array(ranking.score(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score"])

    scored = featured.select("doc.doc_id", "x").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )

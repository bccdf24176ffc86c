"""Toxic passages by maximum-scoring segments over token log-odds.

Training counts every word, and every word's first 3 to 7 letters, in toxic and other labelled
documents. A word's log-odds has the log-odds of its first letters as Dirichlet prior, these that of
one letter less, and so on, so rare and unseen forms lean on their stem. Less a fixed cost per word,
these scores have a negative mean, and one linear scan finds all maximal scoring segments of a
text: the disjoint segments that no extension improves. How high the best segment of an ordinary
text comes is a matter of extreme values: their distribution is fitted to the other labelled
documents, after the growth with the logarithm of the length is taken off. Segments beyond it are
significant; a document's evidence is the sum over them, and a logistic curve makes it a score.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import map_rows, pick, text_bytes
from servelens.llm.labels import bounded, held_out, labelled_texts, training_labels
from servelens.worker import per_worker

TOKEN = re.compile(r"[^\W\d_]+")
#: A word is counted whole and by its first letters, each in a table of fixed size: (letters, places,
#: prior occurrences at the log-odds of the level before).
LEVELS = ((3, 1 << 14, 40.0), (4, 1 << 16, 20.0), (5, 1 << 16, 10.0), (6, 1 << 17, 6.0), (7, 1 << 17, 4.0), (None, 1 << 18, 3.0))
OFFSETS = tuple(sum(size for _, size, _ in LEVELS[:k]) for k in range(len(LEVELS)))
PLACES = sum(size for _, size, _ in LEVELS)
#: Cost of a word in nats: log-odds below it do not pay for an extension.
COST = 1.0
#: Words in which repeats of a word are discounted.
NEAR = 32
#: Chance, per text, that an ordinary text has a segment this high.
SIGNIFICANT = 0.1
LEAST = -math.log10(SIGNIFICANT)
#: Segments of a fitted document whose scores go to the driver, best first.
SENT = 32
#: Counts by half and class.
COUNTS = ("n00", "n01", "n10", "n11")
#: Most labelled documents that words are counted in, and that the curves are fitted to.
COUNTED, FITTED = 200_000, 20_000


def places_of(word: str) -> list[int]:
    """The places of a word's beginnings and of itself, general to special."""
    return [
        offset + zlib.crc32(word[:letters].encode()) % size
        for offset, (letters, size, _) in zip(OFFSETS, LEVELS)
    ]


def half_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(2)).cast("int")


def count_words(rows: DataFrame) -> np.ndarray:
    """Texts that hold a word by (half, class, place) in ``rows(text, y, half)``.

    Each task sums its rows into an array of fixed size, so at most that many rows per task are
    shuffled, and the result on the driver is bounded by the table sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, PLACES), np.int64)
        for batch in batches:
            words: list[Counter] = [Counter() for _ in COUNTS]
            for text, y, half in zip(*(c.to_pylist() for c in batch.columns)):
                words[2 * half + y].update(set(TOKEN.findall(text.decode().lower())))
            for row, counter in zip(sums, words):
                if counter:
                    at = np.array([places_of(w) for w in counter])
                    times = np.repeat(np.fromiter(counter.values(), np.int64), len(LEVELS))
                    row += np.bincount(at.ravel(), times, PLACES).astype(np.int64)
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *[pa.array(s[at]) for s in sums]], names=["place", *COUNTS]
        )

    parts = rows.select(text_bytes().alias("text"), "y", "half").mapInArrow(
        run, "place long, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    total = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in COUNTS]).toArrow()
    sums = np.zeros((4, PLACES))
    sums[:, total.column("place").to_numpy()] = [total.column(c).to_numpy() for c in COUNTS]
    return sums.reshape(2, 2, -1)


def log_odds(n1: float, n0: float, prior: float, rate: float, totals: tuple[float, float]) -> float:
    """Log of (rate in class 1 / rate in class 0). ``prior`` pseudo-occurrences are split between
    the classes so that they alone would give the log-odds ``rate``."""
    odds = math.exp(rate) * totals[1] / totals[0]
    toxic = prior * odds / (1 + odds)
    return math.log((n1 + toxic) / totals[1]) - math.log((n0 + prior - toxic) / totals[0])


def segments(
    positions: list[int], gains: list[float], before: list[float]
) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last position), in linear time.

    ``gains`` are the positive scores, at ascending ``positions``, and ``before`` the running sums
    of all scores up to each of them. Candidates are kept with the sums before (low) and after
    (high) them and the nearest earlier candidate of a smaller low; a new one joins with the
    nearest candidate of a smaller low, and all between, if its own high is larger.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    for position, gain, low in zip(positions, gains, before):
        high, first = low + gain, position
        while True:
            near = len(kept) - 1
            while near >= 0 and kept[near][0] >= low:
                near = kept[near][4]
            if near < 0 or kept[near][1] >= high:
                kept.append((low, high, first, position, near))
                break
            low, first = kept[near][0], kept[near][2]
            del kept[near:]
    return [(high - low, first, last) for low, high, first, last, _ in kept]


@dataclass(frozen=True)
class ToxicModel:
    """Counts by class and place, and the fitted curves; its size doesn't depend on the corpus."""

    counts: np.ndarray
    totals: tuple[float, float]
    growth: float = 0.0  # of an ordinary text's best segment with log(words)
    location: float = 0.0
    scale: float = 1.0
    slope: float = 1.0
    intercept: float = 0.0

    def scorer(self) -> Callable[[str], float]:
        """Word to its log-odds less the cost of a word."""
        n0, n1 = self.counts
        totals, priors = self.totals, [prior for *_, prior in LEVELS]

        def score(word: str) -> float:
            rate = 0.0
            for at, prior in zip(places_of(word), priors):
                rate = log_odds(float(n1[at]), float(n0[at]), prior, rate, totals)
            return rate - COST

        return score

    def evidence(self, best: float, n: int) -> float:
        """-log10 of the chance that an ordinary text of ``n`` words has a segment this high."""
        z = (best - self.growth * math.log(n + 1) - self.location) / self.scale
        # 1 - exp(-exp(-z)) by the Gumbel distribution, which is exp(-z) where that is small.
        return z / math.log(10) if z > 30 else -math.log10(max(-math.expm1(-math.exp(-max(z, -6.0))), 1e-300))

    def total(self, scores: list[float], n: int) -> tuple[float, list[float]]:
        """The sum over significant segments, or the best one's evidence, and that of each."""
        parts = [self.evidence(s, n) for s in scores]
        significant = sum(e for e in parts if e >= LEAST)
        return significant or max(parts, default=self.evidence(0.0, n)), parts

    def probability(self, evidence: float) -> float:
        x = self.slope * evidence + self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class Scanner:
    """Find segments with a model, remembering the scores of up to ``most`` words."""

    def __init__(self, model: ToxicModel, most: int = 200_000):
        self.model, self.most = model, most
        self.score = model.scorer()
        self.scores: dict[str, float] = {}

    def find(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """The number of words, and the maximal segments."""
        words, scores = TOKEN.findall(text.lower()), self.scores
        if not words:
            return 0, []
        try:
            net = np.array([scores[w] for w in words])
        except KeyError:
            if len(scores) > self.most:
                scores.clear()
            for w in set(words).difference(scores):
                scores[w] = self.score(w)
            net = np.array([scores[w] for w in words])
        at = np.flatnonzero(net > 0)
        if not len(at):
            return len(words), []
        # A word's k-th occurrence among NEAR words counts 1/k: only repeats close by are no further
        # evidence, so a passage counts the same wherever it stands.
        recent: dict[str, deque[int]] = {}
        for p in at.tolist():
            places = recent.setdefault(words[p], deque())
            while places and p - places[0] >= NEAR:
                places.popleft()
            places.append(p)
            net[p] /= len(places)
        gains = net[at]
        before = np.cumsum(net)[at] - gains
        return len(words), segments(at.tolist(), gains.tolist(), before.tolist())

    def judge(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """Evidence of the whole text, and its significant segments with their own."""
        n, found = self.find(text)
        total, parts = self.model.total([s for s, _, _ in found], n)
        return total, [(e, first, last) for e, (_, first, last) in zip(parts, found) if e >= LEAST]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(
            (a.T * (p * (1 - p) + 1e-9)) @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * w
        )
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def model_of(counts: np.ndarray) -> ToxicModel:
    words = counts[:, OFFSETS[-1] :].sum(axis=1) + 1
    return ToxicModel(counts.astype("float32"), (float(words[0]), float(words[1])))


def train(
    documents: DataFrame, labels: DataFrame, counted: int = COUNTED, fitted: int = FITTED
) -> ToxicModel:
    """Fit on labelled rows outside the held-out fold. Words are counted in at most about ``counted``
    of them; the curves use at most about ``fitted``, of which a few numbers a row go to the driver:
    the scores of a text's ``SENT`` best segments, so a text with more is fitted by these.

    Rows are in two halves: those of one are fitted with the counts of the other, so that a
    word that occurs in one document only does not vouch for it.
    """
    marks = bounded(training_labels(labels, "toxic"), counted)
    rows = labelled_texts(documents, marks).withColumn("half", half_of(F.col("doc_id")))
    counts = count_words(rows)
    bare = model_of(counts.sum(axis=0))
    # Plain values: a broadcast is unpickled where this package may not be installed.
    shared = rows.sparkSession.sparkContext.broadcast([vars(model_of(counts[h])) for h in (1, 0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(ToxicModel(**m)) for m in shared.value]
        for batch in batches:
            texts, halves = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = [scanners[h].find(t.decode()) for t, h in zip(texts, halves)]
            scores = [sorted((s for s, _, _ in parts), reverse=True)[:SENT] for _, parts in found]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["n", "scores", "y"])

    sample = labelled_texts(documents, bounded(marks, fitted)).select(
        text_bytes().alias("text"), "y", half_of(F.col("doc_id")).alias("half")
    )
    got = sample.mapInArrow(run, "n long, scores array<double>, y int").toArrow()
    n, y, scores = got.column("n").to_numpy(), got.column("y").to_numpy(), got.column("scores").to_pylist()
    best = np.array([max(x, default=0.0) for x in scores])
    if not len(y) or y.min() == y.max():
        return bare
    # Ordinary texts: the best segment's median grows with log(n); the rest is Gumbel, fitted to
    # quartiles, which a few mislabelled or odd texts don't move.
    plain = y == 0
    logs, ordinary = np.log(n[plain] + 1), best[plain]
    edges = np.unique(np.quantile(logs, np.linspace(0, 1, 9)))
    bins = np.clip(np.searchsorted(edges, logs, "right") - 1, 0, max(len(edges) - 2, 0))
    centres = np.array([(logs[bins == k].mean(), np.median(ordinary[bins == k])) for k in np.unique(bins)])
    growth = max(0.0, float(np.polyfit(*centres.T, 1)[0])) if len(centres) > 1 else 0.0
    low, middle, high = np.quantile(ordinary - growth * logs, [0.25, 0.5, 0.75])
    scale = max(float(high - low) / 1.5725, 0.25)  # of the quartiles of the standard Gumbel
    location = float(middle) - 0.3665 * scale
    curve = replace(bare, growth=growth, location=location, scale=scale)
    evidence = np.array([curve.total(x, k)[0] for x, k in zip(scores, n)])
    slope, intercept = fit_logistic(np.minimum(evidence, 20.0), y.astype(float))
    return replace(curve, slope=max(slope, 1e-6), intercept=intercept)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    counted: int = COUNTED,
    fitted: int = FITTED,
) -> DataFrame:
    """One row per row of ``documents(doc_id, text)``: held_out, score, predicted (score at or above
    ``threshold``), n_passages and passages, the significant segments as arrays of (first, last)
    word, words being runs of letters. A positive word counts 1/k at its k-th occurrence among the
    last NEAR words; repeats further apart count in full.

    A null text counts as empty and gets the score of a text without a segment. Without labels of
    both classes every text gets a score by the unfitted curve. Labels, lang and source are no input.
    """
    model = train(documents, labels, counted, fitted)
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    number = uuid.uuid4().hex

    def make():
        scanner = per_worker("toxicity", number, lambda: Scanner(ToxicModel(**shared.value)))

        def run(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"score": [], "n_passages": [], "passages": []}
            for text in texts:
                evidence, toxic = scanner.judge(text.decode())
                out["score"].append(scanner.model.probability(evidence))
                out["n_passages"].append(len(toxic))
                out["passages"].append([{"first": a, "last": b} for _, a, b in toxic])
            return out

        return run

    scored = map_rows(
        pick(documents, "doc_id", "text"),
        make,
        "score double, n_passages int, passages array<struct<first: int, last: int>>",
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_passages",
        "passages",
    )

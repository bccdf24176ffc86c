"""Ranked lexical search: exact best documents for each item, by posting lists in geometric blocks.

Documents become vectors of impacts (one integer per term and document) over the terms that are asked
for. Every task takes its documents in shards. In a shard a posting list is cut into blocks of similar
documents when it is first asked for: some of its documents are pivots, each document goes to the pivot
with the largest cosine, and a block keeps the coordinatewise maximum of its documents' impacts. An item
goes through the lists of its terms from the largest possible contribution down. A block is read only
if the item's weights times its maxima reach the worst score of the best ten so far; lists are left when
what they and those after them can add stays below it. Both bounds are exact, so no document is lost.

Postings never leave the task that made them: a hot term is spread over all tasks, and only the best of
each task and item are shuffled. The items are handled in blocks of a bounded size, each of which is
one pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servelens.llm.common import map_rows, pick
from servelens.operators.skew import top_n_per_key
from servelens.session import stage

#: Terms of a lower-cased UTF-8 text: runs of letters and digits of ASCII and of anything beyond it.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PIECE = 1 << 20
#: Most text of items that goes to the tasks at once (an item's own text may be longer).
ITEM_BYTES = 1 << 20
#: Numbers of a shard's table of documents and terms; documents of a block; items of more terms share
#: the summaries over all terms.
CELLS, BLOCK, WIDE = 6 << 20, 64, 1024

FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, cut where no term is."""
    start = 0
    while len(text) - start > most:
        cut = BREAK.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def terms_of(text: bytes) -> set[bytes]:
    return {t for piece in pieces(text) for t in TERM.findall(piece.lower())}


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row of ``docs(doc_id, text)``: the number of all its terms with
    repeats, and places in the vocabulary with their counts."""

    def make():
        place = {t: i for i, t in enumerate(vocabulary)}

        def run(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"n": [], "terms": [], "tfs": []}
            for text in texts:
                n, counts = 0, Counter()
                for piece in pieces(text):
                    found = TERM.findall(piece.lower())
                    n += len(found)
                    counts.update(filter(place.__contains__, found))
                out["n"].append(n)
                out["terms"].append([place[t] for t in counts])
                out["tfs"].append(list(counts.values()))
            return out

        return run

    return map_rows(docs, make, "n bigint, terms array<int>, tfs array<int>")


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one occurrence list adds to a score for each unit of its term's weight."""
    m = 100 - 90 + 90 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The best ``k`` (score, document) of an item so far; ties go to the smaller id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    @property
    def bound(self) -> int:
        """Scores below this can't come in any more; only positive scores count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fit = scores >= self.bound
        if not fit.any():
            return
        scores, ids, null = (
            np.concatenate([a, b[fit]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.null, null))
        )
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


class Shard:
    """Some documents of a task, with the posting lists over them."""

    def __init__(self, ids, null, rows, terms, values, weights: np.ndarray, together: list[np.ndarray]):
        self.ids, self.null, self.weights, self.together = ids, null, weights, together
        self.table = np.zeros((len(ids), len(weights)), np.int32)
        self.table[rows, terms] = values
        self.top = self.table.max(axis=0).astype(np.int64) * weights
        order = np.argsort(terms, kind="stable")
        self.listed, self.starts = rows[order], np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.blocked: dict[int, tuple] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, where blocks start, summary) of a term's list: a row of the summary has the
        largest impact in the block of each term that some item has together with this one."""
        if term not in self.blocked:
            docs = self.listed[self.starts[term] : self.starts[term + 1]]
            vectors = self.table[docs][:, self.together[term]]
            starts = np.zeros(1, np.int64)
            if len(docs) > BLOCK:
                pivots = np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(int)
                weighed = vectors * self.weights[self.together[term]].astype(np.float32)
                heads = weighed[pivots]
                heads = heads / np.maximum(np.linalg.norm(heads, axis=1, keepdims=True), 1)
                nearest = np.argmax(weighed @ heads.T, axis=1)
                order = np.argsort(nearest, kind="stable")
                docs, vectors, nearest = docs[order], vectors[order], nearest[order]
                starts = np.flatnonzero(np.diff(nearest, prepend=-1))
            self.blocked[term] = docs, starts, np.maximum.reduceat(vectors, starts, axis=0)
        return self.blocked[term]

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Put what this shard has for an item with these terms into ``best``."""
        here = terms[self.top[terms] > 0]
        here = here[np.argsort(-self.top[here], kind="stable")]
        ahead = np.cumsum(self.top[here][::-1])[::-1]
        weights, unseen = self.weights[here], np.ones(len(self.ids), bool)
        for i, term in enumerate(here.tolist()):
            if ahead[i] < best.bound:
                return
            docs, starts, summary = self.blocks(term)
            # Documents with an earlier term have been scored, or ruled out with a bound of theirs.
            rest = np.searchsorted(self.together[term], here[i:])
            bounds = summary[:, rest].astype(np.int64) @ weights[i:]
            stops = np.append(starts[1:], len(docs))
            turn = np.argsort(-bounds, kind="stable")
            for at in range(0, len(turn), 4):
                now = [b for b in turn[at : at + 4].tolist() if bounds[b] >= best.bound]
                if not now:
                    break
                found = np.concatenate([docs[starts[b] : stops[b]] for b in now])
                found = found[unseen[found]]
                unseen[found] = False
                scores = self.table[np.ix_(found, here)].astype(np.int64) @ weights
                best.add(scores, self.ids[found], self.null[found])


def _together(items: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each term the terms that some item has with it, itself included, in order."""
    met: list[set[int] | None] = [set() for _ in range(size)]
    for terms in items:
        for t in terms.tolist():
            if len(terms) > WIDE:
                met[t] = None
            elif met[t] is not None:
                met[t].update(terms.tolist())
    every = np.arange(size)
    return [every if m is None else np.array(sorted(m), np.int64) for m in met]


def _search_block(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """The best ``k`` of every task for each item (item_id, text)."""
    asked = [terms_of(text) for _, text in items]
    vocabulary = sorted(set().union(*asked))
    place = {t: i for i, t in enumerate(vocabulary)}
    lists = [np.array(sorted(place[t] for t in terms), np.int64) for terms in asked]
    names = [item_id for item_id, _ in items]
    table = stage(vectors(docs, vocabulary), "lexical-vectors")
    documents, total = table.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    # One row for each term that is asked for.
    counted = table.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in counted:
        weights[t] = term_weight(documents, df)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, best = _together(lists, len(weights)), [Best(k) for _ in lists]
        rows_of_shard = max(CELLS // max(len(weights), 1), 1)
        for batch in batches:
            for start in range(0, batch.num_rows, rows_of_shard):
                ids, n, terms, tfs = batch.slice(start, rows_of_shard).columns
                rows = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy())
                terms, tfs = (pc.list_flatten(x).to_numpy().astype(np.int64) for x in (terms, tfs))
                values = impacts(tfs, n.to_numpy()[rows], documents, total)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                shard = Shard(ids, null, rows, terms, values, weights, together)
                for item, found in zip(lists, best):
                    shard.search(item, found)
        out: list[list] = [[], [], [], []]
        for i, b in enumerate(best):
            kept = (None if null else d for d, null in zip(b.ids.tolist(), b.null.tolist()))
            for column, values in zip(out, ([i] * len(b.ids), [names[i]] * len(b.ids), kept, b.scores.tolist())):
                column.extend(values)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, kind) for c, kind in zip(out, kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return table.where("size(terms) > 0").mapInArrow(search, FOUND)


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best rows of ``documents(doc_id, text)`` for each
    distinct row of ``items(item_id, text)``; fewer where fewer have a score above 0.

    Equal scores rank by doc_id, null last. Rows of one doc_id are documents of their own. Null and
    empty texts have no terms: they aren't counted among the documents and find nothing. Items with
    equal ids and different texts have a ranking each. Other columns don't matter. Empty tables give no
    rows.
    """
    docs = pick(documents, "doc_id", "text")
    wanted = pick(items, "item_id", "text").where("text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // ITEM_BYTES) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    out = []
    for b in range(blocks):
        # At most about ITEM_BYTES of text come to the driver.
        rows = [(r.item_id, r.text.encode()) for r in wanted.where(block == b).collect()]
        found = _search_block(docs, sorted(rows, key=str), k)
        best = top_n_per_key(found, ["item", "item_id"], order, k, ["doc_id", "score"])
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "item_id").orderBy(*order)))
        out.append(ranked.select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)

"""The pipeline's near copies, against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
import pytest

from servelens.llm import near_copies, simhash


def sets_of(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]


def smallest_ids(ids, texts):
    """The smallest id of each group, comparing all pairs."""
    root, sets = {i: i for i in ids}, sets_of(texts)
    for (i, a), (j, b) in combinations(zip(ids, sets), 2):
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


@pytest.mark.parametrize("block", [3, near_copies.BLOCK])
def test_stage_drops_copies_that_simhash_keeps(spark, block):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(12)]
    for text in texts[:8]:  # chains, whose ends may be unlike each other
        words = text.split()
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", None, "two words", "Two  WORDS", texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = smallest_ids(*zip(*sorted(rows)))
    assert {r.doc_id for r in near_copies.keep_one(docs, block).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} > want


def test_equal_rows_are_read_once(spark, monkeypatch):
    """300 equal rows and a neighbour of theirs are two sets."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words))] * 300 + [(2, " ".join([*words[:99], "x"])), (3, "other words alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    found = near_copies.wanted_texts
    monkeypatch.setattr(near_copies, "wanted_texts", lambda *a: seen.append(found(*a)) or seen[-1])
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {1, 3}
    assert near_copies.keep_one(docs).count() == 2 and seen[0].count() == 2


def test_stage_of_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    kept = corpus_pipeline.without_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest_ids(*zip(*sorted(rows))))


def test_near_copies_awkward_rows(documents, nothing):
    kept = near_copies.keep_one(documents)
    assert kept.columns == documents.columns
    # The null, empty and blank texts are one group, and equal rows with an id are one.
    assert kept.count() == 6
    assert near_copies.keep_one(nothing).count() == 0

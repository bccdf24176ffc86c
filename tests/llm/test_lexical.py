"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from servelens.llm import lexical
from servelens.llm.queries import QUERIES

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERMS.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    number, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for (doc_id, c), n in zip(counted, sizes):
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * number) // total
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=600, n_items=15):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, share, k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(n)]
    items = [(i, " ".join(rng.choices(words, share, k=rng.choice([1, 8, 30])))) for i in range(n_items)]
    for i, text in items[:5]:  # passages inside documents, and copies
        for at in rng.choices(range(n), k=4):
            texts[at] += " " + text
    texts[:4] = [texts[9]] * 4
    docs = [(rng.choice([i, i, i, None, 7]), t) for i, t in enumerate(texts)]
    return docs, items


@pytest.mark.parametrize(("seed", "cells", "block"), [(1, lexical.CELLS, lexical.BLOCK), (2, 20_000, 8), (3, 300, 2)])
def test_search_equals_scoring_all(spark, monkeypatch, seed, cells, block):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 200)
    monkeypatch.setattr(lexical, "WIDE", 6)
    docs, items = corpus(4, 80, 9)
    items += [items[0], (items[0][0], "w1 w2"), (None, "w3"), (77, None), (78, ""), (79, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = [i for i in items if i[1] is not None]
    assert result(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), 3)) == brute(docs, wanted, 3)


def shard_of(docs, vocabulary, weights, together):
    rows, cols, values = [], [], []
    for r, doc in enumerate(docs):
        for t, v in doc.items():
            rows.append(r), cols.append(t), values.append(v)
    ids = np.arange(len(docs))
    return lexical.Shard(ids, ids < 0, *map(np.array, (rows, cols, values)), weights, together)


def test_summaries_bound_their_blocks_and_prune():
    rng = random.Random(8)
    docs = []
    for topic in range(20):  # topics that share term 0
        own = range(1 + topic * 5, 6 + topic * 5)
        docs += [{0: rng.randint(1, 5)} | {t: rng.randint(1, 900) for t in own} for _ in range(100)]
    rng.shuffle(docs)
    size = 101
    shard = shard_of(docs, size, np.ones(size, np.int64), [np.arange(size)] * size)
    listed, starts, summary = shard.blocks(0)
    assert sorted(listed.tolist()) == list(range(2000)) and len(starts) >= 20
    for a, b, most in zip(starts, np.append(starts[1:], len(listed)), summary):
        assert (shard.table[listed[a:b]].max(axis=0) == most).all()
    # A block holds one topic, as a rule: that is what makes bounds tight.
    assert np.median((summary > 0).sum(axis=1)) == 6


def test_pieces_keep_terms():
    text = ("wörd " * 1000 + "x" * 3000 + "," + "Ab1 " * 500).encode()
    whole = lexical.TERM.findall(text.lower())
    parts = list(lexical.pieces(text, 700))
    assert [t for p in parts for t in lexical.TERM.findall(p.lower())] == whole and len(parts) > 5


def test_awkward_rows(spark, documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    items = [(1, "the quick dog of an orphan word, 1111"), (2, "é 中文 ñ")]
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    for name in ("item", "rank", "terms", "n"):
        documents = documents.withColumn(name, F.lit(1))
    assert result(lexical.search(documents, wanted)) == brute(rows, items)
    assert lexical.search(nothing, wanted).collect() == []
    assert lexical.search(documents, wanted.where("1 = 0")).collect() == []


def test_query(spark, sf_dir):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert result(QUERIES["op13_geometric_blocks"](spark, sf_dir)) == want

"""Candidates of near copies by pigeonring over fingerprints."""

from __future__ import annotations

import random

import numpy as np

from servelens.llm import near_copies

NODES = "node long, n long, fp long, keys array<long>"


def test_fingerprints_within_three_bits_are_candidates(spark):
    """Without any band: 1 and 2 are three bits apart, 2 and 3 two, 4 eight or more from all, 5 equals 4; 6 and 7
    are equal fingerprints of empty sets, which are nobody's candidates."""
    fp = 0x0123_4567_89AB_CDEF
    prints = [fp, fp ^ 0x8001_0001, fp ^ 0x8001_0301, fp ^ 0xF0F0_0000, fp ^ 0xF0F0_0000, 0, 0]
    rows = [(i + 1, 0 if i > 4 else 9, near_copies.signed(p), []) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, NODES)
    edges = {tuple(sorted((r.u, r.v))) for r in near_copies.candidates(nodes).where("u != v").collect()}
    assert edges == {(1, 2), (2, 3), (4, 5)}
    assert {tuple(r) for r in near_copies.clusters(nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_copies_are_found_without_bands(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        rows.append((10 * k, " ".join(words)))
        words[rng.randrange(3000)] = "changed"
        rows.append((10 * k + 1, " ".join(words)))
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    bits = [bin(near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).count("1") for a, b in zip(sets[::2], sets[1::2])]
    want = {i for i, _ in rows[::2]} | {rows[2 * k + 1][0] for k, b in enumerate(bits) if b > 3}
    assert sum(b <= 3 for b in bits) >= 4
    monkeypatch.setattr(near_copies, "band_keys", lambda marks: [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def test_fingerprint_is_the_majority_of_bits():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, near_copies.COUNTED + 3):
        marks = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        bits = [int(2 * int((marks >> np.uint64(b) & np.uint64(1)).sum()) > len(marks)) for b in range(64)]
        assert bin(near_copies.fingerprint(marks)).count("1") == sum(bits)
    assert near_copies.fingerprint(np.zeros(0, np.uint64)) == 0

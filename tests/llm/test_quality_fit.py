"""The Bradley-Terry fit against a plain solver, and a text's features against plain counting."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from servelens.llm import quality_rank


def loss_gradient(w, z, better, worse, ridge):
    """Of the pairs' negative log likelihood with a ridge, pair by pair."""
    out = ridge * w
    for b, c in zip(better.tolist(), worse.tolist()):
        d = z[b] - z[c]
        out = out - d / (1 + math.exp(d @ w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_are_the_likelihood_s_minimum(seed):
    """Plain gradient descent over single pairs comes to the same weights."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 4)) * [1, 5, 0.1, 2] + 3
    y = (x @ [1.0, -0.3, 4.0, 0.2] + rng.normal(size=60) > np.median(x @ [1.0, -0.3, 4.0, 0.2])).astype(int)
    ranking = quality_rank.fit(x, y, seed=5, pairs=150, ridge=1.0)
    better, worse = quality_rank.preference_pairs(y, 5, 150)
    assert set(y[better]) == {1} and set(y[worse]) == {0}
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8)
    w = np.zeros(4)
    for _ in range(1500):
        w = w - 0.01 * loss_gradient(w, z, better, worse, 1.0)
    assert np.abs(ranking.weights - w).max() < 1e-4
    assert np.abs(loss_gradient(ranking.weights, z, better, worse, 1.0)).max() < 1e-4
    # As many documents are at or above the threshold as are better ones.
    assert (ranking.raw(x) >= ranking.threshold).sum() == y.sum()


def counted(text):
    """Some of the features, one character and word at a time."""
    words = text.split()
    n, size = len(words), len(text)
    kinds = {
        "symbols": sum(c in quality_rank.SYMBOLS for c in text) / size,
        "digits": sum(48 <= c <= 57 for c in text) / size,
        "upper": sum(65 <= c <= 90 for c in text) / (sum(65 <= c <= 90 or 97 <= c <= 122 for c in text) + 1),
        "same_word": sum(words[i] == words[i + 1] for i in range(n - 1)) / n,
        "unique": len(set(words)) / n,
        "two_unique": len({(words[i], words[i + 1]) for i in range(n - 1)}) / n,
        "top_word": max(words.count(w) for w in words) / n,
        "long_words": sum(len(w) > 20 for w in words) / n,
        "words": math.log1p(n) / 10,
        "shouted": sum(w == w.upper() and w != w.lower() and len(w) > 2 for w in words) / n,
    }
    lines = [line for line in text.split(b"\n") if line.strip()]
    kinds["dup_lines"] = 1 - len(set(lines)) / max(1, len(lines))
    return kinds


def test_features_equal_plain_counts():
    rng = random.Random(4)
    pool = [b"a", b"The", b"LOUD", b"x1", b"$$$", b"|", b"http://a.b", b"word" * 6, b"end.", b"wow!", "é".encode()]
    for n in (1, 2, 40, 41, 300):
        text = b"".join(rng.choice(pool) + rng.choice([b" ", b"\n", b"\n\n", b"\t"]) for _ in range(n))
        found = dict(zip(quality_rank.NAMES, quality_rank.features(text)))
        assert len(found) == len(quality_rank.NAMES)
        for name, value in counted(text).items():
            assert found[name] == pytest.approx(value), name
    assert quality_rank.features(b" \n ") == [0.0] * len(quality_rank.NAMES)

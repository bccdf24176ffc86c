"""Toxic passages that repeat in a long text."""

import numpy as np

from servelens.llm import toxicity


def test_equal_passages_count_the_same():
    model = toxicity.ToxicModel(np.zeros((2, toxicity.PLACES), "float32"), (1.0, 1.0))
    scanner = toxicity.Scanner(model)
    scanner.score = lambda word: 2.0 if word.startswith("t") else -1.0
    passage, rest = "ta tb tc td te ", "plain " * 60
    n, found = scanner.find((passage + rest) * 9)
    assert n == 9 * 65 and [s for s, _, _ in found] == [10.0] * 9
    assert len(scanner.judge((passage + rest) * 9)[1]) == 9
    # Repeats close by are still discounted.
    assert scanner.find("ta ta ta")[1][0][0] == 2.0 + 1.0 + 2.0 / 3

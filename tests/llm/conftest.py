from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward rows: nulls everywhere, empty and blank texts, repeats, ties, a very long text, and
    columns whose names clash with what the operators add or differ in case only."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today."),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, "word " * 30_000),
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today."),
        (None, "an orphan text without an id, mail me at a.b@c.de or +1 (555) 123-4567 please"),
        (None, None),
        (6, "é ü 🙂 中文   ñ"),
        (7, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and 4111 1111 1111 1111 here"),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 1 else f"s{k % 3}", 5) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("n_tokens", "score", "kept", "rid", "fp", "size", "target", "_0", "place", "copies"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

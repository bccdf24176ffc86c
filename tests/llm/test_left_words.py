"""Left words of personal data, far from it or long."""

from pyspark.sql import functions as F

from servelens.llm import pii


def test_left_word_is_whole(spark):
    long = "w" * 100_000
    texts = [f"mail{' ' * 500}a@b.de", f"x {long} a@b.de", "a@b.de", "one\n\t a@b.de"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.orderBy("i").select(pii._matches(F.col("text"), pii.EMAIL).alias("m")).collect()
    assert [r.m[0].left for r in rows] == ["mail", long, "", "one"]


def test_rounds_go_on_to_the_fixpoint(spark):
    """A chain of left words, each of which is trusted only by what the one before has lent, with the
    production threshold."""
    tokens = []
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    base = [(names[0], f"seed-000{k}@x.y") for k in range(30)]
    for k, (name, after) in enumerate(zip(names, names[1:])):
        shared = [f"id{k}-{i:04d}" for i in range(4)]
        tokens += [(name, i) for i in shared] + [(after, i) for i in shared]
        base += [(after, f"seed-{k}-00{i}@x.y") for i in range(26 - k) if after != names[-1]]
    make = lambda rows: spark.createDataFrame(rows, "left string, found string")
    found = lambda rounds: {r.pattern for r in pii.accepted_patterns(make(base), make(tokens), rounds=rounds).collect()}
    every = found(None)
    assert found(1) <= found(3) <= every == found(20)
    assert "delta" in every - found(3)

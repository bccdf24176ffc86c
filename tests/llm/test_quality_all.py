"""Quality weights and threshold come from all labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from servelens.llm import quality_rank
from servelens.llm.labels import training_labels


def test_every_labelled_document_counts(spark, monkeypatch):
    """30,000 labelled texts, one in 300 of them bad: more than any sample, with a rare class."""
    monkeypatch.setattr(quality_rank, "GROUP", 2_000)
    n = F.col("doc_id")
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id").withColumn(
        "text", F.when(n % 300 == 0, F.concat(F.lit("$$$ ### BUY NOW "), n)).otherwise(F.concat(F.lit("a plain line of "), n, F.lit(" words.")))
    ).repartition(4)
    labels = docs.select("doc_id", F.when(n % 300 == 0, 0).otherwise(1).alias("quality"))
    trained, made = [], quality_rank.train
    monkeypatch.setattr(quality_rank, "train", lambda *a: trained.append(made(*a)) or trained[-1])
    out = quality_rank.rank_quality(docs, labels).select("doc_id", "score", "predicted").toArrow()
    marks = {r.doc_id for r in training_labels(labels, "quality").collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    x = np.array([quality_rank.features(texts[i]) for i in marks])
    assert np.allclose(trained[0].mean, x.mean(axis=0), rtol=1e-8) and np.allclose(trained[0].scale, x.std(axis=0), atol=1e-8)
    raw, bad = np.sort(trained[0].raw(x)), sum(i % 300 == 0 for i in marks)
    assert np.isclose(trained[0].threshold, raw[bad - 1 : bad + 1].mean(), atol=1e-9)
    assert all(p == (i % 300 != 0) for i, p in zip(out["doc_id"].to_pylist(), out["predicted"].to_pylist()))

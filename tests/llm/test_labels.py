"""Bounds on what is learned from."""

from servelens.llm import labels


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.range(5000).selectExpr("7L as doc_id", "concat('text ', 4999 - id) as text", "id as n")
    docs = docs.unionByName(spark.createDataFrame([(8, "b", 1), (9, None, 2), (None, "c", 3)], "doc_id long, text string, n long"))
    marks = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 1), (10, 1)], "doc_id long, y int")
    found = labels.labelled_texts(docs, labels.bounded(marks, 10)).collect()
    assert sorted(tuple(r) for r in found) == [(7, "text 0", 0), (7, "text 0", 1), (8, "b", 0)]

"""Labelled documents for training: which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelens.llm.common import pick
from servelens.session import stage

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0. Without an id
    there is no label either; such rows count as held out."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels outside the held-out fold; a document with several has each. Rows
    with a null id or label are left out."""
    return (
        pick(labels, "doc_id", label)
        .where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .distinct()
    )


def bounded(marks: DataFrame, most: int) -> DataFrame:
    """All of ``marks(doc_id, y)``, or a share of about ``most`` of them by a hash of the id: the
    same rows at every run, and never more than one tenth over ``most``."""
    total = marks.count()
    if total <= most:
        return marks
    mixed = F.xxhash64("doc_id", F.lit(29)).bitwiseAND(F.lit((1 << 32) - 1))
    return marks.where(mixed < int(most / total * (1 << 32))).limit(most + most // 10)


def labelled_texts(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, y) for ``marks`` from :func:`bounded`, one row at most for each of them: of rows
    with equal ids the smallest text counts. The bound of the marks makes the broadcasts safe; only
    texts whose id comes more than once are shuffled. Null texts teach nothing and are left out."""
    docs = pick(documents, "doc_id", "text").where("text is not null")
    ids = pick(documents, "doc_id").join(F.broadcast(marks.select("doc_id").distinct()), "doc_id")
    again = stage(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "label-repeats")
    marked = docs.join(F.broadcast(marks), "doc_id")
    least = (
        marked.join(F.broadcast(again), "doc_id", "left_semi")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )
    once = marked.join(F.broadcast(again), "doc_id", "left_anti")
    return once.select("doc_id", "text", "y").unionByName(least)

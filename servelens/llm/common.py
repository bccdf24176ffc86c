"""Reading the corpus tables, and Arrow mapping over (doc_id, text) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word of the corpus: a run of characters other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact spelling, whatever else ``df`` carries.

    Columns are first renamed by position, so names that differ in case only, or that are equal to
    an operator's own columns, do no harm; of two equal names the first counts.
    """
    here = df.columns
    bare = df.toDF(*[f"_{i}" for i in range(len(here))])
    return bare.select(*[bare[f"_{here.index(n)}"].alias(n) for n in names])


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


#: Bytes of texts that a function gets at a time; a longer text comes alone.
PART_BYTES = 4 << 20


def parts(texts: pa.Array, most_bytes: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts (UTF-8) of at most ``most_bytes`` together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most_bytes:
            yield start, at
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], dict[str, list]]],
    schema: str,
    keep: str = "doc_id bigint",
) -> DataFrame:
    """Apply a function over the texts (UTF-8, null as empty) of ``df(<keep>, text)`` by Arrow batch.

    ``make`` runs once per task and returns the function, which may hold caches; it gets a few
    megabytes of texts at a time and returns one list for each column of ``schema``. Batches are
    bounded by Spark's Arrow limits, so memory does not grow with the partition.
    """
    held = keep.split()[0]
    target = StructType.fromDDL(f"{keep}, {schema}")
    arrow = to_arrow_schema(target)
    fields = arrow.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start, stop in parts(batch.column(1)):
                part = batch.slice(start, stop - start)
                out = function(part.column(1).to_pylist())
                columns = [part.column(0)]
                columns += [pa.array(out[f], arrow.field(f).type) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(held, text_bytes().alias("text")).mapInArrow(run, target)

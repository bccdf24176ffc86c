"""Batch scoring: a model is initialised once per worker and run over column batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servelens.functions.requests import split_model_ref
from servelens.worker import per_worker

ModelFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def identity_model() -> Callable[[np.ndarray], np.ndarray]:
    """The smoke-test model: output tensor equals input tensor."""
    return lambda batch: batch


def score_batch(
    df: DataFrame,
    model: ModelFactory,
    input_col: str,
    width: int,
    output_col: str = "score",
    batch_size: int = 1024,
) -> DataFrame:
    """Run one model over a fixed-width array<float> column."""
    predict = predict_batch_udf(
        model,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(output_col, predict(F.col(input_col)))


def score_routed(
    df: DataFrame,
    models: dict[str, ModelFactory],
    model_col: str,
    input_col: str,
    output_col: str = "score",
    cluster_salts: int | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Rows name their model (``base`` or ``base#lora``); each batch is split by base model.

    Nothing is grouped, so a base model holding most rows stays spread over all tasks. With
    ``cluster_salts`` rows are first clustered by (base, salt), which lowers the number of models
    a worker loads while still splitting each of them. A row whose base has no model scores null.
    """
    routed = df.withColumn("__base", split_model_ref(model_col)["base"])
    if cluster_salts:
        salt = F.pmod(F.xxhash64(row_id or input_col), F.lit(cluster_salts))
        routed = routed.repartition("__base", salt)
    schema = T.StructType(
        [*df.schema.fields, T.StructField(output_col, T.ArrayType(T.FloatType()), True)]
    )

    call = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = per_worker("models", call, dict)
        for pdf in batches:
            scores = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for base, part in pdf.groupby("__base", sort=False):
                if base not in models:
                    continue
                if base not in loaded:
                    loaded[base] = models[base]()
                out = loaded[base](np.stack(part[input_col].to_list()).astype(np.float32))
                scores.loc[part.index] = pd.Series(list(out), index=part.index)
            yield pdf.drop(columns="__base").assign(**{output_col: scores})

    return routed.mapInPandas(run, schema)

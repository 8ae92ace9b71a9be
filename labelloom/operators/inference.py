"""Model outputs for the rows of a table, in batches, each Python worker loading the model once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DataType

#: Takes one array for each input column (text as objects) and returns one of outputs, or one for each output field.
Predict = Callable[..., np.ndarray | Mapping[str, np.ndarray]]


def with_outputs(df: DataFrame, load: Callable[[], Predict], inputs: list[str | Column], name: str, kind: DataType, batch: int = 32, shapes: list[list[int] | None] | None = None) -> DataFrame:
    """df with what a model says of inputs as column name, of type kind (a struct for several outputs).

    load: makes the model's batch function; it runs once in each Python worker, so weights are read there, not sent.
    batch: rows in one call. shapes: for array columns the tensor shape of one row. Rows stay where they are, so
    prompts aren't shuffled; repartition before if partitions are too few for the machines that hold a model.
    """
    told = predict_batch_udf(load, return_type=kind, batch_size=batch, **({"input_tensor_shapes": shapes} if shapes else {}))
    return df.withColumn(name, told(*inputs))

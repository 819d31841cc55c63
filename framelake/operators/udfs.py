"""Metrics and models as user-defined functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.errors import INVALID_PARAMETER, LAYOUT, OperatorError
from framelake.operators.metrics import frame_pair
from framelake.schemas import FRAME, RGB
from framelake.session import ship_package


#: How Spark merges a state column of two batches.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def user_aggregate(
    rows: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame], state: dict[str, tuple[str, str]],
    finish: dict[str, Column],
) -> DataFrame:
    """A user's aggregate in two stages.

    ``partial`` sees one Arrow batch (``keys`` and all other columns) and returns one row per key with the ``state`` columns;
    Spark merges these by ``sum``, ``min`` or ``max`` (``state`` maps a name to its SQL type and merge), within a task and
    after the shuffle, and ``finish`` turns the merged state into results. So what is shuffled is one row per batch and key, and
    no key's rows meet in one Python call.
    """
    for name, (_, merge) in state.items():
        if merge not in MERGES:
            raise OperatorError(INVALID_PARAMETER, f"{name}: merge must be one of {sorted(MERGES)}")
    ship_package(rows.sparkSession)
    wanted = [*keys, *state]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{n}` {t}" for n, (t, _) in state.items())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield partial(batch)[wanted]

    merged = rows.mapInPandas(run, schema).groupBy(*keys).agg(*[MERGES[merge](n).alias(n) for n, (_, merge) in state.items()])
    return merged.select(*keys, *[c.alias(n) for n, c in finish.items()])


def metric_udaf(left: DataFrame, right: DataFrame) -> DataFrame:
    """The squared-error metric as a user aggregate: one state row per Arrow batch and frame."""

    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        batch["total"] = sum((batch[c] - batch[f"{c}2"]) ** 2 for c in RGB)
        batch["pixels"] = 1
        return batch.groupby(FRAME, as_index=False, sort=False, dropna=False)[["total", "pixels"]].sum()

    pairs = frame_pair(left, right).select(*FRAME, *RGB, *[f"{c}2" for c in RGB])
    return user_aggregate(
        pairs, FRAME, partial, {"total": ("DOUBLE", "sum"), "pixels": ("BIGINT", "sum")}, {"mse": F.col("total") / (F.col("pixels") * 3.0)},
    )


def batch_predict(tensors: DataFrame, make_predict: Callable, shape: tuple[int, ...], batch_size: int = 32) -> DataFrame:
    """Apply a user's model to CHW tensors; ``make_predict`` loads it once per worker.

    ``shape`` is channels, height and width of the model's input. A smaller frame is laid into its upper left corner and
    filled up with zeros, so results are in the layout of ``shape``; cells beyond ``width`` and ``height`` are not the frame's.
    Frames too large for the model are left out and listed by ``predict_errors``.
    """
    channels, height, width = shape
    fits = tensors.where(_fits(shape))
    i = F.sequence(F.lit(0), F.lit(channels * height * width - 1))

    def value(i: Column) -> Column:
        y, x = F.floor(i % (height * width) / width).cast("int"), i % width
        own = (F.floor(i / (height * width)).cast("int") * F.col("height") + y) * F.col("width") + x
        return F.when((y < F.col("height")) & (x < F.col("width")), F.get("tensor", own)).otherwise(F.lit(0.0).cast("float"))

    whole = (F.col("height") == height) & (F.col("width") == width)
    laid = fits.withColumn("tensor", F.when(whole, F.col("tensor")).otherwise(F.transform(i, value)))
    model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[list(shape)])
    return laid.withColumn("tensor", model("tensor"))


def _fits(shape: tuple[int, ...]) -> Column:
    channels, height, width = shape
    sound = F.size("tensor") == channels * F.col("height") * F.col("width")
    return F.coalesce(sound & (F.col("height") <= height) & (F.col("width") <= width), F.lit(False))


def predict_errors(tensors: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Frames that ``batch_predict`` leaves out: larger than the model's input, or without a value for every cell."""
    _, height, width = shape
    return tensors.where(~_fits(shape)).select(
        *FRAME, F.lit(LAYOUT).alias("code"),
        F.format_string("%d values of a %dx%d frame, the model takes up to %dx%d", F.size("tensor"), "width", "height", F.lit(width), F.lit(height)).alias("reason"),
    )


def invert_model() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in model for tests: inverts the tensor."""
    return lambda batch: 1.0 - batch.reshape(len(batch), -1)



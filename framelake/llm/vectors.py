"""Vectors of one length as integers: which rows take part, and their Arrow columns as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import common


def sound(vector: Column) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def usual_width(vectors: DataFrame, column: str) -> int:
    """The most frequent length of a sound vector, the longer one on ties; 0 without any."""
    sizes = common.only(vectors, {"_v": column}).where(sound(F.col("_v"))).groupBy(F.size("_v").alias("width")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return row["width"] if row else 0


def usable(column: Column, width: int, scale: float, largest: int) -> Column:
    """True for a sound vector of ``width`` components whose scaled values stay within ``largest``."""
    small = F.forall(column, lambda c: F.abs(c.cast("double") * scale) < float(largest))
    return sound(column) & (F.size(column) == width) & F.coalesce(small, F.lit(False))


def left_out(vectors: DataFrame, width: int, scale: float, largest: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, code, reason`` of rows that are sound but cannot take part."""
    from framelake.errors import INVALID_PARAMETER, LAYOUT

    slim = common.only(vectors, {"vec_id": id_col, "_v": vector_col}).where(sound(F.col("_v")))
    odd = F.size("_v") != width
    return slim.where(odd | ~usable(F.col("_v"), width, scale, largest)).select(
        "vec_id", F.when(odd, LAYOUT).otherwise(INVALID_PARAMETER).alias("code"),
        F.when(odd, "another length than most vectors").otherwise("a component is too large for exact sums").alias("reason"),
    )


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def join_spread(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, most: int) -> DataFrame:
    """``rows`` inner-joined with one row per ``key`` of ``facts`` (nulls match nulls), hot keys without a shuffle.

    ``count`` tells how many of ``total`` rows have a key. Keys with at least a ``most``-th of all rows, which can be ``most`` at the
    largest, are broadcast; no other key has more rows than that share, so the shuffle that joins the rest stays even.
    """
    share = max(1, -(-total // most))
    facts = facts.withColumnRenamed(key, "_key")
    hot, rest = facts.where(F.col(count) >= share), facts.where(F.col(count) < share)
    same = F.col(key).eqNullSafe(F.col("_key"))
    near = rows.join(F.broadcast(hot), same)
    far = rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(rest, same)
    return near.drop("_key").unionByName(far.drop("_key"))

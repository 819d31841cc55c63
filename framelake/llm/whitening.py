"""Whitening of embeddings by a covariance over distinct vectors, weighted by their multiplicity.

Components become integers x = floor(64 * c) + 1000000. Equal x vectors are grouped; the fit weighs each distinct vector with
its count (``weights="counts"``, as if every row took part) or with one (``weights="one"``). Sums are exact integers; the covariance
is a weighted product of centred blocks, one small matrix per task, added up by Spark; only matrices of the
vectors' width reach the driver. Each distinct vector is whitened once and joined back to its rows.

Defined results: null vectors and vectors with null, NaN or infinite entries are dropped; so are vectors of another length
than most and those with an entry of 2**30 or more (both listed by ``unwhitened``). Null ids and repeated rows stay rows. ``deviation``
is null where it exceeds 64 bits. A component without variance (its eigenvalue is within rounding of zero) has ``whitened`` null and
takes no part in ``identity_error``. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import common, vectors
from framelake.session import cut_lineage, ship_package

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 1 << 36  #: scaled entries stay below this
COMPONENTS = 32  #: components returned
HOT_BYTES = 8 << 20  #: whitened rows of hot vectors that are broadcast
SCHEMA = "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


@dataclass(frozen=True)
class Fit:
    """What the fit list says: its size, exact sums, and components with their eigenvalues, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray  #: one row per component
    trace: float

    @property
    def rank(self) -> int:
        """Components whose eigenvalue is more than rounding."""
        return int((self.values > self.values[:1].sum() * 1e-13 * len(self.sums)).sum())


def to_integers(rows: DataFrame, width: int, vector_col: str) -> DataFrame:
    """The usable rows, with ``x`` in place of the vector."""
    kept = rows.where(vectors.usable(F.col(vector_col), width, SCALE, LARGEST))
    return kept.withColumn("x", F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))).drop(vector_col)


def exact_sums(groups: DataFrame, width: int) -> tuple[int, list[int]]:
    """The sum of ``weight`` and of ``weight * x`` per dimension, as exact integers (``width + 1`` rows reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (width + 1)
        for part in batches:
            x, w = vectors.matrix(part.column("x"), width, np.int64), part.column("weight").to_numpy()
            if len(w) == 0:
                continue
            if int(w.sum()) * int(np.abs(x).max(initial=0)) >= 1 << 62:
                x, w = x.astype(object), w.astype(object)
            for at, v in enumerate([w.sum(), *(w @ x)]):
                totals[at] += int(v)
        yield common.batch([list(range(width + 1)), [str(t) for t in totals]], ["at", "total"], [pa.int32(), pa.string()])

    parts = groups.select("x", "weight").mapInArrow(run, "at INT, total STRING")
    got = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return got.get(0, 0), [got.get(k + 1, 0) for k in range(width)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` with the integer part subtracted exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    return (x - whole) - rest


def weighted_product(groups: DataFrame, column: str, width: int, centre) -> np.ndarray:
    """The sum of ``weight * outer(v, v)`` over rows, with ``v = centre(column)``: one matrix per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in batches:
            v = centre(part.column(column))
            total += v.T @ (v * part.column("weight").to_numpy()[:, None])
        at = np.arange(width * width)
        yield common.batch([at // width, at % width, total.ravel()], ["i", "j", "v"], [pa.int32(), pa.int32(), pa.float64()])

    cells = groups.select(column, "weight").mapInArrow(run, "i INT, j INT, v DOUBLE").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.toPandas().itertuples(index=False):
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def fit(groups: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Components of the weighted covariance of ``groups`` (``x``, ``weight``)."""
    n, sums = exact_sums(groups, width)
    if n == 0:
        return Fit(0, sums, np.zeros(0), np.zeros((0, width)), 0.0)
    cov = weighted_product(groups, "x", width, lambda c: centred(vectors.matrix(c, width, np.int64), n, sums)) / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes.T[order]
    # One sign for all rows: the largest entry of a component is positive.
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Fit(n, sums, values[order], axes, float(np.trace(cov)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of ``(n * x - sums) ** 2``, exact; None beyond 64 bits."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        gaps = n * x - np.array(sums, np.int64)
        rough = (gaps.astype(np.float64) ** 2).sum(axis=1)
        if rough.max(initial=0) < 2.0**62:
            return (gaps * gaps).sum(axis=1).tolist()
    gaps = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (gaps * gaps).sum(axis=1)]


def whiten_groups(groups: DataFrame, law: Fit, width: int) -> DataFrame:
    """Every distinct vector with its ``deviation`` and ``whitened`` values (up to the rank)."""
    rank = law.rank
    turn = (law.axes[:rank] / np.sqrt(law.values[:rank])[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = vectors.matrix(part.column("x"), width, np.int64)
            z = centred(x, law.n, law.sums) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * rank, pa.int32()), pa.array(z.ravel()))
            yield common.batch(
                [part.column("x"), part.column("copies"), part.column("weight"), deviations(x, law.n, law.sums), lists],
                ["x", "copies", "weight", "deviation", "z"], [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())],
            )

    return groups.select("x", "copies", "weight").mapInArrow(
        run, "x ARRAY<BIGINT>, copies BIGINT, weight BIGINT, deviation BIGINT, z ARRAY<DOUBLE>"
    )


def identity_error(done: DataFrame, law: Fit) -> float:
    """The largest absolute entry of the whitened values' covariance over the fit list, minus the identity."""
    rank = law.rank
    if rank == 0:
        return 0.0
    means = done.select("weight", F.posexplode("z").alias("at", "v")).groupBy("at").agg(F.sum(F.col("weight") * F.col("v")).alias("v")).collect()
    mean = np.zeros(rank)
    for r in means:
        mean[r["at"]] = r["v"] / law.n
    cov = weighted_product(done, "z", rank, lambda c: vectors.matrix(c, rank) - mean) / law.n
    return float(np.abs(cov - np.eye(rank)).max())


def whiten(
    rows: DataFrame, components: int = COMPONENTS, weights: str = "counts", id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector and component, columns as in ``SCHEMA``."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    spark = rows.sparkSession
    ship_package(spark)
    width = vectors.usual_width(rows, vector_col)
    if width == 0:
        return spark.createDataFrame([], SCHEMA)
    slim = to_integers(common.only(rows, {"vec_id": id_col, "_v": vector_col}), width, "_v")
    groups = slim.groupBy("x").agg(F.count("*").alias("copies"))
    groups = cut_lineage(groups.withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long")))
    total = groups.agg(F.sum("copies")).first()[0]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    law = fit(groups, width, components)
    done = cut_lineage(whiten_groups(groups, law, width))
    worst = identity_error(done, law)
    shown = len(law.values)
    facts = [F.struct(
        F.lit(k + 1).cast("int").alias("component"), F.lit(float(max(law.values[k], 0.0)) / law.trace if law.trace else 0.0).alias("explained"),
    ) for k in range(shown)]
    hot = max(16, HOT_BYTES // (8 * (width + shown)))
    joined = vectors.join_spread(slim, done.drop("weight"), "x", "copies", total, hot)
    each = joined.select("vec_id", "deviation", "z", F.explode(F.array(*facts)).alias("f"))
    return each.select(
        "vec_id", "f.component", F.lit(law.n).cast("long").alias("n"), "deviation",
        F.get(F.col("z"), F.col("f.component") - 1).alias("whitened"), "f.explained", F.lit(worst).alias("identity_error"),
    )


def unwhitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, code, reason`` of sound vectors that ``whiten`` leaves out."""
    return vectors.left_out(rows, vectors.usual_width(rows, vector_col), SCALE, LARGEST, id_col, vector_col)

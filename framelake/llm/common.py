"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import ship_package

#: Text bytes that one Python step holds at once (a longer single text is held alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``limit`` bytes of ``column`` or one longer value."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for row, n in enumerate(sizes):
        n = n or 0
        if row > start and held + n > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def over_texts(
    df: DataFrame, text: str, schema: str, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Run ``step`` over slices of Arrow batches, in the tasks that read ``df``."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, limit):
                out = step(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def only(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Just the named columns under new names, so that no other column of ``df`` can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def batch(arrays: Sequence, names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    """A record batch of lists or arrays with fixed types."""
    done = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types, strict=True)]
    return pa.RecordBatch.from_arrays(done, names=list(names))

"""Packed lines: scan lines travel in binary strips, and a transposition exchanges blocks of them.

A strip is ``LINES`` neighboring lines of one frame as an array ``(channels, lines, length)``. Turning rows into columns
cuts every strip into blocks of ``LINES`` by ``LINES`` values and gathers those of one target strip, so no value or
coefficient is ever a row, and a task holds one strip: 16 lines, whatever the number of lines. Frames are taken as
dense; a missing position counts as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.tiles import column_values, whole_tiles
from framelake.schemas import FRAME

LINE_BITS = 4
LINES = 1 << LINE_BITS
STRIP_KEYS = [*FRAME, "strip"]


@dataclass(frozen=True)
class Strip:
    """Where a strip stands: its frame, its number and the frame's size."""

    frame: pa.Table
    number: int
    height: int
    width: int

    def keys(self, rows: int) -> dict[str, pa.Array]:
        return {k: self.frame.column(k).combine_chunks().take(pa.array(np.zeros(rows, dtype=np.int32))) for k in FRAME}


LineFn = Callable[[Strip, np.ndarray], Iterator[pa.RecordBatch]]


def _frame_fields(df: DataFrame) -> list[T.StructField]:
    return [df.schema[k] for k in FRAME]


def block_schema(df: DataFrame) -> T.StructType:
    ints = [T.StructField(c, T.IntegerType()) for c in ("strip", "part", "lines", "height", "width")]
    return T.StructType([*_frame_fields(df), *ints, T.StructField("data", T.BinaryType())])


def pixel_schema(df: DataFrame, cols: Sequence[str]) -> T.StructType:
    spots = [T.StructField(c, T.IntegerType()) for c in ("y", "x")]
    return T.StructType([*_frame_fields(df), *spots, *[T.StructField(c, T.DoubleType()) for c in cols]])


def padded_size(extent: int) -> int:
    """Next power of two, at least 2."""
    return 1 << (max(extent, 2) - 1).bit_length()


def cut(at: Strip, lines: np.ndarray, ring: int = 0) -> pa.RecordBatch:
    """Blocks of ``lines`` for the strips of the other direction.

    With ``ring``, a target strip also gets that many lines before and after its own, around the end.
    """
    length = lines.shape[2]
    starts = range(0, length, LINES)
    spans = [np.arange(s - ring, min(s + LINES, length) + ring) % length for s in starts]
    ints = {"strip": range(len(spans)), "part": [at.number] * len(spans), "lines": [len(s) for s in spans]}
    ints |= {"height": [at.height] * len(spans), "width": [at.width] * len(spans)}
    data = [np.ascontiguousarray(lines[:, :, s].transpose(0, 2, 1)).tobytes() for s in spans]
    columns = at.keys(len(spans)) | {k: pa.array(v, pa.int32()) for k, v in ints.items()} | {"data": pa.array(data, pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


def pixel_rows(at: Strip, lines: np.ndarray, cols: Sequence[str]) -> pa.RecordBatch:
    """A strip of rows as pixels."""
    _, count, length = lines.shape
    y, x = np.divmod(np.arange(count * length, dtype=np.int32), np.int32(length))
    values = {c: pa.array(lines[k].reshape(-1)) for k, c in enumerate(cols)}
    return pa.RecordBatch.from_pydict(at.keys(len(y)) | {"y": pa.array(y + np.int32(at.number * LINES)), "x": pa.array(x)} | values)


def over_rows(px: DataFrame, cols: Sequence[str], fn: LineFn, schema: T.StructType) -> DataFrame:
    """Gather pixels with ``height`` and ``width`` into strips of rows and hand each to ``fn``."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_tiles(batches, STRIP_KEYS):
            y, x, number, height, width = (column_values(table, c) for c in ("y", "x", "strip", "height", "width"))
            values = [column_values(table, c) for c in cols]
            for rows in groups:
                first = rows.start
                at = Strip(table.slice(first, 1).select(FRAME), int(number[first]), int(height[first]), int(width[first]))
                lines = np.zeros((len(cols), min(LINES, at.height - at.number * LINES), at.width))
                for k, v in enumerate(values):
                    lines[k, y[rows] - at.number * LINES, x[rows]] = v[rows]
                yield from fn(at, lines)

    slim = px.withColumn("strip", F.shiftright("y", LINE_BITS)).select(*STRIP_KEYS, "y", "x", "height", "width", *cols)
    return slim.repartition(*STRIP_KEYS).sortWithinPartitions(*STRIP_KEYS).mapInArrow(run, schema)


def turned(
    blocks: DataFrame, channels: int, fn: LineFn, schema: T.StructType, dtype: type = np.float64,
    group: Sequence[str] = STRIP_KEYS, order: Sequence[str] = STRIP_KEYS,
) -> DataFrame:
    """Gather blocks into strips of the other direction and hand each to ``fn``, in ``order`` within each ``group``."""

    order = list(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_tiles(batches, order):
            number, count, height, width = (column_values(table, c) for c in ("strip", "lines", "height", "width"))
            data = table.column("data")
            for rows in groups:
                first = rows.start
                at = Strip(table.slice(first, 1).select(FRAME), int(number[first]), int(height[first]), int(width[first]))
                parts = [np.frombuffer(data[i].as_buffer(), dtype).reshape(channels, count[first], -1) for i in range(rows.start, rows.stop)]
                yield from fn(at, np.concatenate(parts, axis=2))

    return blocks.repartition(*group).sortWithinPartitions(*order, "part").mapInArrow(run, schema)

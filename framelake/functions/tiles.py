"""Halo tiles: the one shuffle behind every neighborhood operator.

A frame is cut into square tiles. Each pixel is sent to its own tile and, near a tile border, to
the neighbors that will read it. After one hash exchange on ``(frame, tile)`` a tile holds all it
needs, so row windows, column windows and whole-tile functions run without another exchange, and
no group is larger than ``(tile + 2*halo)**2`` pixels however large one frame is. A window keyed by
``(frame, tile, y)`` is satisfied by the partitioning on ``(frame, tile)``, so Spark only sorts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framelake.schemas import FRAME, RGBA

TILE_BITS = 8  # 256 x 256 pixels
TILE_KEYS = [*FRAME, "tile_y", "tile_x"]


def _owners(c: str, halo: int, bits: int) -> Column:
    first = F.shiftright(F.greatest(F.col(c) - halo, F.lit(0)), bits)
    last = F.shiftright(F.col(c) + halo, bits)
    return F.sequence(first, last)


def with_halo(px: DataFrame, halo_y: int, halo_x: int, bits: int = TILE_BITS) -> DataFrame:
    """Send pixels to every tile that reads them and hash-partition by tile."""
    return (
        px.withColumn("tile_y", F.explode(_owners("y", halo_y, bits)))
        .withColumn("tile_x", F.explode(_owners("x", halo_x, bits)))
        .repartition(*TILE_KEYS)
    )


def in_core(bits: int = TILE_BITS) -> Column:
    """True for pixels the tile owns, false for the halo."""
    return (F.shiftright("y", bits) == F.col("tile_y")) & (F.shiftright("x", bits) == F.col("tile_x"))


def drop_halo(df: DataFrame, bits: int = TILE_BITS) -> DataFrame:
    return df.where(in_core(bits)).drop("tile_y", "tile_x")


def row_line() -> WindowSpec:
    return Window.partitionBy(*TILE_KEYS, "y").orderBy("x")


def column_line() -> WindowSpec:
    return Window.partitionBy(*TILE_KEYS, "x").orderBy("y")


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[slice]]]:
    """Regroup a key-sorted stream of Arrow batches into tables of whole tiles, with each tile's rows."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            column = table.column(key)
            changed |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), [slice(i, j) for i, j in zip(starts, starts[1:])]
    if held is not None:
        yield held, [slice(0, held.num_rows)]


def column_values(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def dense_block(y: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of one tile as a ``(height, width, channels)`` block starting at its smallest position."""
    block = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1, values.shape[1]))
    block[y - y.min(), x - x.min()] = values
    return block


def tile_map(
    px: DataFrame,
    halo: int,
    fn: Callable[[np.ndarray], np.ndarray],
    cols: Sequence[str] = RGBA,
    bits: int = TILE_BITS,
) -> DataFrame:
    """Apply ``fn`` to each tile's block, edge-padded by ``halo`` on all sides.

    ``fn`` maps ``(H + 2*halo, W + 2*halo, C)`` to ``(H, W, C)``. Only core pixels are returned, so
    padding matters solely at true frame edges, where it replicates the border. Partitions are sorted by
    tile and streamed as Arrow batches, so thousands of small frames cost no per-group call and a
    task holds one tile at a time.
    """
    cols = list(cols)
    pad = ((halo, halo), (halo, halo), (0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tiles in whole_tiles(batches, TILE_KEYS):
            y, x = column_values(table, "y"), column_values(table, "x")
            values = np.column_stack([column_values(table, c) for c in cols])
            for rows in tiles:
                ty, tx = y[rows], x[rows]
                done = fn(np.pad(dense_block(ty, tx, values[rows]), pad, mode="edge"))
                values[rows] = done[ty - ty.min(), tx - tx.min()]
            core = (y >> bits == column_values(table, "tile_y")) & (x >> bits == column_values(table, "tile_x"))
            for k, c in enumerate(cols):
                table = table.set_column(table.column_names.index(c), c, pa.array(values[:, k]))
            yield from table.filter(pa.array(core)).to_batches()

    tiled = with_halo(px, halo, halo, bits).sortWithinPartitions(*TILE_KEYS)
    return tiled.mapInArrow(run, tiled.schema).drop("tile_y", "tile_x")

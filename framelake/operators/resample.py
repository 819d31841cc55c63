"""Resampling without joins: every source pixel produces the target pixels it owns.

A target belongs to the source pixel its position falls on. A halo tile therefore knows all targets its core
owns and every source they read, so both axes run in the tile after one exchange, and shifting
frames far needs no wider halo than shifting them by a fraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, OperatorError, within
from framelake.functions import kernels
from framelake.functions.color import clamp01
from framelake.functions.tiles import TILE_BITS, TILE_KEYS, column_values, dense_block, whole_tiles, with_halo
from framelake.operators.pointwise import with_dims
from framelake.schemas import FRAME, PIXELS, RGBA


@dataclass(frozen=True)
class Axis:
    """One axis of a resampling: a target length (by factor or fixed), or a shift read from a column."""

    scale: float | None = None
    length: int | None = None
    shift: str | None = None

    def targets(self, extent: int, by: float, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Targets owned by sources ``first..last`` and their source positions."""
        if self.shift:
            count, ratio, offset = extent, 1.0, -by
        else:
            count = self.length or max(int(np.floor(extent * self.scale + 0.5)), 1)
            ratio = extent / count
            offset = 0.5 * ratio - 0.5
        low = 0 if first == 0 else int(np.floor((first - offset) / ratio)) - 1
        high = count - 1 if last == extent - 1 else int(np.ceil((last + 1 - offset) / ratio)) + 1
        t = np.arange(max(low, 0), min(high, count - 1) + 1)
        s = t - by if self.shift else (t + 0.5) * ratio - 0.5
        owner = np.clip(np.floor(s), 0, extent - 1)
        mine = (owner >= first) & (owner <= last)
        return t[mine], s[mine]


def _gather(block: np.ndarray, axis: int, s: np.ndarray, start: int, extent: int, taps: range, weight, normalize: bool):
    """Weighted reads along ``axis`` of a block whose first position is ``start``."""
    base = np.floor(s)
    weights = [weight(base + k - s) for k in taps]
    if normalize:
        mass = sum(weights)
        weights = [w / np.where(np.abs(mass) > 1e-8, mass, 1.0) for w in weights]
    shape = [1, 1, 1]
    shape[axis] = -1
    reads = (np.clip(base + k, 0, extent - 1).astype(int) - start for k in taps)
    return sum(np.take(block, at, axis=axis) * w.reshape(shape) for at, w in zip(reads, weights))


def resample(
    sized: DataFrame, axes: tuple[Axis | None, Axis | None], taps: range, weight: Callable, normalize=False, clip=True
) -> DataFrame:
    """Resample ``sized`` pixels (which carry ``width`` and ``height``) along y and x."""
    reach = max(abs(taps[0]), abs(taps[-1]))
    along_y, along_x = axes
    size = 1 << TILE_BITS

    def core(tile: int, extent: int) -> tuple[int, int]:
        return tile * size, min(tile * size + size, extent) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tiles in whole_tiles(batches, TILE_KEYS):
            y, x = column_values(table, "y"), column_values(table, "x")
            values = np.column_stack([column_values(table, c) for c in RGBA])
            meta = {c: column_values(table, c) for c in ("tile_y", "tile_x", "width", "height", *shifts)}
            for rows in tiles:
                i, ty, tx = rows.start, y[rows], x[rows]
                block = dense_block(ty, tx, values[rows])
                spots = []
                for axis, spec, tile, start in ((0, along_y, "tile_y", ty.min()), (1, along_x, "tile_x", tx.min())):
                    extent = int(meta["height" if axis == 0 else "width"][i])
                    first, last = core(int(meta[tile][i]), extent)
                    if first > last:
                        spots.append(np.arange(0))
                        continue
                    if spec is None:
                        spots.append(np.arange(first, last + 1))
                        block = np.take(block, spots[-1] - start, axis=axis)
                        continue
                    t, s = spec.targets(extent, float(meta[spec.shift][i]) if spec.shift else 0.0, first, last)
                    block = _gather(block, axis, s, start, extent, taps, weight, normalize)
                    spots.append(t)
                if not len(spots[0]) or not len(spots[1]):
                    continue
                flat = block.reshape(-1, len(RGBA))
                n = len(flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(table.column("asset_id")[i], n), pa.repeat(table.column("frame_no")[i], n),
                        pa.array(np.repeat(spots[0], len(spots[1])), pa.int32()), pa.array(np.tile(spots[1], len(spots[0])), pa.int32()),
                        *[pa.array(flat[:, k]) for k in range(len(RGBA))],
                    ],
                    names=[*FRAME, "y", "x", *RGBA],
                )

    shifts = [a.shift for a in axes if a is not None and a.shift]
    halo = [0 if a is None else reach for a in axes]
    tiles = with_halo(sized, *halo).sortWithinPartitions(*TILE_KEYS)
    done = tiles.mapInArrow(run, PIXELS)
    return done.withColumns({c: clamp01(F.col(c)) for c in RGBA}) if clip else done


def _both(scale: float) -> tuple[Axis, Axis]:
    within("scale", scale, 0.25)
    return Axis(scale=scale), Axis(scale=scale)


def resize_bilinear(px: DataFrame, width: int, height: int, frames: DataFrame | None = None) -> DataFrame:
    axes = Axis(length=max(height, 1)), Axis(length=max(width, 1))
    return resample(with_dims(px, frames), axes, range(0, 2), kernels.tent, clip=False)


def upscale_mitchell(px: DataFrame, scale: float = 2.0, frames: DataFrame | None = None) -> DataFrame:
    return resample(with_dims(px, frames), _both(scale), range(-1, 3), kernels.cubic(1 / 3, 1 / 3))


def upscale_catmull(px: DataFrame, scale: float = 2.0, frames: DataFrame | None = None) -> DataFrame:
    return resample(with_dims(px, frames), _both(scale), range(-1, 3), kernels.cubic(0.0, 0.5))


def upscale_lanczos(px: DataFrame, scale: float = 2.0, lobes: int = 3, frames: DataFrame | None = None) -> DataFrame:
    within("lobes", lobes, 2, 6)
    return resample(with_dims(px, frames), _both(scale), range(1 - lobes, lobes + 1), kernels.lanczos(lobes), normalize=True)


def translate(px: DataFrame, motion: DataFrame, subpixel: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """Shift each frame by its row of ``motion`` (``dx, dy``), edges replicated; a frame without a row stays as it is."""
    moves = motion.select(*FRAME, *[(F.col(d) if subpixel else F.round(d)).cast("double").alias(d) for d in ("dx", "dy")])
    return _shifted(with_dims(px, frames).join(moves, FRAME, "left").fillna(0.0, ["dx", "dy"]), subpixel)


def translate_all(px: DataFrame, dx: float, dy: float, subpixel: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """Shift all frames alike."""
    dx, dy = (dx, dy) if subpixel else (float(np.floor(abs(d) + 0.5) * np.sign(d)) for d in (dx, dy))
    return _shifted(with_dims(px, frames).withColumns({"dx": F.lit(float(dx)), "dy": F.lit(float(dy))}), subpixel)


def _shifted(moved: DataFrame, subpixel: bool) -> DataFrame:
    axes = Axis(shift="dy"), Axis(shift="dx")
    taps, weight = (range(0, 2), kernels.tent) if subpixel else (range(0, 1), kernels.flat)
    return resample(moved, axes, taps, weight, clip=False)


def kernel_gather(px: DataFrame, axis: str, scale: float, frames: DataFrame | None = None) -> DataFrame:
    """One-axis cubic resampling: the building block of the two-axis operators."""
    if axis not in ("x", "y"):
        raise OperatorError(INVALID_PARAMETER, f"axis must be x or y, got {axis!r}")
    along_y, along_x = _both(scale)
    axes = (along_y, None) if axis == "y" else (None, along_x)
    return resample(with_dims(px, frames), axes, range(-1, 3), kernels.cubic(1 / 3, 1 / 3), clip=False)


BROADCAST_POINTS = 33  # 33**3 cells of 8 colors are 7 MB, the most that is broadcast by hint


def lattice_cells(lut: DataFrame) -> DataFrame:
    """One row per lattice cell with its eight corner colors ``k0..k7`` (bit 0 red, 1 green, 2 blue)."""
    serves = F.explode(
        F.array(*[
            F.struct((F.col("ri") - (i & 1)).alias("r0"), (F.col("gi") - (i >> 1 & 1)).alias("g0"), (F.col("bi") - (i >> 2 & 1)).alias("b0"), F.lit(i).alias("corner"))
            for i in range(8)
        ])
    )
    rows = lut.select(serves.alias("c"), F.struct("r", "g", "b").alias("v")).select("c.*", "v")
    return rows.where("r0 >= 0 and g0 >= 0 and b0 >= 0").groupBy("r0", "g0", "b0").agg(
        *[F.first(F.when(F.col("corner") == i, F.col("v")), ignorenulls=True).alias(f"k{i}") for i in range(8)]
    )


def lut_trilinear(px: DataFrame, lut: DataFrame, size: int, strength: float = 1.0, lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0)) -> DataFrame:
    """Blend the eight lattice corners around each color; the result is not clamped.

    Corners meet on the small lattice first, so pixels join once by cell.
    """
    if strength <= 0:
        return px
    cells = lattice_cells(lut)
    if size <= BROADCAST_POINTS:
        cells = F.broadcast(cells)
    at = {c: clamp01((F.col(c) - a) / (z - a)) * (size - 1) for c, a, z in zip("rgb", lo, hi)}
    placed = px.withColumns({f"{c}0": F.floor(v).cast("int") for c, v in at.items()}).withColumns(
        {f"_f{c}": at[c] - F.col(f"{c}0") for c in "rgb"}
    )
    joined = placed.join(cells, ["r0", "g0", "b0"])
    mix = min(strength, 1.0)
    out = {}
    for c in "rgb":
        looked = F.lit(0.0)
        for i in range(8):
            w = F.lit(1.0)
            for bit, axis in enumerate("rgb"):
                w = w * (F.col(f"_f{axis}") if i >> bit & 1 else 1.0 - F.col(f"_f{axis}"))
            looked = looked + w * F.coalesce(F.col(f"k{i}.{c}"), F.col(f"k0.{c}"))  # beyond the last point the weight is 0
        out[c] = F.col(c) * (1.0 - mix) + looked * mix
    return joined.withColumns(out).select(*px.columns)

"""Conversions between packed buffers, pixel rows and scan lines, and checks on frame shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import LAYOUT
from framelake.operators.pointwise import frame_dims
from framelake.schemas import FRAME, RGBA


def layout_errors(packed: DataFrame) -> DataFrame:
    """Packed frames whose buffer length is not ``width * height * 4``."""
    want = F.col("width") * F.col("height") * 4
    return packed.where(F.size("data") != want).select(
        *FRAME,
        F.lit(LAYOUT).alias("code"),
        F.format_string("buffer holds %d values, %dx%d needs %d", F.size("data"), "width", "height", want).alias("reason"),
    )


def to_pixels(packed: DataFrame) -> DataFrame:
    """Packed RGBA buffers to one row per pixel; malformed frames are left to ``layout_errors``."""
    well = packed.where(F.size("data") == F.col("width") * F.col("height") * 4)
    cell = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    at = lambda k: F.get("data", F.col("i") * 4 + k)
    return well.where("width * height > 0").select(*FRAME, "width", "data", cell).select(
        *FRAME,
        F.expr("cast(i div width as int)").alias("y"),
        F.expr("cast(i % width as int)").alias("x"),
        *[at(k).alias(c) for k, c in enumerate(RGBA)],
    )


def to_scanlines(px: DataFrame, axis: str = "row") -> DataFrame:
    """One row per image row or column, values ordered along the line. A line is at most one frame side."""
    line, pos = ("y", "x") if axis == "row" else ("x", "y")
    packed = F.array_sort(F.collect_list(F.struct(pos, *RGBA)))
    return (
        px.groupBy(*FRAME, line).agg(packed.alias("_cells"))
        .select(*FRAME, F.lit(axis).alias("axis"), F.col(line).alias("idx"), *[F.col(f"_cells.{c}").alias(c) for c in RGBA])
    )


def from_scanlines(lines: DataFrame) -> DataFrame:
    """Scan lines of either axis back to pixels."""
    cell = F.posexplode(F.arrays_zip(*RGBA)).alias("pos", "v")
    is_row = F.col("axis") == "row"
    return lines.select(*FRAME, "axis", "idx", cell).select(
        *FRAME,
        F.when(is_row, F.col("idx")).otherwise(F.col("pos")).alias("y"),
        F.when(is_row, F.col("pos")).otherwise(F.col("idx")).alias("x"),
        *[F.col(f"v.{c}").alias(c) for c in RGBA],
    )


def densify(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Every cell of every frame; absent cells are zero.

    Spark sizes rows made by ``explode`` like the rows they come from, so both sides are merged, never broadcast.
    """
    grid = (
        frames.where("width > 0 and height > 0")
        .select(*FRAME, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
        .select(*FRAME, "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    )
    return grid.hint("merge").join(px, [*FRAME, "y", "x"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in RGBA})


def dims_check(frames: DataFrame) -> DataFrame:
    """Frames whose size differs from their asset's first frame, as error rows.

    The first frame's size is one small aggregate per asset, joined back, so an asset with very
    many frames is not gathered in one window.
    """
    size = F.struct("width", "height")
    first = frames.groupBy("asset_id").agg(F.min_by(size, "frame_no").alias("_want"))
    return (
        frames.join(first, "asset_id")
        .where((F.col("width") != F.col("_want.width")) | (F.col("height") != F.col("_want.height")))
        .select(
            *FRAME,
            F.lit(LAYOUT).alias("code"),
            F.format_string("frame is %dx%d, expected %dx%d", "width", "height", "_want.width", "_want.height").alias("reason"),
        )
    )


def frame_to_chw(px: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row per frame: ``ARRAY<FLOAT>`` of ``3*H*W`` values, channel-major, alpha dropped.

    The tensor is the model's input and so is bounded by what one model call takes.
    """
    cells = px.select(
        *FRAME, "y", "x", F.posexplode(F.array(*[(F.col(c) / scale).cast("float") for c in RGBA[:3]])).alias("c", "v")
    )
    tensor = F.transform(F.array_sort(F.collect_list(F.struct("c", "y", "x", "v"))), lambda s: s["v"])
    return cells.groupBy(*FRAME).agg(
        (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), tensor.alias("tensor")
    )


def chw_to_frame(tensors: DataFrame, original: DataFrame) -> DataFrame:
    """Tensors back to pixels, alpha taken from the original; wrong lengths yield no pixels."""
    plane = F.col("width") * F.col("height")
    at = lambda k: F.get("tensor", F.col("i") + k * plane).cast("double")
    rgb = (
        tensors.where(F.size("tensor") == 3 * plane)
        .select(*FRAME, "width", "height", "tensor", F.explode(F.sequence(F.lit(0), plane - 1)).alias("i"))
        .select(
            *FRAME, F.expr("cast(i div width as int)").alias("y"), F.expr("cast(i % width as int)").alias("x"),
            at(0).alias("r"), at(1).alias("g"), at(2).alias("b"),
        )
    )
    return rgb.join(original.select(*FRAME, "y", "x", "a"), [*FRAME, "y", "x"])


def chw_errors(tensors: DataFrame) -> DataFrame:
    want = 3 * F.col("width") * F.col("height")
    return tensors.where(F.size("tensor") != want).select(
        *FRAME, F.lit(LAYOUT).alias("code"),
        F.format_string("tensor holds %d values, expected %d", F.size("tensor"), want).alias("reason"),
    )


def asset_probe(px: DataFrame, rates: DataFrame) -> DataFrame:
    """Dims and frame count per asset; a missing count is estimated from duration and rate."""
    seen = (
        frame_dims(px).groupBy("asset_id")
        .agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count(F.lit(1)).alias("stored_frames"))
    )
    return seen.join(rates, "asset_id", "left").withColumn("frame_count", estimate_frames(F.col("frame_count")))


def estimate_frames(count: Column) -> Column:
    return F.coalesce(count, F.round(F.col("duration_secs") * F.col("fps_num") / F.col("fps_den")).cast("bigint"))



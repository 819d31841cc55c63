"""Fourier operators: batches of scan lines through numpy, with Spark doing the transposes.

Whole-frame operators keep their lines packed (``functions/strips.py``) and turn rows into columns by exchanging blocks.
``fft2`` and ``dft_lines`` return coefficients as rows ``(keys, line, pos, re, im)``, since these are their results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.errors import within
from framelake.functions.color import clamp01, luma
from framelake.functions.strips import LINES, Strip, block_schema, cut, over_rows, padded_size, pixel_rows, pixel_schema, turned
from framelake.functions.tiles import column_values, whole_tiles
from framelake.operators.metrics import combinable, fuse_median, stack, stack_errors
from framelake.operators.pointwise import frame_dims, with_dims
from framelake.operators.resample import translate, upscale_lanczos
from framelake.schemas import FRAME, PIXEL, RGB, RGBA
from framelake.session import cut_lineage

LINE = T.StructType([T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(LINE)
def _fft(re: pd.Series, im: pd.Series, size: pd.Series) -> pd.DataFrame:
    done = [np.fft.fft(np.asarray(a) + 1j * np.asarray(b), n) for a, b, n in zip(re, im, size)]
    return pd.DataFrame({"re": [v.real for v in done], "im": [v.imag for v in done]})


@F.pandas_udf(LINE)
def _ifft(re: pd.Series, im: pd.Series, size: pd.Series) -> pd.DataFrame:
    done = [np.fft.ifft(np.asarray(a) + 1j * np.asarray(b), n) for a, b, n in zip(re, im, size)]
    return pd.DataFrame({"re": [v.real for v in done], "im": [v.imag for v in done]})


def padded(extent: Column) -> Column:
    """Next power of two, at least 2."""
    return F.pow(F.lit(2), F.length(F.bin(F.greatest(extent, F.lit(2)) - 1))).cast("int")


def fft_lines(df: DataFrame, keys: list[str], line: str, pos: str, size: str, inverse: bool = False) -> DataFrame:
    """1-D transform of every line of ``(keys, line)`` along ``pos``, zero-padded to column ``size``."""
    cells = F.array_sort(F.collect_list(F.struct(pos, "re", "im")))
    lines = df.groupBy(*keys, line).agg(cells.alias("_c"), F.max(size).alias(size))
    transform = _ifft if inverse else _fft
    done = lines.withColumn("_z", transform(F.col("_c.re"), F.col("_c.im"), F.col(size)))
    return done.select(*keys, line, size, F.posexplode(F.arrays_zip("_z.re", "_z.im")).alias(pos, "v")).select(
        *keys, line, size, pos, "v.re", "v.im"
    )


def planes(px: DataFrame, values: dict[str, Column], frames: DataFrame | None = None) -> DataFrame:
    """Pixels as complex planes, one per named value, with padded sizes ``nx`` and ``ny``."""
    sized = with_dims(px, frames)
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("ch"), v.alias("re")) for k, v in values.items()]))
    return sized.select(
        *FRAME, "y", "x", "width", "height", padded(F.col("width")).alias("nx"), padded(F.col("height")).alias("ny"), parts.alias("p")
    ).select(*FRAME, "y", "x", "width", "height", "nx", "ny", "p.ch", "p.re", F.lit(0.0).alias("im"))


def fft2(plane: DataFrame, inverse: bool = False) -> DataFrame:
    """2-D transform: rows, transpose, columns. Keeps ``nx`` and ``ny`` as grouping keys."""
    keys = [*FRAME, "ch", "nx", "ny"]
    slim = plane.select(*keys, "y", "x", "re", "im").withColumn("_n", F.col("nx"))
    rows = fft_lines(slim, keys, "y", "x", "_n", inverse)
    return fft_lines(rows.withColumn("_n", F.col("ny")), keys, "x", "y", "_n", inverse).drop("_n")


def dft_lines(px: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """1-D spectrum of every image row and color channel."""
    plane = planes(px, {c: F.col(c) for c in RGB}, frames)
    done = fft_lines(plane, [*FRAME, "ch"], "y", "x", "nx")
    return done.select(*FRAME, "ch", "y", F.col("x").alias("k"), "re", "im")


def _psf_line(n: int, sigma: float) -> np.ndarray:
    """Spectrum of a wrapped, unit-sum Gaussian; real because the line is symmetric."""
    at = np.arange(n)
    away = np.where(at <= n // 2, at, at - n)
    taps = np.exp(-(away**2) / (2 * sigma * sigma))
    return np.fft.fft(taps / taps.sum())


def wiener(px: DataFrame, sigma: float = 1.0, nsr: float = 0.01, frames: DataFrame | None = None) -> DataFrame:
    """Wiener deconvolution of a Gaussian blur. The blur is separable, so a column knows its own filter; lines stay packed."""
    sigma, nsr = max(sigma, 0.3), max(nsr, 1e-6)

    def begin(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = padded_size(at.width)
        out = np.zeros((4, lines.shape[1], n), dtype=complex)
        out[:3], out[3, :, : at.width] = np.fft.fft(lines[:3], n), lines[3]
        yield cut(at, out)

    def columns(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, w = padded_size(at.height), padded_size(at.width)
        kx = at.number * LINES + np.arange(lines.shape[1])
        soft = _psf_line(w, sigma)[kx, None] * _psf_line(h, sigma)
        gain = np.conj(soft) / (np.abs(soft) ** 2 + nsr)
        gain[kx == 0, 0] = 1.0
        sharp = np.fft.ifft(np.fft.fft(lines[:3], h) * gain)[..., : at.height]
        yield cut(at, np.concatenate([sharp, lines[3:]]))

    def end(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        rgb = np.clip(np.fft.ifft(lines[:3]).real[..., : at.width], 0.0, 1.0)
        yield pixel_rows(at, np.concatenate([rgb, lines[3:, :, : at.width].real]), RGBA)

    spectra = over_rows(with_dims(px, frames), RGBA, begin, block_schema(px))
    back = turned(spectra, 4, columns, block_schema(px), complex)
    return turned(back, 4, end, pixel_schema(px, RGBA), complex).select(*PIXEL, *RGBA)


def _around(lines: np.ndarray, extent: int, sigma: float) -> np.ndarray:
    """Circular Gaussian blur of zero-padded lines with the whole wrapped kernel, cut back to ``extent``."""
    n = padded_size(extent)
    return np.fft.irfft(np.fft.rfft(lines, n) * _psf_line(n, sigma).real[: n // 2 + 1], n)[..., :extent]


#: Iterations between two written states, so that a lost executor repeats no more than these.
WRITE_EVERY = 5


def richardson_lucy(
    px: DataFrame, sigma: float = 1.0, iterations: int = 8, damping: float = 0.0, frames: DataFrame | None = None
) -> DataFrame:
    """Iterative deconvolution of a Gaussian blur on a torus of padded size, zero outside the frame.

    The kernel is kept whole: each line is convolved by its transform. An iteration turns packed lines twice: columns end
    the first blur, divide and begin the second; rows end it, update and begin the next iteration's first.
    """
    sigma, iterations, damping = max(sigma, 0.3), int(within("iterations", iterations, 1, 50)), within("damping", damping, 0.0, 1.0)
    schema = block_schema(px)
    # Channels of a strip: estimate, frame as given and blur under way, three each, then alpha.

    def begin(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        rgb = lines[:3]
        yield cut(at, np.concatenate([rgb, rgb, _around(rgb, at.width, sigma), lines[3:]]))

    def columns(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        now, shown, soft, alpha = lines[:3], lines[3:6], lines[6:9], lines[9:]
        ratio = shown / np.maximum(_around(soft, at.height, sigma), 1e-6)
        yield cut(at, np.concatenate([now, shown, _around(ratio, at.height, sigma), alpha]))

    def updated(at: Strip, lines: np.ndarray) -> np.ndarray:
        return lines[:3] * (1 + (_around(lines[6:9], at.width, sigma) - 1) * (1 - damping))

    def rows(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        now = updated(at, lines)
        yield cut(at, np.concatenate([now, lines[3:6], _around(now, at.width, sigma), lines[9:]]))

    def end(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pixel_rows(at, np.concatenate([np.clip(updated(at, lines), 0.0, 1.0), lines[9:]]), RGBA)

    state = over_rows(with_dims(px, frames), RGBA, begin, schema)
    for step in range(1, iterations):
        state = turned(turned(state, 10, columns, schema), 10, rows, schema)
        if step % WRITE_EVERY == 0:
            state = cut_lineage(state)
    done = turned(turned(state, 10, columns, schema), 10, end, pixel_schema(px, RGBA))
    return _with_rest(done, px)


def _with_rest(done: DataFrame, px: DataFrame) -> DataFrame:
    """The columns of ``px``; those beyond position and color are joined from it."""
    rest = [c for c in px.columns if c not in (*PIXEL, *RGBA)]
    done = done.join(px.select(*PIXEL, *rest), PIXEL) if rest else done
    return done.select(*px.columns)


def _hann(pos: str, extent: str) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * F.col(pos) / F.greatest(F.col(extent) - 1, F.lit(1)))


RUN_BITS = 8  # frames of an asset that meet one copy of its first frame's spectrum: 256


def phase_correlate(px: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Shift of every frame against its asset's first frame, to a fraction of a pixel.

    Every transform is done once, on packed lines. Strips of columns stream by runs of 256 frames behind a copy of the first
    frame's strip, so a long recording spreads over tasks and a task holds two strips. The rows of the surface come with
    the row before and after, so a strip knows its peak's neighbors and leaves one row. Assets with frames of several sizes
    are left out and listed by ``register_errors``.
    """
    px = combinable(px)
    sized = with_dims(px, frames).withColumn("lum", luma() * _hann("x", "width") * _hann("y", "height"))
    schema = block_schema(px)

    def begin(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield cut(at, np.fft.fft(lines, padded_size(at.width)))

    blocks = over_rows(sized, ["lum"], begin, schema)
    dims = frame_dims(px) if frames is None else px
    run = F.shiftright("frame_no", RUN_BITS)
    first = dims.groupBy("asset_id").agg(F.min("frame_no").alias("_first"), F.collect_set(run).alias("_runs"))
    copies = F.when(F.col("frame_no") == F.col("_first"), F.col("_runs")).otherwise(F.array(run))
    dealt = blocks.join(first, "asset_id").withColumn("run", F.explode(copies)).drop("_runs")
    group = ["asset_id", "run", "strip"]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, reference = None, None
        for table, groups in whole_tiles(batches, [*group, "frame_no"]):
            cell = {c: column_values(table, c) for c in (*group, "frame_no", "_first", "lines", "height", "width")}
            data = table.column("data")
            for rows in groups:
                k = rows.start
                at = Strip(table.slice(k, 1).select(FRAME), int(cell["strip"][k]), int(cell["height"][k]), int(cell["width"][k]))
                parts = [np.frombuffer(data[i].as_buffer(), complex).reshape(1, cell["lines"][k], -1) for i in range(rows.start, rows.stop)]
                spectrum = np.fft.fft(np.concatenate(parts, axis=2), padded_size(at.height))
                now = tuple(cell[c][k] for c in group)
                is_first = cell["frame_no"][k] == cell["_first"][k]
                if now != seen:  # the first frame has the smallest number, so it leads its group
                    seen, reference = now, spectrum
                if not is_first or int(cell["_first"][k]) >> RUN_BITS == cell["run"][k]:
                    power = reference * np.conj(spectrum)
                    yield cut(at, np.fft.ifft(power / (np.abs(power) + 1e-12)), ring=1)

    met = dealt.repartition(*group).sortWithinPartitions(*group, "frame_no", "part").mapInArrow(cross, schema)

    def peak(at: Strip, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        surface = np.round(np.fft.ifft(lines[0]).real, 12)
        own = surface[1:-1]
        y, x = np.unravel_index(own.argmax(), own.shape)
        n = own.shape[1]
        found = {"pv": own[y, x], "xm": own[y, x - 1], "xp": own[y, (x + 1) % n], "ym": surface[y, x], "yp": surface[y + 2, x]}
        ints = {"px": x, "py": y + at.number * LINES, "nx": n, "ny": padded_size(at.height)}
        columns = {c: pa.array([int(v)], pa.int32()) for c, v in ints.items()} | {c: pa.array([float(v)]) for c, v in found.items()}
        yield pa.RecordBatch.from_pydict(at.keys(1) | columns)

    places = [T.StructField(c, T.IntegerType()) for c in ("px", "py", "nx", "ny")]
    values = [T.StructField(c, T.DoubleType()) for c in ("pv", "xm", "xp", "ym", "yp")]
    peaks = turned(met, 1, peak, T.StructType([*schema.fields[:2], *places, *values]), complex)
    highest = F.max_by(F.struct("px", "py", "nx", "ny", "pv", "xm", "xp", "ym", "yp"), F.struct("pv", -F.col("py"), -F.col("px")))
    cells = peaks.groupBy(*FRAME).agg(highest.alias("k")).select(*FRAME, "k.*")

    def vertex(a, b, c):
        bend = a - 2 * b + c
        return F.when(F.abs(bend) < 1e-12, F.lit(0.0)).otherwise(0.5 * (a - c) / bend)

    def signed(at, n):
        return -F.when(at > n / 2, at - n).otherwise(at)

    dx = signed(F.col("px") + vertex(F.col("xm"), F.col("pv"), F.col("xp")), F.col("nx"))
    dy = signed(F.col("py") + vertex(F.col("ym"), F.col("pv"), F.col("yp")), F.col("ny"))
    is_first = F.col("frame_no") == F.col("_first")
    return cells.join(first, "asset_id").select(
        *FRAME,
        F.when(is_first, 0.0).otherwise(dx).alias("dx"),
        F.when(is_first, 0.0).otherwise(dy).alias("dy"),
        F.when(is_first, 1.0).otherwise(clamp01(F.col("pv"))).alias("peak"),
    )


def register_errors(px: DataFrame, least_frames: int = 2) -> DataFrame:
    """Frames that keep their asset from being registered: sizes differ, or fewer than ``least_frames``."""
    return stack_errors(px, least_frames)


def super_resolve(px: DataFrame, scale: int = 2, fuse: str = "median", shifts: DataFrame | None = None) -> DataFrame:
    """Register, upsample with three-lobe Lanczos, shift by whole upsampled pixels, fuse; needs two frames of one size."""
    within("scale", scale, 2, 8)
    px = combinable(px, 2)
    shifts = cut_lineage(phase_correlate(px)) if shifts is None else shifts
    big = upscale_lanczos(px, float(scale), 3)
    back = shifts.select(*FRAME, *[(-F.round(F.col(d) * scale)).alias(d) for d in ("dx", "dy")])
    sizes = frame_dims(px).select(*FRAME, *[(F.col(d) * scale).cast("int").alias(d) for d in ("width", "height")])
    placed = translate(big, back, subpixel=False, frames=sizes)
    return fuse_median(placed) if fuse == "median" else stack(placed, "mean")


def stabilize(px: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """Undo each frame's measured shift; assets of mixed sizes are left out as in ``phase_correlate``."""
    px = combinable(px) if shifts is None else px
    shifts = cut_lineage(phase_correlate(px)) if shifts is None else shifts
    return translate(px, shifts.select(*FRAME, (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))

"""Per-pixel operators. Each is one projection, so a chain of them collapses into a single stage.

Alpha is untouched except by the two masks. Pixels are linear-light doubles unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, OperatorError
from framelake.functions.color import (
    clamp01,
    color_spaces,
    linear_to_srgb,
    luma,
    srgb_to_linear,
)
from framelake.schemas import FRAME, RGB, RGBA


def lift_linear(px: DataFrame, depth: int = 8, space: str | Column = "srgb") -> DataFrame:
    """Stored values to linear doubles: divide by the depth's range, linearize only sRGB."""
    space = F.lit(space) if isinstance(space, str) else space
    top = {8: 255.0, 16: 65535.0, 32: 1.0}[depth]
    scaled = {c: F.col(c).cast("double") / top for c in RGBA}
    lifted = {c: F.when(space == "srgb", srgb_to_linear(v)).otherwise(v) for c, v in scaled.items()}
    return px.withColumns({**lifted, "a": scaled["a"]})


def encode_u8(px: DataFrame, linear: Column | None = None) -> DataFrame:
    """Doubles to bytes: sRGB curve where the space is linear, then truncate ``255*c + 0.5``."""
    linear = F.lit(True) if linear is None else linear

    def pack(c: Column) -> Column:
        return F.floor(clamp01(c) * 255.0 + 0.5).cast("int")

    curved = {c: pack(F.when(linear, linear_to_srgb(F.col(c))).otherwise(F.col(c))) for c in RGB}
    return px.withColumns({**curved, "a": pack(F.col("a"))})


def encode_u8_from_u16(px: DataFrame) -> DataFrame:
    """16-bit values to bytes by dropping the low byte; no curve."""
    return px.withColumns({c: F.shiftright(c, 8) for c in RGBA})


def brightness_contrast(px: DataFrame, brightness: float = 0.0, contrast: float = 1.0) -> DataFrame:
    return px.withColumns({c: clamp01((F.col(c) - 0.5) * contrast + 0.5 + brightness) for c in RGB})


def gamma(px: DataFrame, gamma: float = 1.0) -> DataFrame:
    return px.withColumns(
        {c: clamp01(F.pow(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0 / gamma))) for c in RGB}
    )


def saturation(px: DataFrame, amount: float = 1.0) -> DataFrame:
    gray = luma()
    return px.withColumns({c: clamp01(gray + (F.col(c) - gray) * amount) for c in RGB})


def primary_wheels(px: DataFrame, lift=(0.0, 0.0, 0.0), gamma=(1.0, 1.0, 1.0), gain=(1.0, 1.0, 1.0)) -> DataFrame:
    out = {}
    for c, lo, ga, hi in zip(RGB, lift, gamma, gain):
        out[c] = clamp01(F.pow(F.greatest(F.col(c) * hi + lo, F.lit(0.0)), F.lit(1.0 / max(ga, 0.01))))
    return px.withColumns(out)


def parse_curve(text: str) -> list[tuple[float, float]]:
    """``"0:0,0.5:0.7,1:1"`` to control points; x must not decrease."""
    points = []
    for pair in filter(None, (p.strip() for p in text.split(","))):
        parts = pair.split(":")
        try:
            x, y = (float(v) for v in parts)
        except ValueError:
            raise OperatorError(INVALID_PARAMETER, f"curve: expected x:y, got {pair!r}") from None
        if points and x < points[-1][0]:
            raise OperatorError(INVALID_PARAMETER, "curve: control points must ascend in x")
        points.append((x, y))
    return points


def curve_value(c: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup with flat ends; no points means unchanged."""
    if not points:
        return c
    (x_last, y_last) = points[-1]
    ladder = F.when(c <= points[0][0], F.lit(points[0][1])).when(c >= x_last, F.lit(y_last))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 > x0:
            ladder = ladder.when(c < x1, y0 + (c - x0) / (x1 - x0) * (y1 - y0))
    return ladder.otherwise(F.lit(y_last))


def curves(px: DataFrame, points_r="", points_g="", points_b="", points_luma="") -> DataFrame:
    per_channel = [parse_curve(t) for t in (points_r, points_g, points_b)]
    tone = parse_curve(points_luma)
    if any(per_channel):
        px = px.withColumns({c: clamp01(curve_value(F.col(c), p)) for c, p in zip(RGB, per_channel)})
    if tone:
        gray = luma()
        scale = curve_value(gray, tone) / F.greatest(gray, F.lit(1e-6))
        px = px.withColumns({c: clamp01(F.col(c) * scale) for c in RGB})
    return px


def duotone(
    px: DataFrame, shadow=(0.04, 0.07, 0.18), highlight=(0.95, 0.78, 0.42), amount: float = 0.85
) -> DataFrame:
    gray = luma()
    return px.withColumns(
        {
            c: clamp01(F.col(c) * (1.0 - amount) + (lo + (hi - lo) * gray) * amount)
            for c, lo, hi in zip(RGB, shadow, highlight)
        }
    )


def channel_isolate(px: DataFrame, channel: str = "luma", invert: bool = False) -> DataFrame:
    gray = F.col(channel) if channel in RGBA else luma()
    gray = clamp01(1.0 - gray if invert else gray)
    return px.withColumns({c: gray for c in RGB})


def invert(px: DataFrame, amount: float = 1.0) -> DataFrame:
    return px.withColumns({c: (1.0 - F.col(c)) * amount + F.col(c) * (1.0 - amount) for c in RGB})


def feather_ramp(distance: Column, feather: float) -> Column:
    """Signed edge distance to coverage: 0 beyond ``-feather``, 1 beyond ``feather``."""
    return clamp01((distance + feather) / (2.0 * feather))


def rect_coverage(x: int, y: int, width: Column, height: Column, feather: float) -> Column:
    """Coverage of the pixel center by a rectangle."""
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    left, right = cx - x, width + x - cx
    top, bottom = cy - y, height + y - cy
    if feather <= 0:
        return ((left >= 0) & (right > 0) & (top >= 0) & (bottom > 0)).cast("double")
    return feather_ramp(F.least(left, right, top, bottom), feather)


def frame_dims(px: DataFrame) -> DataFrame:
    """Width and height per frame from the pixels themselves."""
    return px.groupBy(*FRAME).agg(
        (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height")
    )


def with_dims(px: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Attach ``width`` and ``height``; one row per frame, so Spark picks the join by its size."""
    dims = frame_dims(px) if frames is None else frames.select(*FRAME, "width", "height")
    return px.join(dims, FRAME)


def rect_or_frame(px: DataFrame, width: int, height: int, frames: DataFrame | None):
    """The pixels and rectangle size columns; a size of zero or less means the whole frame."""
    if width > 0 and height > 0:
        return px, F.lit(float(width)), F.lit(float(height)), []
    px = with_dims(px, frames)
    w = F.lit(float(width)) if width > 0 else F.col("width").cast("double")
    h = F.lit(float(height)) if height > 0 else F.col("height").cast("double")
    return px, w, h, ["width", "height"]


def alpha_rect(
    px: DataFrame, x=0, y=0, width=0, height=0, inside=1.0, outside=0.0, feather=0.0, frames=None
) -> DataFrame:
    px, w, h, extra = rect_or_frame(px, width, height, frames)
    cover = rect_coverage(max(x, 0), max(y, 0), w, h, feather)
    return px.withColumn("a", clamp01(F.col("a") * (outside + (inside - outside) * cover))).drop(*extra)


def parse_polygon(text: str) -> list[tuple[float, float]]:
    """``"x,y; x,y; ..."`` to points; anything malformed gives no polygon."""
    points = []
    for token in filter(None, (t.strip() for t in text.split(";"))):
        try:
            x, y = (float(v) for v in token.split(","))
        except ValueError:
            return []
        points.append((x, y))
    return points


def alpha_polygon(px: DataFrame, points: str = "", inside=1.0, outside=0.0, feather=0.0) -> DataFrame:
    """Even-odd polygon mask. Segments are few and known up front, so they are literals in the plan."""
    poly = parse_polygon(points)
    if len(poly) < 3:
        return px.withColumn("a", clamp01(F.col("a") * inside))
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    crossings = F.lit(0)
    nearest = []
    for (ax, ay), (bx, by) in zip([poly[-1], *poly[:-1]], poly):
        dx, dy = bx - ax, by - ay
        if dy != 0:
            meets = bx + (cy - by) * (-dx) / (-dy)
            hit = ((F.lit(by) > cy) != (F.lit(ay) > cy)) & (cx < meets)
            crossings = crossings + hit.cast("int")
        length2 = dx * dx + dy * dy
        t = clamp01(((cx - ax) * dx + (cy - ay) * dy) / length2) if length2 else F.lit(0.0)
        nearest.append(F.hypot(cx - (ax + t * dx), cy - (ay + t * dy)))
    within = crossings % 2 == 1
    if feather <= 0:
        cover = within.cast("double")
    else:
        edge = F.least(*nearest)
        cover = feather_ramp(F.when(within, edge).otherwise(-edge), feather)
    return px.withColumn("a", clamp01(F.col("a") * (outside + (inside - outside) * cover)))


def crop(px: DataFrame, x: int, y: int, width: int, height: int, frames: DataFrame | None = None) -> DataFrame:
    """Keep a rectangle and rebase its coordinates; the filter reaches the Parquet scan.

    Frames the rectangle does not fit in are left out here and listed by ``crop_errors``. ``frames`` states the sizes; without
    it, they are the frames that have no pixel at the rectangle's far corner.
    """
    if min(x, y) < 0 or min(width, height) <= 0:
        raise OperatorError(INVALID_PARAMETER, "crop: origin must be >= 0 and size > 0")
    right, bottom = x + width - 1, y + height - 1
    if frames is None:
        fits = px.where((F.col("x") == right) & (F.col("y") == bottom)).select(*FRAME)
    else:
        fits = frames.where((F.col("width") > right) & (F.col("height") > bottom)).select(*FRAME)
    inside = px.where(F.col("x").between(x, right) & F.col("y").between(y, bottom)).join(fits, FRAME, "left_semi")
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y}).select(*px.columns)


def crop_errors(frames: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Frames the rectangle does not fit in."""
    return frames.where((F.col("width") < x + width) | (F.col("height") < y + height)).select(
        *FRAME,
        F.lit(INVALID_PARAMETER).alias("code"),
        F.format_string("crop %dx%d+%d+%d exceeds %dx%d", F.lit(width), F.lit(height), F.lit(x), F.lit(y), "width", "height").alias("reason"),
    )


def rotate_ortho(px: DataFrame, turns: int = 0, frames: DataFrame | None = None) -> DataFrame:
    """Clockwise quarter turns as a coordinate projection."""
    turns %= 4
    if turns == 0:
        return px
    px = with_dims(px, frames)
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    nx, ny = {1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns]
    return px.select(*[c for c in px.columns if c not in ("x", "y", "width", "height")], nx.alias("x"), ny.alias("y"))


def color_space_info(assets: DataFrame) -> DataFrame:
    """Linear flag and nominal nits per asset; unknown spaces count as custom."""
    dim = F.broadcast(color_spaces(assets.sparkSession))  # always 16 rows
    return assets.join(dim, "color_space", "left").withColumn("is_linear", F.coalesce("is_linear", F.lit(False)))


def pts_seconds(value: Column, num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(value.cast("double") * num / den)


def frame_index(value: Column, tb_num: Column, tb_den: Column, fps_num: Column, fps_den: Column) -> Column:
    """``value * timebase * fps`` truncated toward zero, in integer arithmetic."""
    wide = "decimal(38,0)"
    top = (value.cast("decimal(19,0)") * tb_num.cast("decimal(9,0)")).cast(wide) * fps_num.cast("decimal(9,0)")
    bottom = (tb_den.cast("decimal(19,0)") * fps_den.cast("decimal(19,0)")).cast(wide)
    return F.call_function("div", top.cast(wide), bottom)


def rational_normalize(df: DataFrame, num: str = "num", den: str = "den") -> DataFrame:
    """Lowest terms, positive denominator, ``x/0`` as ``0/1``; null operands give null terms.

    Euclid runs in place as a bounded fold, so a few time bases for all rows make no hot key: 64-bit operands need at
    most 92 steps.
    """
    pair = F.struct(F.abs(num).alias("p"), F.abs(den).alias("q"))
    gcd = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        pair,
        lambda s, _: F.when(s["q"] == 0, s).otherwise(F.struct(s["q"].alias("p"), (s["p"] % s["q"]).alias("q"))),
        lambda s: s["p"],
    )
    flip = F.when(F.col(den) < 0, F.lit(-1)).otherwise(F.lit(1))
    known = F.col(num).isNotNull() & F.col(den).isNotNull()
    by = F.greatest(gcd, F.lit(1))
    top = F.when(F.col(den) == 0, F.lit(0)).otherwise(F.call_function("div", F.col(num) * flip, by)).cast("bigint")
    bottom = F.when(F.col(den) == 0, F.lit(1)).otherwise(F.call_function("div", F.abs(den), by)).cast("bigint")
    return df.withColumns({"norm_num": F.when(known, top), "norm_den": F.when(known, bottom)})

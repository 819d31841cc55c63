"""Column expressions for color: transfer curves, luma, clamping, and the color-space dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rec.709 luma weights and the sRGB transfer thresholds.
LUMA_R, LUMA_G, LUMA_B = 0.2126, 0.7152, 0.0722
SRGB_TO_LINEAR_AT = 0.04045
LINEAR_TO_SRGB_AT = 0.0031308

# Slug, is linear, nominal peak nits (None where the space has no nominal peak).
COLOR_SPACES = [
    ("srgb", False, 100.0),
    ("linear_srgb", True, None),
    ("rec709", False, 100.0),
    ("linear_rec709", True, None),
    ("rec2020_pq", False, 10000.0),
    ("rec2020_hlg", False, 1000.0),
    ("linear_rec2020", True, None),
    ("aces_cg", True, None),
    ("aces2065", True, None),
    ("dci_p3", False, 48.0),
    ("display_p3", False, 100.0),
    ("linear_dci_p3", True, None),
    ("arri_log_c3", False, None),
    ("s_log3", False, None),
    ("apple_log", False, None),
    ("custom", False, None),
]


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def luma(r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return r * LUMA_R + g * LUMA_G + b * LUMA_B


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= SRGB_TO_LINEAR_AT, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= LINEAR_TO_SRGB_AT, c * 12.92).otherwise(
        F.pow(c, F.lit(1.0 / 2.4)) * 1.055 - 0.055
    )


def color_spaces(spark: SparkSession) -> DataFrame:
    """The 16-row color-space dimension."""
    return spark.createDataFrame(COLOR_SPACES, "color_space STRING, is_linear BOOLEAN, nominal_nits DOUBLE")

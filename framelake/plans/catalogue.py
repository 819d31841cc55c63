"""Effect catalogue: ids, parameter specs and the operator behind each id; open to user effects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, UNKNOWN_EFFECT, OperatorError
from framelake.functions.tiles import tile_map
from framelake.operators import pointwise, resample, spectral, stencil
from framelake.schemas import PARAM_SPECS, RGB, RGBA


@dataclass(frozen=True)
class Param:
    key: str
    kind: str  # bool, int, float, string, choice
    default: object
    lo: float | None = None
    hi: float | None = None
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Effect:
    id: str
    run: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    neutral: Callable[[dict], bool] = field(default=lambda p: False)
    reads_again: bool = False  # its plan reads its input more than once


def _float(key, default, lo=None, hi=None):
    return Param(key, "float", default, lo, hi)


def _int(key, default, lo=None, hi=None):
    return Param(key, "int", default, lo, hi)


def _wheels(px, **p):
    return pointwise.primary_wheels(
        px, *[tuple(p[f"{w}_{c}"] for c in RGB) for w in ("lift", "gamma", "gain")]
    )


def _duotone(px, amount, **p):
    return pointwise.duotone(px, *[tuple(p[f"{w}_{c}"] for c in RGB) for w in ("shadow", "highlight")], amount)


def _lut(px, path, strength):
    from framelake.sources.luts import read_cube

    lut, size, lo, hi = read_cube(px.sparkSession, path)
    return resample.lut_trilinear(px, lut, size, strength, lo, hi)


def _translate(px, dx, dy, subpixel):
    return resample.translate_all(px, dx, dy, subpixel)


# Effect ids with their parameters, defaults and ranges.
BUILT_IN = [
    Effect("color.curves", pointwise.curves, tuple(Param(f"points_{c}", "string", "") for c in ("r", "g", "b", "luma")), lambda p: not any(p.values())),
    Effect("color.duotone", _duotone, (
        _float("shadow_r", 0.04, 0, 1), _float("shadow_g", 0.07, 0, 1), _float("shadow_b", 0.18, 0, 1),
        _float("highlight_r", 0.95, 0, 1), _float("highlight_g", 0.78, 0, 1), _float("highlight_b", 0.42, 0, 1),
        _float("amount", 0.85, 0, 1)), lambda p: p["amount"] == 0),
    Effect("color.lut3d", _lut, (Param("path", "string", ""), _float("strength", 1.0, 0, 1)), lambda p: not p["path"] or p["strength"] <= 0),
    Effect("color.primary_wheels", _wheels, tuple(
        _float(f"{w}_{c}", d, lo, hi) for w, d, lo, hi in (("lift", 0.0, -1, 1), ("gamma", 1.0, 0.05, 10), ("gain", 1.0, 0, 4)) for c in RGB)),
    Effect("color.saturation", pointwise.saturation, (_float("amount", 1.0, 0, 2),)),
    Effect("compression.deblock", stencil.deblock, (_int("block_size", 8, 4, 32), _float("strength", 0.6, 0, 4)), lambda p: p["strength"] <= 0),
    Effect("deblur.laplacian", stencil.laplacian_dog, (_float("amount", 1.0, 0, 4), _float("sigma", 1.0, 0.1, 10), _float("sigma_ratio", 1.6, 1.1, 5)), lambda p: p["amount"] == 0),
    Effect("deblur.richardson_lucy", spectral.richardson_lucy, (_float("sigma", 1.0, 0.3, 8), _int("iterations", 8, 1, 50), _float("damping", 0.0, 0, 1))),
    Effect("deblur.wiener", lambda px, sigma, nsr, iterations: spectral.wiener(px, sigma, nsr), (_float("sigma", 1.0, 0.3, 8), _float("nsr", 0.01, 0.0001, 0.5), _int("iterations", 1, 1, 1))),
    Effect("denoise.bilateral", stencil.bilateral, (_float("sigma_spatial", 2.0, 0.5, 16), _float("sigma_range", 0.10, 0.01, 1), _int("radius", 3, 1, 32))),
    Effect("denoise.gaussian", stencil.gaussian, (_float("sigma", 1.0, 0.1, 20),)),
    Effect("denoise.median", stencil.median, (_int("radius", 1, 1, 8),)),
    Effect("exposure.brightness_contrast", pointwise.brightness_contrast, (_float("brightness", 0.0, -1, 1), _float("contrast", 1.0, 0, 4))),
    Effect("exposure.gamma", pointwise.gamma, (_float("gamma", 1.0, 0.05, 10),)),
    Effect("face.skin_smooth_in_rect", stencil.skin_smooth_rect, (
        _int("x", 0, 0), _int("y", 0, 0), _int("width", 0, 0), _int("height", 0, 0),
        _float("radius", 2.0, 0.1, 20), _float("amount", 0.5, 0, 1), _float("feather", 4.0, 0, 256))),
    Effect("geometric.crop", pointwise.crop, (_int("x", 0, 0), _int("y", 0, 0), _int("width", 256, 1), _int("height", 256, 1))),
    Effect("geometric.resize", resample.resize_bilinear, (_int("width", 1024, 1, 65535), _int("height", 1024, 1, 65535))),
    Effect("geometric.rotate_ortho", pointwise.rotate_ortho, (_int("turns", 1, 0, 3),), lambda p: p["turns"] % 4 == 0),
    Effect("mask.alpha_polygon", pointwise.alpha_polygon, (Param("points", "string", ""), _float("inside", 1.0, 0, 1), _float("outside", 0.0, 0, 1), _float("feather", 0.0, 0, 256))),
    Effect("mask.alpha_rect", pointwise.alpha_rect, (
        _int("x", 0, 0), _int("y", 0, 0), _int("width", 0, 1), _int("height", 0, 1),
        _float("inside", 1.0, 0, 1), _float("outside", 0.0, 0, 1), _float("feather", 0.0, 0, 512))),
    Effect("modalities.channel_isolate", pointwise.channel_isolate, (Param("channel", "choice", "luma", options=("r", "g", "b", "a", "luma")), Param("invert", "bool", False))),
    Effect("sharpen.unsharp_mask", stencil.unsharp_mask, (_float("amount", 0.5, 0, 4), _float("radius", 1.0, 0.1, 20), _float("threshold", 0.0, 0, 1)), lambda p: p["amount"] == 0),
    Effect("stabilize.translate", _translate, (_float("dx", 0.0, -4096, 4096), _float("dy", 0.0, -4096, 4096), Param("subpixel", "bool", True))),
    Effect("temporal.motion_blur_directional", stencil.motion_blur, (_float("length", 8.0, 0, 256), _float("angle_degrees", 0.0, -360, 360), _int("samples", 16, 2, 256)), lambda p: p["length"] < 0.5),
    Effect("text.clahe", stencil.clahe, (_int("tiles_x", 8, 1, 64), _int("tiles_y", 8, 1, 64), _float("clip_limit", 2.5, 0, 16))),
    Effect("upscale.bicubic", resample.upscale_mitchell, (_float("scale", 2.0, 0.25, 8),)),
    Effect("upscale.catmull_rom", resample.upscale_catmull, (_float("scale", 2.0, 0.25, 8),)),
    Effect("upscale.lanczos", resample.upscale_lanczos, (_float("scale", 2.0, 0.25, 8), _int("lobes", 3, 2, 6))),
    Effect("weather.dehaze_dcp", stencil.dehaze_dcp, (_float("omega", 0.95, 0.5, 1), _float("t0", 0.1, 0.01, 0.5), _int("patch_radius", 7, 1, 31))),
]

#: Effects that need frame sizes, frame statistics or several spectra, and so read their input more than once.
READS_AGAIN = {
    "compression.deblock", "deblur.richardson_lucy", "deblur.wiener", "face.skin_smooth_in_rect", "geometric.crop", "geometric.resize", "geometric.rotate_ortho",
    "mask.alpha_rect", "stabilize.translate", "text.clahe", "upscale.bicubic", "upscale.catmull_rom", "upscale.lanczos", "weather.dehaze_dcp",
}
BUILT_IN = [replace(e, reads_again=e.id in READS_AGAIN) for e in BUILT_IN]


class Registry:
    """Effects by id. User effects get the same parameter checks as the built-in ones."""

    def __init__(self, effects=BUILT_IN):
        self._effects = {e.id: e for e in effects}

    def register(self, effect: Effect) -> None:
        if effect.id in self._effects:
            raise OperatorError(INVALID_PARAMETER, f"effect {effect.id!r} is already registered")
        self._effects[effect.id] = effect

    def get(self, effect_id: str) -> Effect:
        if effect_id not in self._effects:
            raise OperatorError(UNKNOWN_EFFECT, f"unknown effect {effect_id!r}")
        return self._effects[effect_id]

    def ids(self) -> list[str]:
        return sorted(self._effects)

    def bind(self, effect_id: str, given: dict) -> dict:
        """Defaults filled, integers promoted for float parameters, ranges checked."""
        specs = {p.key: p for p in self.get(effect_id).params}
        for key in given:
            if key not in specs:
                raise OperatorError(INVALID_PARAMETER, f"{effect_id}: unknown parameter {key!r}")
        bound = {}
        for key, spec in specs.items():
            value = given.get(key, spec.default)
            promoted = spec.kind == "float" and isinstance(value, int) and not isinstance(value, bool)
            want = {"bool": bool, "int": int, "float": float, "string": str, "choice": str}[spec.kind]
            if key in given and not promoted and (not isinstance(value, want) or isinstance(value, bool) and want is not bool):
                raise OperatorError(INVALID_PARAMETER, f"{effect_id}: {key} must be {spec.kind}")
            if key in given and not promoted and spec.kind in ("int", "float"):
                if (spec.lo is not None and value < spec.lo) or (spec.hi is not None and value > spec.hi):
                    raise OperatorError(INVALID_PARAMETER, f"{effect_id}: {key}={value} outside {spec.lo}..{spec.hi}")
            bound[key] = float(value) if promoted else value
        return bound

    def spec_rows(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table, one row per parameter."""
        rows = []
        for effect_id in self.ids():
            for p in self._effects[effect_id].params:
                slot = {"bool": 0, "int": 1, "float": 2, "string": 3, "choice": 3}[p.kind]
                default = [None] * 4
                default[slot] = float(p.default) if p.kind == "float" else p.default
                bounds = [None if b is None else float(b) for b in (p.lo, p.hi)]
                rows.append((effect_id, p.key, p.kind, *default, *bounds, list(p.options)))
        return spark.createDataFrame(rows, PARAM_SPECS)


def per_pixel(effect_id: str, fn: Callable[..., pd.DataFrame], params: tuple[Param, ...] = ()) -> Effect:
    """A user effect over Arrow batches of pixels: ``fn(DataFrame[r,g,b,a], **params)``."""

    def run(px: DataFrame, **bound) -> DataFrame:
        @F.pandas_udf("r DOUBLE, g DOUBLE, b DOUBLE, a DOUBLE")
        def apply(r: pd.Series, g: pd.Series, b: pd.Series, a: pd.Series) -> pd.DataFrame:
            return fn(pd.DataFrame({"r": r, "g": g, "b": b, "a": a}), **bound)[RGBA]

        return px.withColumn("_v", apply(*RGBA)).withColumns({c: F.col(f"_v.{c}") for c in RGBA}).drop("_v")

    return Effect(effect_id, run, params)


def per_tile(effect_id: str, fn: Callable, halo: int, params: tuple[Param, ...] = ()) -> Effect:
    """A user effect over edge-padded tile blocks: ``fn(block, **params)`` as in ``tile_map``."""
    return Effect(effect_id, lambda px, **bound: tile_map(px, halo, lambda block: fn(block, **bound)), params)

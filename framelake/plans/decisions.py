"""Choosing recipes from frame statistics, and the named recipe templates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, OperatorError
from framelake.functions.color import clamp
from framelake.operators.metrics import with_cast
from framelake.schemas import FRAME

STEP = "recipe STRING, step_no INT, effect STRING, label STRING, params STRING"


def _step(effect: str, label: str, **params: Column) -> Column:
    names = [v.alias(k) for k, v in params.items()]
    return F.struct(F.lit(effect).alias("effect"), F.lit(label).alias("label"), F.to_json(F.struct(*names)).alias("params"))


def _rounded(value: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, with the sign of a zero; Spark's own ``round`` drops that sign."""
    unit = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * unit + 0.5) / unit


def auto_chain(stats: DataFrame) -> DataFrame:
    """Up to four steps per frame; a step that would hardly change the frame is left out."""
    # Targets, limits and suppression thresholds of the automatic chain.
    span = F.greatest(F.col("p99") - F.col("p01"), F.lit(0.02))
    contrast = clamp(0.90 / span, 0.7, 2.5)
    brightness = clamp(0.05 - (F.col("p01") - 0.5) * contrast - 0.5, -0.4, 0.4)
    stats = stats.withColumns({"c": contrast, "b": brightness})
    mid = clamp((F.col("p50") - 0.5) * F.col("c") + 0.5 + F.col("b"), 0.02, 0.98)
    power = clamp(F.log(mid) / F.log(F.lit(0.5)), 0.5, 2.0)
    chroma = F.col("chroma_mean")
    amount = F.when(chroma < 0.05, 1.15).when(chroma < 0.10, 1.30).when(chroma < 0.20, 1.20).when(chroma > 0.40, 0.92).otherwise(1.0)
    edge = F.col("edge_mean")
    crisp = F.when(edge < 0.04, 0.9).when(edge < 0.08, 0.6).when(edge > 0.18, 0.25).otherwise(0.5)
    radius = F.when(edge < 0.04, 1.2).when(edge < 0.08, 1.1).when(edge > 0.18, 0.9).otherwise(1.0)
    tone_moves = (F.abs(F.col("c") - 1.0) > 0.04) | (F.abs("b") > 0.02)
    gamma_moves = (F.abs(mid - 0.5) > 0.04) & (F.abs(power - 1.0) > 0.03)
    steps = F.array_compact(F.array(
        F.when(tone_moves, _step("exposure.brightness_contrast", "auto bc", brightness=_rounded(F.col("b"), 3), contrast=_rounded(F.col("c"), 2))),
        F.when(gamma_moves, _step("exposure.gamma", "auto gamma", gamma=_rounded(power, 2))),
        F.when(F.abs(amount - 1.0) > 0.03, _step("color.saturation", "auto sat", amount=amount)),
        _step("sharpen.unsharp_mask", "auto sharpen", amount=crisp, radius=radius, threshold=F.lit(0.0)),
    ))
    return stats.select(*FRAME, F.posexplode(steps).alias("step_no", "s")).select(*FRAME, "step_no", "s.*")


def degradation_score() -> Column:
    """Six one-point signs of a degraded frame."""
    span = F.col("p99") - F.col("p01")
    signs = [
        F.col("edge_mean") < 0.06, F.col("edge_mean") < 0.03, span < 0.50, span < 0.30,
        F.col("chroma_mean") < 0.10, F.col("chroma_mean") < 0.05,
    ]
    return sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))


def smart_strategy(stats: DataFrame) -> DataFrame:
    score = degradation_score()
    tier = F.when(score >= 4, "clarify-aggressive").when(score >= 2, "clarify-standard").otherwise("auto-enhance")
    return stats.withColumns({"score": score, "strategy": tier})


def diagnose(stats: DataFrame) -> DataFrame:
    """Named problems per frame, in reporting order, and a recommendation."""
    s = with_cast(stats)
    span, edge, chroma = F.col("p99") - F.col("p01"), F.col("edge_mean"), F.col("chroma_mean")
    found = F.array_compact(F.array(
        F.when(span < 0.30, F.lit("Low dynamic range")).when(span < 0.50, F.lit("Compressed range")),
        F.when(F.col("p99") < 0.85, F.lit("Highlights underexposed")),
        F.when(F.col("p01") > 0.10, F.lit("Shadows lifted")),
        F.when(F.col("p50") < 0.30, F.lit("Midtones dark")),
        F.when(F.col("p50") > 0.70, F.lit("Midtones bright")),
        F.when(chroma < 0.05, F.lit("Near-monochrome")).when(chroma < 0.10, F.lit("Low chroma")),
        F.when(edge < 0.03, F.lit("Very blurry / soft")).when(edge < 0.06, F.lit("Some softness")),
        F.when(F.col("cast_mag") > 0.06, F.lit("Color cast detected")),
    ))
    score = degradation_score()
    nudge = (span < 0.85) | (F.abs(F.col("p50") - 0.5) > 0.10) | (F.col("cast_mag") > 0.08)
    advice = F.when(score >= 4, "clarify-aggressive").when(score >= 2, "clarify-standard").when(nudge, "auto-enhance").otherwise("none")
    return s.select(*FRAME, F.array_join(found, "; ").alias("problems"), F.size(found).alias("problem_count"), advice.alias("recommendation"))


# Clarify tiers. Columns: noise sigma, deblock strength, dehaze omega, CLAHE clip, CLAHE tiles,
# Laplacian amount, unsharp amount, contrast, cleanup sigma, Wiener sigma, Wiener nsr, unsharp passes,
# Richardson-Lucy sigma, iterations, damping, bilateral instead of Gaussian, upscale factor.
TIERS = {
    "light": (0.5, 0.25, 0.55, 1.2, 8, 0.0, 0.35, 1.04, 0.35, 0.0, 0.05, 1, 0.0, 0, 0.0, False, 2.0),
    "standard": (0.7, 0.45, 0.65, 1.8, 8, 0.0, 0.5, 1.06, 0.45, 0.0, 0.05, 1, 0.0, 0, 0.0, False, 2.0),
    "aggressive": (0.9, 0.6, 0.80, 2.5, 10, 0.4, 0.7, 1.10, 0.55, 1.1, 0.012, 2, 0.0, 0, 0.0, False, 2.0),
    "plate": (1.1, 0.7, 0.75, 1.8, 16, 0.0, 0.55, 1.12, 0.6, 1.5, 0.02, 3, 0.0, 0, 0.0, False, 2.0),
    "forensic": (0.0, 0.7, 0.72, 1.6, 16, 0.0, 0.45, 1.10, 0.0, 1.4, 0.025, 3, 1.4, 12, 0.35, True, 4.0),
}
ALIASES = {"extreme": "plate", "police": "forensic"}  # fixed values


def clarify_chain(strength: str, upscale: bool = False) -> list[tuple[str, str, dict]]:
    """Steps of a clarify tier; an unknown strength means ``standard``."""
    tier = ALIASES.get(strength, strength)
    tier = tier if tier in TIERS else "standard"
    (noise, block, omega, clip, tiles, lap, sharp, contrast, cleanup, w_sigma, w_nsr, passes, rl_sigma, rl_n, rl_damp, keep_edges, factor) = TIERS[tier]
    soft = lambda when, sigma, fixed: (
        ("denoise.bilateral", f"clarify bilateral ({when})", fixed) if keep_edges
        else ("denoise.gaussian", f"clarify denoise ({when})", {"sigma": sigma})
    )
    chain = [
        soft("pre", noise, {"sigma_spatial": 2.0, "sigma_range": 0.08, "radius": 3}),
        ("compression.deblock", "clarify deblock", {"block_size": 8, "strength": block}),
        ("weather.dehaze_dcp", "clarify dehaze", {"omega": omega, "t0": 0.15, "patch_radius": 5}),
        ("text.clahe", "clarify CLAHE", {"tiles_x": tiles, "tiles_y": tiles, "clip_limit": clip}),
        soft("post", cleanup, {"sigma_spatial": 1.5, "sigma_range": 0.06, "radius": 2}),
    ]
    if w_sigma:
        chain.append(("deblur.wiener", "clarify wiener", {"sigma": w_sigma, "nsr": w_nsr, "iterations": 1}))
    if rl_sigma and rl_n:
        chain.append(("deblur.richardson_lucy", "clarify richardson-lucy", {"sigma": rl_sigma, "iterations": rl_n, "damping": rl_damp}))
    if lap:
        chain.append(("deblur.laplacian", "clarify laplacian", {"amount": lap, "sigma": 0.9, "sigma_ratio": 1.6}))
    for k in range(passes):
        name = "clarify sharpen" if passes == 1 else f"clarify sharpen pass {k + 1}"
        amount = round(max(sharp * (1.0 - 0.30 * k), 0.05), 12)
        chain.append(("sharpen.unsharp_mask", name, {"amount": amount, "radius": 1.0, "threshold": 0.015}))
    chain.append(("exposure.brightness_contrast", "clarify tone", {"brightness": 0.0, "contrast": contrast}))
    if upscale:
        fine = tier in ("plate", "forensic")
        chain.append(("upscale.lanczos", "clarify upscale", {"scale": factor, "lobes": 3}) if fine else ("upscale.bicubic", "clarify upscale", {"scale": 2.0}))
    return chain


def _sharpen(label, amount, radius=1.0, threshold=0.0):
    return ("sharpen.unsharp_mask", label, {"amount": amount, "radius": radius, "threshold": threshold})


def _tone(label, brightness, contrast):
    return ("exposure.brightness_contrast", label, {"brightness": brightness, "contrast": contrast})


# Named looks.
STYLES = {
    "pop": [("color.saturation", "pop sat", {"amount": 1.35}), _sharpen("pop sharpen", 1.0), _tone("pop bc", 0.02, 1.1)],
    "bw": [("modalities.channel_isolate", "bw luma", {"channel": "luma", "invert": False}), _tone("bw bc", 0.0, 1.08), _sharpen("bw sharpen", 0.5)],
    "vintage": [
        ("color.saturation", "vintage desat", {"amount": 0.78}), ("exposure.gamma", "vintage gamma", {"gamma": 1.08}),
        _tone("vintage bc", 0.02, 0.92), _sharpen("vintage sharpen", 0.3, 1.4, 0.02)],
    "sharpen": [("deblur.laplacian", "laplacian", {"amount": 0.8, "sigma": 0.8, "sigma_ratio": 1.6}), _sharpen("unsharp", 1.2, 0.9)],
    "restore": [
        ("denoise.gaussian", "restore denoise", {"sigma": 0.6}),
        ("text.clahe", "restore CLAHE", {"tiles_x": 8, "tiles_y": 8, "clip_limit": 1.5}),
        ("color.saturation", "restore sat", {"amount": 1.10}), _sharpen("restore sharpen", 0.5)],
}

# Palettes as shadow color, highlight color, amount, CLAHE clip, sharpening.
PALETTES = {
    "night": ((0.04, 0.07, 0.20), (0.96, 0.78, 0.40), 0.92, 2.0, 0.4),
    "day": ((0.18, 0.30, 0.46), (0.98, 0.92, 0.78), 0.85, 1.5, 0.3),
    "sepia": ((0.18, 0.10, 0.05), (0.98, 0.86, 0.62), 0.95, 1.0, 0.3),
    "cyan-orange": ((0.05, 0.30, 0.40), (0.98, 0.62, 0.18), 0.88, 1.5, 0.4),
    "noir": ((0.02, 0.02, 0.05), (0.92, 0.92, 0.95), 1.00, 2.5, 0.5),
}


def style_chain(name: str) -> list[tuple[str, str, dict]]:
    if name not in STYLES:
        raise OperatorError(INVALID_PARAMETER, f"unknown preset {name!r}; known: {', '.join(STYLES)}")
    return STYLES[name]


def palette_chain(name: str) -> list[tuple[str, str, dict]]:
    if name not in PALETTES:
        raise OperatorError(INVALID_PARAMETER, f"unknown palette {name!r}; known: {', '.join(PALETTES)}")
    shadow, highlight, amount, clip, sharp = PALETTES[name]
    colors = {f"{w}_{c}": v for w, color in (("shadow", shadow), ("highlight", highlight)) for c, v in zip("rgb", color)}
    return [
        ("modalities.channel_isolate", "colorize prep", {"channel": "luma", "invert": False}),
        ("color.duotone", f"colorize {name}", {**colors, "amount": amount}),
        ("text.clahe", "colorize CLAHE", {"tiles_x": 6, "tiles_y": 6, "clip_limit": clip}),
        _sharpen("colorize sharpen", sharp),
    ]


def templates() -> dict[str, list[tuple[str, str, dict]]]:
    """All named recipes: clarify tiers, styles and palettes."""
    named = {f"clarify-{t}": clarify_chain(t) for t in TIERS}
    named |= {f"style-{n}": style_chain(n) for n in STYLES}
    return named | {f"palette-{n}": palette_chain(n) for n in PALETTES}


def template_rows() -> list[tuple[str, int, str, str, str]]:
    return [
        (recipe, i, effect, label, json.dumps(params, sort_keys=True, separators=(",", ":")))
        for recipe, steps in templates().items() for i, (effect, label, params) in enumerate(steps)
    ]


def template_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), STEP)


def steps_for(assigned: DataFrame) -> DataFrame:
    """Template steps of each row's named ``recipe``; the template table has about 80 rows."""
    return assigned.join(F.broadcast(template_steps(assigned.sparkSession)), "recipe")

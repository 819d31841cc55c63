"""Quality metrics, frame statistics and fusion of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.errors import LAYOUT
from framelake.functions import kernels
from framelake.functions.color import clamp01, luma
from framelake.functions.ordering import order_statistics
from framelake.functions.tiles import tile_map
from framelake.operators.pointwise import frame_dims
from framelake.operators.stencil import correlate, edge_step
from framelake.schemas import FRAME, PIXEL, RGB, RGBA

INFINITY = float("inf")


def frame_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pixels of two renderings side by side; the right one's colors are ``r2, g2, b2``."""
    other = right.select(*PIXEL, *[F.col(c).alias(f"{c}2") for c in RGB])
    return left.join(other, PIXEL)


def pair_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per frame of either side: both sides' sizes (null where a side lacks the frame), summed squared error and shared pixels.

    One full join of the pixels tells sizes, errors and frames that only one side holds, so nothing is read again for them.
    """
    a = left.select(*PIXEL, *RGB, F.lit(True).alias("_l"))
    b = right.select(*PIXEL, *[F.col(c).alias(f"{c}2") for c in RGB], F.lit(True).alias("_r"))
    sides = [F.max(F.when(F.col(side), F.col(at) + 1)).alias(name) for side, at, name in (("_l", "x", "w1"), ("_l", "y", "h1"), ("_r", "x", "w2"), ("_r", "y", "h2"))]
    both = F.when(F.col("_l") & F.col("_r"), 1)
    return a.join(b, PIXEL, "full").groupBy(*FRAME).agg(*sides, F.sum(squared_error()).alias("total"), F.count(both).alias("pixels"))


def pair_errors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames that cannot be compared: their sizes differ, or only one side holds them."""
    slim = [side.select(*PIXEL, *[F.lit(0.0).alias(c) for c in RGB]) for side in (left, right)]
    differ = F.format_string("frame dims differ: %dx%d vs %dx%d", "w1", "h1", "w2", "h2")
    lone = F.concat(F.lit("only the "), F.when(F.col("w1").isNull(), "second").otherwise("first"), F.lit(" side has the frame"))
    return pair_table(*slim).where("NOT (w1 <=> w2 AND h1 <=> h2)").select(
        *FRAME, F.lit(LAYOUT).alias("code"), F.when(F.col("w1").isNull() | F.col("w2").isNull(), lone).otherwise(differ).alias("reason")
    )


def comparable(scores: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Only the scores of frames that both sides hold in one size; ``pair_errors`` lists the others."""
    sizes = frame_dims(left).join(frame_dims(right), [*FRAME, "width", "height"]).select(*FRAME)
    return scores.join(sizes, FRAME, "left_semi")


def squared_error() -> Column:
    return sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in RGB[1:]), (F.col("r") - F.col("r2")) ** 2)


def mse_of(total: Column, pixels: Column) -> Column:
    return F.coalesce(total / (pixels * 3.0), F.lit(0.0))


def psnr_of(mse: Column) -> Column:
    return F.when(mse <= 0, F.lit(INFINITY)).otherwise(-10.0 * F.log10(mse))


def mse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean squared error of frames that both sides hold in one size; ``pair_errors`` lists the others."""
    return pair_table(left, right).where("w1 = w2 AND h1 = h2").select(*FRAME, mse_of(F.col("total"), F.col("pixels")).alias("mse"))


def psnr(left: DataFrame, right: DataFrame) -> DataFrame:
    return mse(left, right).select(*FRAME, psnr_of(F.col("mse")).alias("psnr"))


# Fixed values of the structural-similarity index (Wang et al. 2004).
SSIM_SIGMA, SSIM_HALF, SSIM_K1, SSIM_K2 = 1.5, 5, 0.01, 0.03


def _similarity(pairs: DataFrame) -> DataFrame:
    """Per-pixel similarity from five Gaussian-weighted planes that share one exchange."""
    la, lb = luma(), luma("r2", "g2", "b2")
    planes = pairs.select(*PIXEL, squared_error().alias("_se"), la.alias("ma"), lb.alias("mb"))
    planes = planes.withColumns(
        {"aa": F.col("ma") * F.col("ma"), "bb": F.col("mb") * F.col("mb"), "ab": F.col("ma") * F.col("mb")}
    )
    taps = kernels.gaussian_fixed(SSIM_SIGMA, SSIM_HALF)
    cols = ["ma", "mb", "aa", "bb", "ab"]
    soft = tile_map(planes, SSIM_HALF, lambda block: correlate(correlate(block, taps, 1), taps, 0), cols)
    c1, c2 = SSIM_K1**2, SSIM_K2**2
    ma, mb = F.col("ma"), F.col("mb")
    var_a = F.greatest(F.col("aa") - ma * ma, F.lit(0.0))
    var_b = F.greatest(F.col("bb") - mb * mb, F.lit(0.0))
    cov = F.col("ab") - ma * mb
    value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (var_a + var_b + c2))
    return soft.select(*PIXEL, "_se", value.alias("_ssim"))


def ssim(left: DataFrame, right: DataFrame) -> DataFrame:
    return comparable(_similarity(frame_pair(left, right)).groupBy(*FRAME).agg(F.avg("_ssim").alias("ssim")), left, right)


def all_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """MSE, PSNR and SSIM per frame from one join and one aggregate."""
    per_frame = _similarity(frame_pair(left, right)).groupBy(*FRAME).agg(
        mse_of(F.sum("_se"), F.count(F.lit(1))).alias("mse"), F.avg("_ssim").alias("ssim")
    )
    return comparable(per_frame.select(*FRAME, "mse", psnr_of(F.col("mse")).alias("psnr"), "ssim"), left, right)


def stack_errors(px: DataFrame, least_frames: int = 1) -> DataFrame:
    """Frames that keep their asset from being combined: another size than its first frame, or too few frames."""
    dims = frame_dims(px)
    first = dims.groupBy("asset_id").agg(
        F.min_by(F.struct("width", "height"), "frame_no").alias("_first"), F.count(F.lit(1)).alias("_frames")
    )
    seen = dims.join(first, "asset_id")
    few, other = F.col("_frames") < least_frames, F.struct("width", "height") != F.col("_first")
    return seen.where(few | other).select(
        *FRAME, F.lit(LAYOUT).alias("code"),
        F.when(few, F.format_string("%d frames, at least %d needed", "_frames", F.lit(least_frames)))
        .otherwise(F.format_string("frame is %dx%d, its first frame %dx%d", "width", "height", "_first.width", "_first.height")).alias("reason"),
    )


def combinable(px: DataFrame, least_frames: int = 1) -> DataFrame:
    """Pixels of the assets that ``stack_errors`` has nothing against."""
    return px.join(stack_errors(px, least_frames).select("asset_id").distinct(), "asset_id", "left_anti")


def _middle(px: DataFrame, upper: bool) -> DataFrame:
    """Per-pixel median across frames by rank, so very long stacks spill instead of filling memory."""
    values = px.select("asset_id", "y", "x", F.posexplode(F.array(*RGBA)).alias("ch", "v"))
    site = Window.partitionBy("asset_id", "y", "x", "ch")
    ranked = values.withColumns({"rk": F.row_number().over(site.orderBy("v")), "n": F.count(F.lit(1)).over(site)})
    half = F.floor(F.col("n") / 2)
    hit = F.col("rk") == half + 1
    if not upper:
        hit = hit | ((F.col("n") % 2 == 0) & (F.col("rk") == half))
    return ranked.where(hit).groupBy("asset_id", "y", "x").agg(
        *[clamp01(F.avg(F.when(F.col("ch") == k, F.col("v")))).alias(c) for k, c in enumerate(RGBA)]
    )


def stack(px: DataFrame, how: str = "mean") -> DataFrame:
    """All frames of an asset into one: mean, max, min, or the upper median.

    Assets with frames of several sizes are left out here and listed by ``stack_errors``.
    """
    px = combinable(px)
    if how == "median":
        return _middle(px, upper=True)
    fold = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    return px.groupBy("asset_id", "y", "x").agg(*[clamp01(fold(c)).alias(c) for c in RGBA])


def fuse_median(px: DataFrame) -> DataFrame:
    """Median fusion that averages the two middle values of an even stack; assets of mixed sizes as in ``stack``."""
    return _middle(combinable(px), upper=False)


def frame_stats(px: DataFrame) -> DataFrame:
    """Luma percentiles at floored ranks, mean chroma, mean edge, and channel means per frame."""
    lit = px.withColumn("lum", luma())
    ranks = order_statistics(lit, FRAME, "lum", {"p01": 0.005, "p50": 0.5, "p99": 0.995})
    means = edge_step(px, keep_first=True).groupBy(*FRAME).agg(
        F.coalesce(F.avg("edge"), F.lit(0.0)).alias("edge_mean"),
        F.avg(F.greatest(*RGB) - F.least(*RGB)).alias("chroma_mean"),
        F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("luminance_mean"),
        *[F.avg(c).alias(f"{c}_mean") for c in RGB],
    )
    return ranks.join(means, FRAME)


CAST_EPS = 0.012  # fixed value: deviation at which a tint is named


def channel_cast(px: DataFrame) -> DataFrame:
    """Deviation of channel means from neutral, its size, and the named tints."""
    means = px.groupBy(*FRAME).agg(*[F.avg(c).alias(f"{c}_mean") for c in RGB])
    return with_cast(means)


def with_cast(stats: DataFrame) -> DataFrame:
    mid = (F.col("r_mean") + F.col("g_mean") + F.col("b_mean")) / 3.0
    moved = stats.withColumns({f"d{c}": F.col(f"{c}_mean") - mid for c in RGB})
    # Tint names in reporting order.
    named = [
        (F.col("dr") > CAST_EPS, "warm/red"), (F.col("db") > CAST_EPS, "cool/blue"), (F.col("dg") > CAST_EPS, "green"),
        (F.col("dr") < -CAST_EPS, "cyan-ish"), (F.col("db") < -CAST_EPS, "yellow-ish"), (F.col("dg") < -CAST_EPS, "magenta"),
    ]
    tags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in named]))
    size = F.sqrt(F.col("dr") ** 2 + F.col("dg") ** 2 + F.col("db") ** 2)
    return moved.withColumns(
        {"cast_mag": size, "cast_dir": F.when(F.size(tags) == 0, F.lit("neutral")).otherwise(F.array_join(tags, ", "))}
    )


# A golden case passes at these unless it names its own.
SSIM_PASS, PSNR_PASS = 0.99, 35.0


def judge(results: DataFrame) -> DataFrame:
    """Pass flag and message per golden result; missing metrics count as failed, never as null."""
    nan = F.lit(float("nan"))
    scored = results.withColumns(
        {
            "ssim": F.coalesce("ssim", nan), "psnr": F.coalesce("psnr", nan),
            "ssim_min": F.coalesce("ssim_min", F.lit(SSIM_PASS)), "psnr_min": F.coalesce("psnr_min", F.lit(PSNR_PASS)),
        }
    )
    good = (~F.isnan("ssim")) & (~F.isnan("psnr")) & (F.col("ssim") >= F.col("ssim_min")) & (F.col("psnr") >= F.col("psnr_min"))
    why = F.when(F.isnan("ssim"), "dims differ or no golden").when(good, "ok").when(
        F.col("ssim") < F.col("ssim_min"), "ssim below threshold"
    ).otherwise("psnr below threshold")
    return scored.withColumns({"passed": good, "message": why})


def qa_summary(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))

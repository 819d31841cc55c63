"""Operators refuse or list what they cannot answer, instead of answering in part."""

import numpy as np
import pytest

from framelake.errors import OperatorError
from framelake.functions import kernels
from framelake.operators import metrics, pointwise, resample, spectral, stencil
from framelake.plans import chain
from framelake.sources import images


@pytest.fixture
def mixed(frame, noise):
    """One asset with frames of 10x10, 10x10 and 20x20, and one with two equal frames."""
    parts = [frame(noise[:10, :10], "a", 0), frame(noise[:10, :10], "a", 1), frame(noise[:20, :20], "a", 2), frame(noise[:10, :10], "b", 0), frame(noise[:10, :10], "b", 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_mixed_sizes_are_listed_and_left_out(mixed):
    assert [(r.asset_id, r.frame_no, r.code) for r in metrics.stack_errors(mixed).collect()] == [("a", 2, "LAYOUT")]
    assert {r.asset_id for r in metrics.stack(mixed).select("asset_id").distinct().collect()} == {"b"}
    assert {r.asset_id for r in metrics.fuse_median(mixed).select("asset_id").distinct().collect()} == {"b"}
    assert {(r.asset_id, r.frame_no) for r in spectral.phase_correlate(mixed).collect()} == {("b", 0), ("b", 1)}
    single = mixed.where("asset_id = 'b' AND frame_no = 0")
    assert spectral.register_errors(single).count() == 1 and metrics.stack_errors(single).count() == 0
    assert spectral.super_resolve(single, 2).count() == 0
    with pytest.raises(OperatorError):
        spectral.super_resolve(mixed, 9)


def test_metrics_of_other_sizes_give_no_number(frame, noise):
    small, large = frame(noise[:10, :10]), frame(noise[:20, :20])
    for score in (metrics.mse, metrics.psnr, metrics.ssim, metrics.all_metrics):
        assert score(small, large).count() == 0 and score(small, small).count() == 1
    assert metrics.pair_errors(small, large).count() == 1


def test_crop_takes_whole_rectangles_only(mixed):
    kept = pointwise.crop(mixed, 5, 5, 10, 10)
    assert {(r.asset_id, r.frame_no) for r in kept.collect()} == {("a", 2)} and kept.count() == 100
    assert kept.columns == mixed.columns


def test_frames_without_motion_stay(spark, frame, noise, block):
    img = noise[:12, :9]
    motion = spark.createDataFrame([("other", 0, 1.0, 1.0)], "asset_id STRING, frame_no INT, dx DOUBLE, dy DOUBLE")
    np.testing.assert_allclose(block(resample.translate(frame(img), motion)), img, atol=1e-12)


def test_rationals_keep_null_rows(spark):
    df = spark.createDataFrame([(6, -4), (None, 3), (3, None), (5, 0), (0, 0)], "num BIGINT, den BIGINT")
    got = {(r.num, r.den): (r.norm_num, r.norm_den) for r in pointwise.rational_normalize(df).collect()}
    assert got == {(6, -4): (-3, 2), (None, 3): (None, None), (3, None): (None, None), (5, 0): (0, 1), (0, 0): (0, 1)}


def test_more_recipes_than_one_plan_holds(spark, frame, noise, monkeypatch):
    monkeypatch.setattr(chain, "PLAN_RECIPES", 8)
    px = frame(noise[:3, :3], "a0")
    for k in range(1, 17):
        px = px.unionByName(frame(noise[:3, :3], f"a{k}"))
    recipes = {f"r{k}": '{"chain": [{"effect": "exposure.gamma", "params": {"gamma": %f}}]}' % (1 + k / 10) for k in range(17)}
    assigned = spark.createDataFrame([(f"a{k}", f"r{k}") for k in range(17)], "asset_id STRING, recipe_id STRING")
    done = chain.apply_recipes(px, assigned, recipes)
    assert done.count() == 17 * 9
    first = {r.asset_id: r.r for r in done.where("y = 0 AND x = 0").collect()}
    assert len(set(first.values())) == 17


def test_values_out_of_range_are_refused(frame, noise):
    px = frame(noise[:4, :4])
    for call in (
        lambda: kernels.gaussian(30.0), lambda: stencil.median(px, 9), lambda: stencil.bilateral(px, 2.0, 0.1, 40), lambda: stencil.dehaze_dcp(px, 0.95, 0.1, 32),
        lambda: stencil.dehaze_dcp(px, 1.5), lambda: spectral.richardson_lucy(px, 1.0, 51), lambda: resample.upscale_lanczos(px, 2.0, 7), lambda: resample.upscale_mitchell(px, 0.1),
    ):
        with pytest.raises(OperatorError):
            call()


def test_undecodable_files_are_listed(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"not an image")
    assert [r.code for r in images.image_errors(spark, str(tmp_path)).collect()] == ["LAYOUT"]
    assert images.read_images(spark, str(tmp_path)).count() == 0


def test_chain_plans_grow_by_a_constant(spark, frame, noise):
    path_rows = frame(noise[:40, :30])
    scans = []
    for n in range(1, 7):
        done = chain.apply_chain(path_rows, [("text.clahe", None, {"tiles_x": 2, "tiles_y": 2})] * n)
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation [") + plan.count("LogicalRDD") + plan.count("LocalRelation"))
    assert max(scans) <= scans[0] + 1, scans


def test_three_channels_are_listed(spark):
    from framelake.operators import audio

    rows = [(a, c, n, 0.5) for a, most in (("mono", 1), ("wide", 3)) for c in range(most) for n in range(4800)]
    samples = spark.createDataFrame(rows, "asset_id STRING, channel INT, n BIGINT, v DOUBLE")
    assert [r.asset_id for r in audio.layout_errors(samples).collect()] == ["wide"]
    assert {r.asset_id for r in audio.block_energy(samples, 400, 100).collect()} == {"mono"}
    assert {r.asset_id for r in audio.loudness(samples, 400, 800, 100).collect()} == {"mono"}


def test_step_folders_can_be_cleared(spark):
    import pathlib

    from framelake.session import clear_steps, cut_lineage

    kept = cut_lineage(spark.range(5))
    folder = pathlib.Path("/" + kept.inputFiles()[0].removeprefix("file:").lstrip("/")).parent
    assert folder.exists()
    clear_steps(spark)
    assert not folder.exists()


def test_all_frames_shift_alike(spark, frame, noise, block):
    px = frame(noise[:12, :9])
    motion = px.select("asset_id", "frame_no").distinct().selectExpr("*", "1.5D AS dx", "-2.0D AS dy")
    for subpixel in (True, False):
        want = block(resample.translate(px, motion, subpixel))
        np.testing.assert_allclose(block(resample.translate_all(px, 1.5, -2.0, subpixel)), want, atol=1e-12)

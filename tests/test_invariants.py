"""Neutral parameters, constant frames, degenerate sizes, and misuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.errors import OperatorError
from framelake.operators import layout, metrics, pointwise, resample, stencil
from framelake.plans import chain
from framelake.plans.catalogue import Effect, Registry


def flat(h, w, v=0.4):
    out = np.full((h, w, 4), v)
    out[..., 3] = 1
    return out


CONSTANT = [
    lambda p: stencil.gaussian(p, 2.0), lambda p: stencil.median(p, 1), lambda p: stencil.bilateral(p), lambda p: stencil.deblock(p),
    lambda p: stencil.unsharp_mask(p, 1.0), lambda p: stencil.laplacian_dog(p), lambda p: resample.upscale_lanczos(p, 2.0),
    lambda p: resample.upscale_mitchell(p, 2.0), lambda p: resample.resize_bilinear(p, 5, 9), lambda p: stencil.motion_blur(p),
]


@pytest.mark.parametrize("op", CONSTANT)
@pytest.mark.parametrize("shape", [(12, 10), (1, 1), (4, 4)])
def test_constant_stays(frame, block, op, shape):
    np.testing.assert_allclose(block(op(frame(flat(*shape))), "rgb"), 0.4, atol=1e-9)


def test_clahe_constant_and_gradient(frame, block):
    np.testing.assert_allclose(block(stencil.clahe(frame(flat(16, 16)), 2, 2, 0.0), "rgb"), 0.4, atol=3e-3)
    ramp = np.ones((32, 32, 4))
    ramp[..., :3] = np.linspace(0.4, 0.6, 32)[None, :, None]
    got = block(stencil.clahe(frame(ramp), 1, 1, 4.0), "rgb")
    assert np.ptp(got) > np.ptp(ramp[..., :3])


def test_dehaze_gains_contrast(frame, block):
    ramp = np.ones((24, 24, 4))
    ramp[..., :3] = (np.linspace(0.5, 0.8, 24)[:, None] + np.linspace(0, 0.1, 24)[None])[..., None]
    got = block(stencil.dehaze_dcp(frame(ramp), patch_radius=2), "rgb")
    assert got.std() > ramp[..., :3].std()
    assert block(stencil.dehaze_dcp(frame(flat(1, 1)))).shape == (1, 1, 4)


def test_neutral_steps_add_nothing(frame):
    px = frame(flat(3, 3))
    for step in [("sharpen.unsharp_mask", None, {"amount": 0.0}), ("color.duotone", None, {"amount": 0.0}), ("geometric.rotate_ortho", None, {"turns": 0}),
                 ("color.curves", None, {}), ("color.lut3d", None, {}), ("temporal.motion_blur_directional", None, {"length": 0.1})]:
        assert chain.apply_chain(px, [step]) is px


def test_identity_parameters(frame, block, noise):
    img = noise[:9, :7]
    for op in (lambda p: pointwise.brightness_contrast(p), lambda p: pointwise.gamma(p), lambda p: pointwise.saturation(p), lambda p: pointwise.primary_wheels(p)):
        np.testing.assert_allclose(block(op(frame(img))), img, atol=1e-12)


def test_four_turns(frame, block, noise):
    img = noise[:5, :8]
    px = frame(img)
    np.testing.assert_array_equal(block(pointwise.rotate_ortho(px, 1)), np.rot90(img, -1))
    np.testing.assert_array_equal(block(pointwise.rotate_ortho(px, 3)), np.rot90(img, 1))
    np.testing.assert_array_equal(block(pointwise.rotate_ortho(px, 2)), np.rot90(img, 2))


def test_lift_encode_round_trip(frame, block):
    codes = np.arange(256, dtype=float).reshape(16, 16, 1).repeat(4, axis=2)
    back = block(pointwise.encode_u8(pointwise.lift_linear(frame(codes))))
    np.testing.assert_array_equal(back, codes)
    kept = block(pointwise.lift_linear(frame(codes), space="rec709"))
    np.testing.assert_allclose(kept, codes / 255)


def test_scanlines_round_trip(frame, block, noise):
    img = noise[:6, :4]
    for axis in ("row", "column"):
        np.testing.assert_array_equal(block(layout.from_scanlines(layout.to_scanlines(frame(img), axis))), img)


def test_stack_median_is_upper_and_fusion_averages(spark, frame, block):
    px = frame(flat(2, 2, 0.1), no=0)
    for i, v in enumerate((0.2, 0.6, 0.9), 1):
        px = px.unionByName(frame(flat(2, 2, v), no=i))
    assert block(metrics.stack(px, "median"), "r").max() == 0.6
    np.testing.assert_allclose(block(metrics.fuse_median(px), "r"), 0.4)


def test_pair_errors(frame):
    assert metrics.pair_errors(frame(flat(3, 3)), frame(flat(3, 4))).first()["code"] == "LAYOUT"


def test_polygon(frame, block):
    px = frame(flat(6, 6))
    np.testing.assert_allclose(block(pointwise.alpha_polygon(px, "0,0; 4,0"), "a"), 1.0)
    mask = block(pointwise.alpha_polygon(px, "1,1; 5,1; 5,5; 1,5"), "a")[..., 0]
    assert mask[1:5, 1:5].min() == 1 and mask[0].max() == 0


@pytest.mark.parametrize("bad", ["0.5:0.1,0.2:0.9", "a:b", "1:2:3"])
def test_curve_text_rejected(bad):
    with pytest.raises(OperatorError):
        pointwise.parse_curve(bad)


def test_registry_checks():
    reg = Registry()
    assert len(reg.ids()) == 29
    with pytest.raises(OperatorError):
        reg.register(Effect("text.clahe", lambda px: px))
    with pytest.raises(OperatorError):
        reg.get("no.such")
    with pytest.raises(OperatorError):
        reg.bind("exposure.gamma", {"gama": 1.0})
    with pytest.raises(OperatorError):
        reg.bind("exposure.gamma", {"gamma": 99.0})
    assert reg.bind("exposure.gamma", {"gamma": 99}) == {"gamma": 99.0}  # promoted integers are not range-checked


def test_lone_frames_are_listed_not_scored(frame):
    same, left_only, right_only = flat(3, 3), flat(2, 2), flat(2, 5)
    a = frame(same, "a", 0).unionByName(frame(left_only, "a", 1)).unionByName(frame(flat(2, 2), "a", 3))
    b = frame(same, "a", 0).unionByName(frame(right_only, "a", 2)).unionByName(frame(flat(2, 3), "a", 3))
    assert {(r["frame_no"], r["reason"]) for r in metrics.pair_errors(a, b).collect()} == {
        (1, "only the first side has the frame"), (2, "only the second side has the frame"), (3, "frame dims differ: 2x2 vs 3x2")}
    assert {(r["frame_no"], r["mse"]) for r in metrics.mse(a, b).collect()} == {(0, 0.0)}
    plan = metrics.mse(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # sizes come with the errors


def test_user_aggregate_sends_one_row_per_batch_and_key(spark):
    from framelake.errors import OperatorError
    from framelake.operators import udfs

    rows = spark.range(0, 50_000, 1, 4).selectExpr("CAST(id % 3 AS INT) AS k", "CAST(id AS DOUBLE) AS v")
    sizes = spark.sparkContext.accumulator(0)

    def partial(batch):
        done = batch.groupby("k", as_index=False).agg(total=("v", "sum"), least=("v", "min"), most=("v", "max"))
        sizes.add(len(done))
        return done

    state = {"total": ("DOUBLE", "sum"), "least": ("DOUBLE", "min"), "most": ("DOUBLE", "max")}
    done = udfs.user_aggregate(rows, ["k"], partial, state, {"total": F.col("total"), "spread": F.col("most") - F.col("least")})
    want = {k: (float(sum(range(k, 50_000, 3))), float(range(k, 50_000, 3)[-1] - k)) for k in range(3)}
    assert {r["k"]: (r["total"], r["spread"]) for r in done.collect()} == want
    assert sizes.value <= 3 * 8
    with pytest.raises(OperatorError):
        udfs.user_aggregate(rows, ["k"], partial, {"total": ("DOUBLE", "mean")}, {})

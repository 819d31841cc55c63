"""Frames larger than a tile against plain numpy: tile borders must not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import kernels
from framelake.operators import metrics, resample, spectral, stencil

EDGE = "edge"


def correlate(img, taps):
    half = len(taps) // 2
    pad = np.pad(img, ((half, half), (half, half), (0, 0)), EDGE)
    rows = sum(w * pad[:, i : i + img.shape[1]] for i, w in enumerate(taps))
    return sum(w * rows[i : i + img.shape[0]] for i, w in enumerate(taps))


@pytest.mark.parametrize("sigma", [1.0, 6.0])
def test_gaussian(frame, block, noise, sigma):
    got = block(stencil.gaussian(frame(noise), sigma))
    np.testing.assert_allclose(got, correlate(noise, kernels.gaussian(sigma)), atol=1e-12)


def test_median_and_pool(frame, block, noise):
    pad = np.pad(noise[..., :3], ((2, 2), (2, 2), (0, 0)), EDGE)
    want = np.median(np.lib.stride_tricks.sliding_window_view(pad, (5, 5), axis=(0, 1)), axis=(-2, -1))
    np.testing.assert_array_equal(block(stencil.median(frame(noise), 2), "rgb"), want)
    low = noise[..., 0]
    pad = np.pad(low, 4, constant_values=np.inf)
    want = np.lib.stride_tricks.sliding_window_view(pad, (9, 9)).min(axis=(-2, -1))
    np.testing.assert_array_equal(block(stencil.min_pool(frame(noise).select("asset_id", "frame_no", "y", "x", "r"), "r", 4), "r")[..., 0], want)


def test_deblock_band(frame, block, noise):
    got = block(stencil.deblock(frame(noise), 8, 0.6))
    taps, img = np.array(kernels.gaussian(0.6, 2.0, 32)), noise
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        wide = np.pad(img, pad, EDGE)
        soft = sum(w * np.take(wide, range(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(taps))
        near = np.zeros(img.shape[axis], bool)
        for k in range(8, img.shape[axis], 8):
            near[k - 2 : min(k + 2, img.shape[axis])] = True
        img = np.where(near.reshape([-1 if a == axis else 1 for a in range(3)]), soft, img)
    np.testing.assert_allclose(got, img, atol=1e-12)


def gather(img, axis, s, taps, weight, normalize):
    n = img.shape[axis]
    base = np.floor(s)
    w = np.array([weight(base + k - s) for k in taps])
    if normalize:
        w = w / w.sum(axis=0)
    shape = [1, 1, 1]
    shape[axis] = -1
    return sum(np.take(img, np.clip(base + k, 0, n - 1).astype(int), axis=axis) * v.reshape(shape) for k, v in zip(taps, w))


@pytest.mark.parametrize("scale", [1.7, 0.4])
def test_lanczos(frame, block, noise, scale):
    want = noise
    for axis in (0, 1):
        n = noise.shape[axis]
        out = int(np.floor(n * scale + 0.5))
        s = (np.arange(out) + 0.5) * n / out - 0.5
        want = gather(want, axis, s, range(-2, 4), kernels.lanczos(3), True)
    np.testing.assert_allclose(block(resample.upscale_lanczos(frame(noise), scale, 3)), np.clip(want, 0, 1), atol=1e-12)


@pytest.mark.parametrize("dx,dy", [(270.5, -3.25), (-300.0, 400.75), (0.0, 0.0)])
def test_far_translation(spark, frame, block, noise, dx, dy):
    motion = spark.createDataFrame([("a", 0, dx, dy)], "asset_id STRING, frame_no INT, dx DOUBLE, dy DOUBLE")
    want = gather(gather(noise, 1, np.arange(280) - dx, range(0, 2), kernels.tent, False), 0, np.arange(300) - dy, range(0, 2), kernels.tent, False)
    np.testing.assert_allclose(block(resample.translate(frame(noise), motion)), want, atol=1e-12)


def test_ssim_and_identity(frame, noise):
    row = metrics.all_metrics(frame(noise), frame(noise)).first()
    assert row["mse"] == 0 and row["psnr"] == float("inf") and abs(row["ssim"] - 1) < 1e-12


def torus_blur(img, sigma):
    n = [1 << (d - 1).bit_length() for d in img.shape]
    freq = []
    for size in n:
        at = np.arange(size)
        taps = np.exp(-(np.where(at <= size // 2, at, at - size) ** 2) / (2 * sigma**2))
        freq.append(np.fft.fft(taps / taps.sum()))
    wide = np.zeros(n)
    wide[: img.shape[0], : img.shape[1]] = img
    return np.fft.ifft2(np.fft.fft2(wide) * freq[0][:, None] * freq[1][None]).real[: img.shape[0], : img.shape[1]]


@pytest.mark.parametrize("sigma,steps,shape", [(1.0, 4, (300, 256)), (4.0, 6, (270, 200)), (8.0, 2, (40, 33))])
def test_richardson_lucy(frame, block, noise, sigma, steps, shape):
    """The second case is written once in between; 256 columns wrap around."""
    img = noise[: shape[0], : min(shape[1], 280)]
    got = block(spectral.richardson_lucy(frame(img), sigma, steps, 0.2), "rgb")
    for k in range(3):
        seen = est = img[..., k]
        for _ in range(steps):
            est = est * (1 + (torus_blur(seen / np.maximum(torus_blur(est, sigma), 1e-6), sigma) - 1) * 0.8)
        np.testing.assert_allclose(got[..., k], np.clip(est, 0, 1), atol=1e-9)


def test_registration_recovers_shift(frame, noise):
    img = correlate(np.random.default_rng(1).random((128, 128, 4)), kernels.gaussian(1.0))
    y, x = np.mgrid[0:128, 0:128]
    moved = img[np.clip(y + 3, 0, 127), np.clip(x - 5, 0, 127)]
    both = frame(img, no=0).unionByName(frame(moved, no=1))
    rows = {r["frame_no"]: r for r in spectral.phase_correlate(both).collect()}
    assert rows[0]["dx"] == 0 and rows[0]["peak"] == 1
    assert abs(rows[1]["dx"] - 5) < 0.5 and abs(rows[1]["dy"] + 3) < 0.5


def test_wiener_recovers_detail(frame, block):
    img = np.zeros((64, 64, 4))
    img[..., 3] = 1
    img[28:36, 28:36, :3] = 1
    soft = correlate(img, kernels.gaussian(1.0))
    got = block(spectral.wiener(frame(soft), 1.0, 0.001))
    assert np.abs(got[..., :3] - img[..., :3]).mean() < np.abs(soft[..., :3] - img[..., :3]).mean()


def test_richardson_lucy_keeps_other_columns(frame, noise):
    px = frame(noise[:20, :17]).withColumn("note", F.col("x") * 2)
    done = spectral.richardson_lucy(px, 1.0, 2)
    assert done.columns == px.columns and done.where("note != x * 2").count() == 0 and done.count() == 340
    assert spectral.richardson_lucy(px.limit(0), 1.0, 2).count() == 0


def test_registration_of_long_recordings(spark, frame):
    """Frames of three runs and two assets against a plain two-dimensional transform; every frame once."""
    rng = np.random.default_rng(5)
    images = {(a, k): rng.random((21, 18, 4)) for a, k in [("a", 3), ("a", 4), ("a", 300), ("a", 700), ("b", 260), ("b", 255)]}
    px = None
    for (a, k), img in images.items():
        one = frame(img, a, k)
        px = one if px is None else px.unionByName(one)
    rows = spectral.phase_correlate(px).collect()
    assert sorted((r.asset_id, r.frame_no) for r in rows) == sorted(images)

    def spectrum(img):
        y, x = np.hanning(21)[:, None], np.hanning(18)[None]
        return np.fft.fft2((img[..., :3] @ [0.2126, 0.7152, 0.0722]) * y * x, (32, 32))

    for r in rows:
        power = spectrum(images[r.asset_id, {"a": 3, "b": 255}[r.asset_id]]) * np.conj(spectrum(images[r.asset_id, r.frame_no]))
        surface = np.fft.ifft2(power / (np.abs(power) + 1e-12)).real
        if r.frame_no in (3, 255):
            assert (r.dx, r.dy, r.peak) == (0, 0, 1)
            continue
        y, x = np.unravel_index(surface.argmax(), surface.shape)
        found = []
        for low, high, at in ((surface[y, x - 1], surface[y, (x + 1) % 32], x), (surface[y - 1, x], surface[(y + 1) % 32, x], y)):
            place = at + 0.5 * (low - high) / (low - 2 * surface[y, x] + high)
            found.append(-(place - 32 if place > 16 else place))
        np.testing.assert_allclose([r.dx, r.dy, r.peak], [*found, surface[y, x]], atol=1e-7)


@pytest.mark.parametrize("radius", [1, 31])
def test_pool_over_tiles(frame, block, noise, radius):
    """Wider than a tile, with a hole in the values; nulls give way to numbers."""
    px = frame(noise).select("asset_id", "frame_no", "y", "x", F.when((F.col("y") != 7) | (F.col("x") != 9), F.col("r")).alias("r"))
    values = noise[..., 0].copy()
    values[7, 9] = np.inf
    pad = np.pad(values, radius, mode="edge")
    want = pad
    for axis in (0, 1):
        want = np.lib.stride_tricks.sliding_window_view(want, 2 * radius + 1, axis=axis).min(axis=-1)
    np.testing.assert_array_equal(block(stencil.min_pool(px, "r", radius), "r")[..., 0], want)

import numpy as np
import pandas as pd
import pytest

from framelake.errors import OperatorError
from framelake.operators import audio

RATE = 48000


@pytest.fixture(scope="module")
def sound(spark):
    def make(v, asset="s", channel=0):
        return spark.createDataFrame(pd.DataFrame({"asset_id": asset, "channel": channel, "n": np.arange(len(v)), "v": np.asarray(v, float)}), "asset_id STRING, channel INT, n BIGINT, v DOUBLE")

    return make


def serial(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        y = np.zeros(len(x))
        x1 = x2 = y1 = y2 = 0.0
        for i, x0 in enumerate(x):
            y[i] = b0 * x0 + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, x0, y1, y[i]
        x = y
    return x


@pytest.mark.parametrize("chunk,per_group", [(1024, 1024), (64, 4), (50, 3)])
def test_k_weight_across_chunks(sound, chunk, per_group):
    v = np.random.default_rng(2).standard_normal(1501)
    got = audio.k_weight(sound(v), RATE, chunk, per_group).orderBy("n").toPandas()
    assert (got["n"].to_numpy() == np.arange(1501)).all()
    np.testing.assert_allclose(got["v"], serial(v, audio.k_weighting(RATE)), atol=1e-9)


def test_other_rates_keep_the_response():
    """Off 48 kHz the shelf passes DC unchanged and lifts the top by 4 dB; the high-pass matches closely."""
    for rate in (44100, 48001, 96000):
        (b0, b1, b2, a1, a2), high = audio.k_weighting(rate)
        assert abs((b0 + b1 + b2) / (1 + a1 + a2) - 1) < 1e-9
        assert abs(20 * np.log10((b0 - b1 + b2) / (1 - a1 + a2)) - 4.0) < 0.01
        if rate == 48001:
            np.testing.assert_allclose(high[3:], audio.HIGHPASS_48K[3:], rtol=1e-4)


def test_sine_loudness_and_normalize(sound):
    v = 0.25 * np.sin(2 * np.pi * 997 * np.arange(RATE) / RATE)
    measure = lambda s: audio.loudness(audio.k_weight(s), 19200, 48000, 4800).first()["integrated_lufs"]
    first = measure(sound(v))
    assert abs(first - (-0.691 + 10 * np.log10(0.25**2 / 2) + 0.691)) < 0.3
    measured = audio.integrated(audio.block_energy(audio.k_weight(sound(v)), 19200, 4800))
    assert abs(measure(audio.normalize_lufs(sound(v), measured, -23.0)) + 23.0) < 0.01


def test_silence(sound):
    row = audio.loudness(audio.k_weight(sound(np.zeros(2 * RATE // 10))), 1920, 4800, 480).first()
    assert row["integrated_lufs"] == float("-inf")
    assert audio.true_peak(sound(np.zeros(100))).first()["true_peak_dbfs"] == float("-inf")


def test_true_peak_crosses_chunks(sound, monkeypatch):
    v = np.sin(2 * np.pi * 997 * np.arange(4000) / RATE)
    whole = audio.true_peak(sound(v)).first()[1]
    monkeypatch.setattr(audio, "WINDOW_BITS", 6)
    monkeypatch.setattr(audio.chunk_halo, "__defaults__", (6,))
    assert abs(audio.true_peak(sound(v)).first()[1] - whole) < 1e-12
    assert abs(whole) < 0.5


def test_noise_reduction_quiets_noise(sound):
    rng = np.random.default_rng(5)
    v = 0.05 * rng.standard_normal(16000)
    out = audio.spectral_subtract(sound(v), 16000, 1024).orderBy("n").toPandas()["v"].to_numpy()
    assert len(out) == 16000 and out[2000:-2000].std() < 0.5 * v.std()


def test_frame_size_must_be_a_power_of_two(sound):
    with pytest.raises(OperatorError):
        audio.stft(sound(np.zeros(10)), 100)


def test_short_signal_is_one_frame(sound):
    assert audio.stft(sound(np.ones(10)), 64).select("frame").distinct().count() == 1


def test_recordings_at_their_own_rates(sound):
    rng = np.random.default_rng(9)
    signals = {"a": (44100, rng.standard_normal(30_011)), "b": (48000, rng.standard_normal(29_003)), "c": (11025, rng.standard_normal(40_000))}
    table = None
    for name, (rate, v) in signals.items():
        one = sound(v, name).selectExpr("*", f"{rate} AS sample_rate")
        table = one if table is None else table.unionByName(one)
    weighted = audio.k_weight(table, chunk=128, per_group=5)
    got = weighted.toPandas()
    for name, (rate, v) in signals.items():
        mine = got[got["asset_id"] == name].sort_values("n")
        np.testing.assert_allclose(mine["v"], serial(v, audio.k_weighting(rate)), atol=1e-9)
    loud = {r["asset_id"]: r for r in audio.loudness_by_rate(weighted).collect()}
    for name, (rate, v) in signals.items():
        y = serial(v, audio.k_weighting(rate))
        half_up = lambda x: int(np.floor(x + 0.5))
        step, block = half_up(0.1 * rate), half_up(0.4 * rate)
        energy = np.array([np.mean(y[k : k + block] ** 2) for k in range(0, len(y) - block + 1, step)])
        assert abs(loud[name]["max_momentary_lufs"] - (-0.691 + 10 * np.log10(energy.max()))) < 1e-6
        assert loud[name]["max_short_term_lufs"] == float("-inf") if rate > 11025 else loud[name]["max_short_term_lufs"] > -10


def test_filter_runs_once(sound):
    plan = audio.k_weight(sound(np.zeros(5000)), chunk=64, per_group=4)._jdf.queryExecution().executedPlan().toString()
    assert "from_silence" not in plan and plan.count("add_ringing") >= 1  # the filtered chunks are read back


def test_gaps_keep_their_length(sound):
    """Missing chunks ring on as silence does."""
    v = np.random.default_rng(4).standard_normal(640)
    v[192:512] = 0
    whole = serial(v, audio.k_weighting(RATE))
    got = audio.k_weight(sound(v).where("n < 192 OR n >= 512"), RATE, 64, 3).toPandas().sort_values("n")
    np.testing.assert_allclose(got["v"], np.delete(whole, np.s_[192:512]), atol=1e-9)


def test_rates_are_joined_and_missing_ones_listed(spark, sound):
    both = sound(np.ones(10), "a").unionByName(sound(np.ones(10), "b"))
    rates = spark.createDataFrame([("a", 44100), ("b", 0)], "asset_id STRING, sample_rate INT")
    assert {(r["asset_id"], r["sample_rate"]) for r in audio.with_rates(both, rates).collect()} == {("a", 44100)}
    assert [r["asset_id"] for r in audio.rate_errors(both, rates).collect()] == ["b"]


def test_noise_frames_follow_each_rate(sound):
    rng = np.random.default_rng(6)
    v = 0.05 * rng.standard_normal(16000)
    split = audio.spectral_subtract(sound(v).selectExpr("*", "16000 AS sample_rate"), None, 1024).orderBy("n").toPandas()["v"]
    whole = audio.spectral_subtract(sound(v), 16000, 1024).orderBy("n").toPandas()["v"]
    np.testing.assert_allclose(split, whole)

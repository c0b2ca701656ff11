from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.functions import dsp
from speechlake.operators import signals

KEYS = ["utt", "ch"]


def frame(spark, *series):
    rows = [(u, 0, t, float(v)) for u, x in enumerate(series) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "utt int, ch int, t int, value double")


def back(df, utt=0):
    return np.array([r.value for r in df.where(F.col("utt") == utt).orderBy("t").collect()])


def recursion(b, a, x, state):
    """Direct form filter with an explicit state."""
    b, a = np.append(b, np.zeros(len(a) - len(b))), np.asarray(a)
    z, out = state.copy(), []
    for v in x:
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


def steady(b, a):
    """State in which a constant input gives a constant output."""
    n = len(a) - 1
    gain = b.sum() / a.sum()
    z = np.zeros(n)
    for k in range(n - 1, -1, -1):
        z[k] = b[k + 1] - a[k + 1] * gain + (z[k + 1] if k + 1 < n else 0.0)
    return z


def forward_backward(b, a, x):
    pad = 3 * max(len(a), len(b))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    once = recursion(b, a, ext, steady(b, a) * ext[0])[::-1]
    twice = recursion(b, a, once, steady(b, a) * once[0])[::-1]
    return twice[pad:-pad]


def test_conditioning_equals_the_recursion(spark):
    rnd = np.random.default_rng(1)
    x = np.cumsum(rnd.normal(size=700)) + 5 * np.sin(2 * np.pi * 60 * np.arange(700) / 250)
    want = x
    for design in (dsp.notch(60, 30, 250), dsp.notch(120, 30, 250), dsp.high_pass3(2, 250)):
        want = forward_backward(*design, want)
    assert np.abs(back(signals.condition(frame(spark, x), KEYS)) - want).max() < 1e-8


def test_conditioning_of_a_long_signal_in_chunks(spark):
    x = np.random.default_rng(2).normal(size=30000).cumsum()
    df = frame(spark, x)
    whole, cut = back(signals.condition(df, KEYS)), back(signals.condition(df, KEYS, size=4000))
    assert len(whole) == len(cut) == 30000 and np.abs(whole - cut).max() < 1e-7


def test_conditioning_needs_more_samples_than_its_padding(spark):
    with pytest.raises(Exception, match="not longer than the padding"):
        signals.condition(frame(spark, np.ones(12)), KEYS).collect()


def test_filter_designs():
    z = np.exp(2j * np.pi * np.array([0.0, 2.0, 60.0, 59.0, 61.0]) / 250)
    gain = lambda b, a: np.abs(np.polyval(b[::-1], 1 / z) / np.polyval(a[::-1], 1 / z))
    high, mains = gain(*dsp.high_pass3(2, 250)), gain(*dsp.notch(60, 30, 250))
    assert high[0] < 1e-9 and abs(high[1] - 2**-0.5) < 1e-9
    assert mains[2] < 1e-9 and np.allclose(mains[3:], 2**-0.5, atol=0.02)


@pytest.mark.parametrize("new,old", [(400, 250), (250, 400), (344.52, 250), (250, 250)])
def test_resampling(spark, new, old):
    x = np.random.default_rng(3).normal(size=97)
    up, down = dsp.rational_ratio(new, old)
    made = back(signals.resample(frame(spark, x), KEYS, new, old))
    assert len(made) == round(97 * new / old)
    if new == old:
        assert np.array_equal(made, x)
        return
    taps = dsp.polyphase_taps(up, down)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, taps)[len(taps) // 2 :][::down][: -(-len(x) * up // down)]
    n = min(len(full), len(made))
    assert np.abs(full[:n] - made[:n]).max() < 1e-9 and np.allclose(made[n:], full[-1])


def test_resampling_keeps_a_sine(spark):
    t = np.arange(250) / 250
    made = back(signals.resample(frame(spark, np.sin(2 * np.pi * 10 * t)), KEYS, 400, 250))
    want = np.sin(2 * np.pi * 10 * np.arange(400) / 400)
    assert np.abs(made - want)[40:-40].max() < 2e-3
    with pytest.raises(ValueError):
        signals.resample(frame(spark, t), KEYS, 0, 250)


@pytest.mark.parametrize("block", [2, 256])
def test_log_mel(spark, block):
    x = np.random.default_rng(4).normal(size=1000) / 5
    p = {"n_fft": 64, "n_mels": 8, "sr": 1600.0, "hop": 16, "win": 64, "fmin": 0.0, "fmax": 800.0}
    rows = signals.log_mel(frame(spark, x), KEYS, **p, block=block).orderBy("utt", "frame").collect()
    pad = (64 - 16) // 2
    mel = dsp.mel_matrix(1600.0, 64, 8, 0.0, 800.0)
    padded = np.pad(x, pad, mode="reflect")
    want = []
    for at in range(0, len(padded) - 64 + 1, 16):
        spectrum = np.fft.rfft(padded[at : at + 64] * dsp.hann(64))
        want.append(np.log(np.maximum(mel @ np.sqrt(np.abs(spectrum) ** 2 + 1e-9), 1e-5)))
    with pytest.raises(Exception, match="padding"):
        signals.log_mel(frame(spark, x, x[:20]), KEYS, **p, block=block).collect()
    assert [r.frame for r in rows] == list(range(len(want)))
    assert np.abs(np.array([r.mel for r in rows]) - np.array(want)).max() < 1e-9


def test_mel_matrix_has_unit_area_and_monotone_centres():
    mel = dsp.mel_matrix(16000, 640, 80, 0, 8000)
    assert mel.shape == (80, 321) and (np.diff(mel.argmax(axis=1)) >= 0).all()
    assert abs(mel[60].sum() * 25 - 1) < 0.05


def test_levels(spark):
    quiet, zero, peak = np.full(50, 0.01), np.zeros(20), np.eye(1, 400, 200).ravel()
    df = frame(spark, quiet, zero, peak)
    made = signals.normalize_volume(df, KEYS, 16, 4)
    assert np.allclose(back(made, 0), 0.01 * 0.2 / 0.02) and np.allclose(back(made, 1), 0)
    assert back(made, 2).max() <= 1.0
    scaled = signals.normalize_peak(df, KEYS)
    assert np.allclose(back(scaled, 0), 0.95) and np.allclose(back(scaled, 1), 0)
    pcm = scaled.select(signals.to_pcm(F.lit(1.0)).alias("a"), signals.to_pcm(F.lit(-0.5)).alias("b")).first()
    assert (pcm.a, pcm.b) == (32767, -16384)


def test_channel_order(spark):
    df = spark.createDataFrame([(1, c, 0, float(c)) for c in range(4)], "utt int, ch int, t int, value double")
    made = {r.ch: r.value for r in signals.pick_channels(df, [3, 1]).collect()}
    assert made == {0: 3.0, 1: 1.0}


def test_resampling_and_loading_in_chunks(spark):
    x = np.random.default_rng(5).normal(size=12001).cumsum()
    df = frame(spark, x)
    for new in (400.0, 100.0, 344.52):
        whole, cut = back(signals.resample(df, KEYS, new, 250.0)), back(signals.resample(df, KEYS, new, 250.0, size=1000))
        assert len(whole) == len(cut) == round(12001 * (new / 250)) and np.abs(whole - cut).max() < 1e-9
    steps = signals.soft_clip(F.col("value"))
    apart = back(signals.resample(signals.condition(df, KEYS), KEYS, 400.0, 250.0).withColumn("value", steps))
    assert np.abs(back(signals.load_signal(df, KEYS, 100.0)) - apart).max() < 1e-9
    assert np.abs(back(signals.load_signal(df, KEYS, 100.0, size=3000)) - apart).max() < 1e-7

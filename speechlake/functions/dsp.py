"""Closed-form filter and filter-bank designs, and the kernels that apply them.

Everything here works on one bounded block of samples; Spark decides the blocks.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np

TINY = 1e-18


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _hz_to_mel(hz):
    hz = np.asarray(hz, dtype=float)
    linear = hz * 3 / 200
    return np.where(hz < 1000, linear, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def _mel_to_hz(mel):
    mel = np.asarray(mel, dtype=float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=16)
def mel_matrix(sr: float, n_fft: int, n_mels: int, fmin: float, fmax: float) -> np.ndarray:
    """Triangles on the Slaney mel scale with unit area, shape (mels, bins)."""
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    edges = _mel_to_hz(np.linspace(_hz_to_mel(fmin), _hz_to_mel(fmax), n_mels + 2))
    low, mid, high = (edges[i : i + n_mels, None] for i in range(3))
    rise, fall = (bins - low) / (mid - low), (high - bins) / (high - mid)
    return np.maximum(0, np.minimum(rise, fall)) * 2 / (high - low)


def log_mel_frames(x: np.ndarray, n_fft: int, hop: int, win: int, mel: np.ndarray) -> np.ndarray:
    """Log-mel rows of all full frames of a padded block."""
    window = np.zeros(n_fft)
    left = (n_fft - win) // 2
    window[left : left + win] = hann(win)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    spectrum = np.fft.rfft(frames * window, axis=1)
    magnitude = np.sqrt(spectrum.real**2 + spectrum.imag**2 + 1e-9)
    return np.log(np.maximum(magnitude @ mel.T, 1e-5))


def notch(freq: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    w0 = 2 * np.pi * freq / fs
    gain = 1 / (1 + np.tan(w0 / (2 * q)))
    c = -2 * np.cos(w0)
    return gain * np.array([1, c, 1]), np.array([1, gain * c, 2 * gain - 1])


def high_pass3(cut: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth high-pass of order 3: a real pole times a pole pair."""
    k = np.tan(np.pi * cut / fs)
    n = 1 / (1 + k + k * k)
    b = np.convolve(np.array([1, -1]) / (1 + k), n * np.array([1, -2, 1]))
    a = np.convolve([1, (k - 1) / (k + 1)], [1, 2 * (k * k - 1) * n, (1 - k + k * k) * n])
    return b, a


def decay_length(a: np.ndarray) -> int:
    """Samples after which a state has faded below double precision."""
    radius = np.abs(np.roots(a)).max()
    return int(np.ceil(np.log(TINY) / np.log(radius))) + len(a)


def impulse_response(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    n = decay_length(a)
    h = np.zeros(n)
    h[: len(b)] = b
    for i in range(1, n):
        for k in range(1, min(i, len(a) - 1) + 1):
            h[i] -= a[k] * h[i - k]
    return h


def _causal(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Filter a block that was at rest at its first value for all earlier time."""
    held = np.concatenate([np.full(len(h), x[0]), x])
    size = 1 << (len(held) + len(h) - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(held, size) * np.fft.rfft(h, size), size)
    return out[len(h) : len(held)]


def zero_phase(x: np.ndarray, h: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward filtering with an odd extension at both ends."""
    if len(x) <= pad:
        raise ValueError(f"signal of {len(x)} samples is not longer than the padding {pad}")
    head = 2 * x[0] - x[pad:0:-1]
    tail = 2 * x[-1] - x[-2 : -pad - 2 : -1]
    extended = np.concatenate([head, x, tail])
    once = _causal(extended, h)
    twice = _causal(once[::-1], h)[::-1]
    return twice[pad : len(twice) - pad]


@lru_cache(maxsize=8)
def conditioning_chain(fs: float, mains: float, harmonics: int, q: float, cut: float):
    """(impulse response, end padding) of every notch and of the drift filter."""
    designs = [notch(mains * k, q, fs) for k in range(1, harmonics + 1)] if mains else []
    if cut:
        designs.append(high_pass3(cut, fs))
    return tuple((impulse_response(b, a), 3 * max(len(a), len(b))) for b, a in designs)


def rational_ratio(new: float, old: float) -> tuple[int, int]:
    if new <= 0 or old <= 0:
        raise ValueError(f"rates must be positive: {old} to {new}")
    ratio = Fraction(new / old).limit_denominator(1000)
    return ratio.numerator, ratio.denominator


def polyphase_taps(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed low-pass for rational resampling, centre at the middle tap."""
    widest = max(up, down)
    half = 10 * widest
    m = np.arange(-half, half + 1)
    taps = np.sinc(m / widest) * np.i0(5 * np.sqrt(1 - (m / half) ** 2)) / np.i0(5.0)
    return taps / taps.sum() * up


def chain_halo(design: tuple) -> int:
    """Samples a block needs on each side so that its own samples come out right."""
    return sum(len(h) + pad for h, pad in conditioning_chain(*design))


def run_chain(x: np.ndarray, design: tuple) -> np.ndarray:
    for h, pad in conditioning_chain(*design):
        x = zero_phase(x, h, pad)
    return x


def polyphase_halo(up: int, down: int) -> int:
    return 10 * max(up, down) // up + 2


@lru_cache(maxsize=8)
def _taps(up: int, down: int) -> np.ndarray:
    return polyphase_taps(up, down)


def polyphase_outputs(
    x: np.ndarray, t0: int, start: int, count: int, n: int, up: int, down: int, target: int
) -> tuple[int, np.ndarray]:
    """Outputs that belong to samples start..start+count-1 of a sequence of n samples.

    ``x`` begins at sample ``t0`` and includes a halo. The last block is cut or
    extended with its last value to the target length.
    """
    taps = _taps(up, down)
    half = len(taps) // 2
    natural = -(-n * up // down)
    first, end = -(-start * up // down), -(-(start + count) * up // down)
    last_block = start + count == n
    begin = min(first, natural - 1) if last_block else first
    q = np.arange(begin, end)
    reach = half // up + 1
    k = (q * down // up)[:, None] + np.arange(-reach, reach + 1)[None, :]
    at = q[:, None] * down - k * up + half
    inside = (at >= 0) & (at < len(taps)) & (k >= t0) & (k < t0 + len(x))
    weights = np.where(inside, taps[np.clip(at, 0, len(taps) - 1)], 0.0)
    y = (weights * x[np.clip(k - t0, 0, len(x) - 1)]).sum(axis=1)
    if last_block and target > natural:
        y = np.concatenate([y, np.full(target - natural, y[-1])])
    return first, y[first - begin : max(target - begin, first - begin)]

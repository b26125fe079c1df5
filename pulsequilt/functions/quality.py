"""Numpy scores of one lead's quality; they run inside Arrow batches."""

from __future__ import annotations

import numpy as np

from pulsequilt.functions import dsp
from pulsequilt.functions.series import spread

#: Bands in Hz, tolerance in s, flat range in mV, share of full scale.
BASELINE_HZ, DIAGNOSTIC_HZ, MUSCLE_HZ, TOTAL_HZ = (0.05, 0.5), (0.05, 40.0), (40.0, 100.0), (0.05, 150.0)
PSQI_HZ, PSQI_OF_HZ, MATCH_S, FLAT_MV, FULL_SCALE = (5.0, 15.0), (5.0, 40.0), 0.100, 0.05, 0.95


def density(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density by windows of two seconds (256 samples at least) that overlap by half."""
    n = min(x.size, max(256, round(fs * 2)))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [x[a : a + n] for a in range(0, x.size - n + 1, n - n // 2)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in parts], axis=0) / (fs * (w * w).sum())
    p[1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def band(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    """The area under p between two frequencies, ends included."""
    inside = (f >= low) & (f <= high)
    y, x = p[inside], f[inside]
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def flat_share(x: np.ndarray, fs: float, least: float = FLAT_MV) -> float:
    """The share of samples around which a second's range is below ``least``; the window is cut at the ends."""
    n = max(1, round(fs))
    wide = np.concatenate([np.repeat(x[:1], n // 2), x, np.repeat(x[-1:], n - 1 - n // 2)])
    v = np.lib.stride_tricks.sliding_window_view(wide, n)
    return float((v.max(axis=1) - v.min(axis=1) < least).mean())


def simple_peaks(x: np.ndarray, fs: float, energy: bool) -> np.ndarray:
    """Beats by the energy of the slope, or by amplitude, in a band of its own each."""
    low, high = (5.0, min(25.0, fs / 2 - 1)) if energy else (8.0, min(18.0, fs / 2 - 1))
    if x.size < max(8, int(0.5 * fs)) or high <= low:
        return np.zeros(0, int)
    y = dsp.bandpass(x, fs, low, high, 2)
    raw, n = (np.gradient(y) ** 2, max(1, round(0.1 * fs))) if energy else (np.abs(y - np.median(y)), max(1, round(0.06 * fs)))
    d = np.convolve(raw, np.ones(n) / n, "same")
    limit = max(float(np.median(d) + (3.5 if energy else 3.0) * spread(d)), 0.45 * float(np.percentile(d, 90)), 1e-10)
    return dsp.peaks(d, limit, max(1, round(0.2 * fs)))


def agreement(a: np.ndarray, b: np.ndarray, reach: int) -> float:
    """Matches of a in order with the nearest free of b within reach (the earlier of equal ones), as a share of the greater number; none of neither is 0."""
    free = b.tolist()
    matched = 0
    for x in a.tolist():
        near = [(abs(y - x), k) for k, y in enumerate(free) if abs(y - x) <= reach]
        if near:
            free.pop(min(near)[1])
            matched += 1
    return matched / max(a.size, b.size, 1)


def scores(x: np.ndarray, fs: float, mains: float = 50.0, full_scale_mv: float | None = None) -> dict:
    """All scores of one lead: shares of power, clipping, spread, flat share, saturation, pSQI, kSQI and bSQI."""
    f, p = density(x, fs)
    top = fs / 2 - 1
    share = lambda of, to: band(f, p, of[0], min(of[1], top)) / (band(f, p, to[0], min(to[1], top)) + 1e-12)
    c = x - x.mean()
    var = float((c * c).mean())
    return {
        "baseline_wander": share(BASELINE_HZ, DIAGNOSTIC_HZ),
        "muscle_noise": share(MUSCLE_HZ, TOTAL_HZ),
        "powerline": share((mains - 1, mains + 1), TOTAL_HZ),
        "clipping": float((np.abs(np.diff(x)) <= 1e-8).mean()) if x.size >= 4 else 0.0,
        "flat_std": var**0.5,
        "flat_fraction": flat_share(x, fs),
        "saturation_fraction": float((np.abs(x) >= FULL_SCALE * abs(full_scale_mv)).mean()) if full_scale_mv and np.isfinite(full_scale_mv) else None,
        "p_sqi": share(PSQI_HZ, PSQI_OF_HZ),
        "k_sqi": float((c**4).mean()) / (var * var) if var > 1e-12 else 0.0,
        "b_sqi": agreement(simple_peaks(x, fs, True), simple_peaks(x, fs, False), max(1, round(MATCH_S * fs))),
    }

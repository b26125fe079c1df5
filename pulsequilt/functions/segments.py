"""Numpy measures of one lead's beat: deflections of QRS, ST levels and slope, U waves. They run inside Arrow batches."""

from __future__ import annotations

import numpy as np

from pulsequilt.functions.series import spread

#: Fixed values of QRS: share of its range that a notch has, levels of a deflection's ends in mV and of the range, durations in ms.
NOTCH, END_MV, END_SHARE, DEFLECTION_MS = 0.10, 0.008, 0.05, (4.0, 160.0)
#: Fixed values of U waves: window after T in ms, edges of it, least mV, prominence and ms, and the quiet stretch before.
U_START, U_STOP, U_EDGE, U_MV, U_PROMINENCE, U_MS, U_QUIET, U_BAND_MV, U_BAND_SHARE = 10.0, 240.0, 15.0, 0.020, 0.020, 60.0, 20.0, 0.030, 0.30
#: Places after J in ms, and the outlier limit of slopes in sigmas.
ST_MS, OUTLIER = (0, 20, 40, 60, 80), 3.5


def turns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where x turns down and where it turns up; a level stretch counts as going on."""
    s = np.sign(np.diff(x))
    for i in np.flatnonzero(s == 0).tolist():
        s[i] = s[i - 1] if i else 0
    return np.flatnonzero((s[:-1] > 0) & (s[1:] < 0)) + 1, np.flatnonzero((s[:-1] < 0) & (s[1:] > 0)) + 1


def _lasts(x: np.ndarray, at: int | None, sign: int, limit: float, fs: float) -> float | None:
    """The ms that a deflection stays beyond its limit around a place, if plausible."""
    if at is None or sign * x[at] <= limit:
        return None
    out = np.flatnonzero(sign * x <= limit)
    left = int(out[out < at].max()) + 1 if (out < at).any() else 0
    right = int(out[out > at].min()) - 1 if (out > at).any() else x.size - 1
    ms = (right - left + 1) * 1000 / fs
    return ms if DEFLECTION_MS[0] <= ms <= DEFLECTION_MS[1] else None


def qrs_deflections(x: np.ndarray, on: int, off: int, r: int, level: float, fs: float) -> dict:
    """Amplitudes (mV) and durations (ms) of Q, R, S, R' and S' against ``level`` between on and off, turns, notches, and the signed area in mV ms."""
    names = ("q_mv", "r_mv", "s_mv", "r_prime_mv", "s_prime_mv", "q_ms", "r_ms", "s_ms", "r_prime_ms", "s_prime_ms", "area_mv_ms")
    y = x[on : off + 1] - level
    if off <= on or y.size < 3:
        return dict.fromkeys(names) | {"n_turns": 1, "n_notches": 0}
    tops, bottoms = turns(y)
    size, here, top = float(np.abs(y).max()) + 1e-9, r - on, int(y.argmax())
    first = lambda places, k=0: int(places[k]) if places.size > k else None
    r2 = first(tops[(tops > here) & (y[tops] > NOTCH * size)])
    lows = bottoms[(bottoms > here) & (y[bottoms] < -NOTCH * size)]
    s1, s2 = first(lows), first(lows, 1)
    if s2 is None and r2 is not None and lows.size < 2:
        s2 = first(lows[lows > r2])
        s1 = s1 if s1 != s2 else None
    q = int(y[: here + 1].argmin()) if 0 < here < y.size and y[: here + 1].min() < -NOTCH * size else None
    limit = max(END_MV, END_SHARE * size)
    at = lambda k: None if k is None else float(y[k])
    big = int((np.abs(y[np.concatenate([tops, bottoms])]) > NOTCH * size).sum())
    return {
        "q_mv": at(q), "r_mv": max(0.0, float(y[top])), "s_mv": at(s1), "r_prime_mv": at(r2), "s_prime_mv": at(s2),
        "q_ms": _lasts(y, q, -1, limit, fs), "r_ms": _lasts(y, top, 1, limit, fs), "s_ms": _lasts(y, s1, -1, limit, fs), "r_prime_ms": _lasts(y, r2, 1, limit, fs), "s_prime_ms": _lasts(y, s2, -1, limit, fs),
        "area_mv_ms": float(((y[1:] + y[:-1]) / 2).sum() * 1000 / fs), "n_turns": max(1, tops.size + bottoms.size), "n_notches": max(0, big - 1),
    }


def robust_slope(y: np.ndarray, fs: float) -> float | None:
    """The slope of y in units a ms by least squares, without values beyond 3.5 sigmas of the median; null for under 28 ms."""
    if y.size < max(4, round(0.028 * fs)):
        return None
    t, sigma = np.arange(y.size) * 1000 / fs, float(spread(y))
    keep = np.abs(y - np.median(y)) <= OUTLIER * sigma if sigma > 0 else np.ones(y.size, bool)
    keep = keep if keep.sum() >= 4 else np.ones(y.size, bool)
    t, y = t[keep] - t[keep].mean(), y[keep]
    return float((t * y).sum() / (t * t).sum())


def st_levels(x: np.ndarray, j: int, level: float, fs: float) -> dict:
    """Levels against ``level`` at J and 20 to 80 ms after it (each the median of 4 ms around), their mean, and the slope of these 80 ms."""
    half = max(1, round(0.002 * fs))
    out = {}
    for ms in ST_MS:
        k = j + round(ms * fs / 1000)
        out["j_mv" if ms == 0 else f"st{ms}_mv"] = float(np.median(x[max(0, k - half) : k + half + 1])) - level if k + half < x.size else None
    seg = x[j : j + round(0.08 * fs) + 1] - level
    return out | {"st_mean_mv": float(seg.mean()) if seg.size > 1 else None, "st_slope": robust_slope(seg, fs)}


def u_wave(x: np.ndarray, t_off: int, level: float, fs: float, cap: int | None = None) -> dict:
    """The U wave after t_off (not beyond cap): its largest turn, if it is high, prominent, wide, and set off from T by a quiet stretch; else why not."""
    no = lambda why: {"u_peak": None, "u_mv": None, "u_on": None, "u_off": None, "u_reject": why}
    lo, hi = t_off + max(1, round(U_START * fs / 1000)), min(t_off + round(U_STOP * fs / 1000), x.size - 1, *([] if cap is None else [cap]))
    if lo < 0 or hi <= lo + 2:
        return no("window_too_short")
    y = x[lo : hi + 1] - level
    if not np.isfinite(y).all():
        return no("non_finite_window")
    n = max(1, round(0.010 * fs))
    y = np.convolve(y, np.ones(n) / n, "same") if 1 < n <= y.size else y
    edge = max(1, round(U_EDGE * fs / 1000))
    inner = np.arange(edge + 1, y.size - edge - 1)
    a, b, c = y[inner - 1], y[inner], y[inner + 1]
    inner = inner[((b > a) & (b >= c)) | ((b < a) & (b <= c))]
    if not inner.size or not np.abs(y[inner]).max() > 0:
        return no("no_interior_extremum")
    k = int(inner[np.abs(y[inner]).argmax()])
    signed = y if y[k] >= 0 else -y
    if signed[k] < U_MV:
        return no("below_amplitude_floor")
    if signed[k] - max(signed[: k + 1].min(), signed[k:].min()) < U_PROMINENCE:
        return no("insufficient_prominence")
    low = np.flatnonzero(signed <= 0.25 * signed[k])
    on = int(low[low < k].max()) + 1 if (low < k).any() else 0
    off = int(low[low > k].min()) - 1 if (low > k).any() else y.size - 1
    if (off - on) * 1000 / fs < U_MS:
        return no("too_narrow_for_a_u_wave")
    near = np.abs(y[:on]) <= max(U_BAND_MV, U_BAND_SHARE * signed[k])
    runs = np.diff(np.flatnonzero(np.concatenate([[True], ~near, [True]]))) - 1
    if runs.max(initial=0) * 1000 / fs < U_QUIET:
        return no("no_isoelectric_t_u_segment")
    return {"u_peak": lo + k, "u_mv": float(y[k]), "u_on": lo + on, "u_off": lo + off, "u_reject": None}

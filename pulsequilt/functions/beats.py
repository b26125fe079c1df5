"""Numpy kernels on beats and channels: adaptive detection, pacing spikes, alignment and families, delays between leads. They run inside Arrow batches."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from pulsequilt.functions import dsp
from pulsequilt.functions.series import box, rolling_spread, smoothed, spread

# ---------------------------------------------------------------- adaptive detection

#: Fixed values in s: the two moving averages, refractory time, tolerance between channels, margin at the ends.
SHORT, LONG, REFRACTORY, TOLERANCE, MARGIN = 0.111, 0.667, 0.20, 0.05, 0.16


def channel_peaks(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of one channel where its short-term energy stands above the long-term, each with the share of the energy around it that lies within 40 ms."""
    y = dsp.bandpass(x, fs, 8.0, min(20.0, 0.4 * fs))
    energy = y * y
    above = box(energy, max(1, round(SHORT * fs))) > box(energy, max(1, round(LONG * fs))) + 0.02 * energy.mean()
    edges = np.diff(np.concatenate([[0], above.astype(np.int8), [0]]))
    c = np.concatenate([[0.0], np.cumsum(energy)])
    out, share = [], []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        if b - a < SHORT * fs:
            continue
        p = a + int(np.abs(y[a:b]).argmax())
        lo, hi = max(0, p - round(0.15 * fs)), min(x.size, p + round(0.15 * fs) + 1)
        i, j = max(lo, p - round(0.04 * fs)), min(hi, p + round(0.04 * fs) + 1)
        out.append(p)
        share.append((c[j] - c[i]) / (c[hi] - c[lo] + 1e-12))
    return np.array(out, int), np.array(share, float)


def suppress(candidates: list[tuple[int, float, float]], reach: int) -> list[tuple[int, float, float]]:
    """Candidates (place, confidence, strength) by falling confidence, strength and then place, each kept if none kept stands nearer than reach; in order of place."""
    kept: list[int] = []
    out = []
    for p, c, s in sorted(candidates, key=lambda r: (-r[1], -r[2], r[0])):
        k = bisect_left(kept, p)
        if (k == 0 or p - kept[k - 1] >= reach) and (k == len(kept) or kept[k] - p >= reach):
            kept.insert(k, p)
            out.append((p, c, s))
    return sorted(out)


def adaptive_peaks(leads: np.ndarray, fs: float) -> list[tuple[int, float, float]]:
    """Beats (sample, confidence, strength) of leads[n, samples]: each channel's peaks, believed where the channel is the best around or others confirm it, one within 200 ms."""
    active = [i for i, x in enumerate(leads) if np.isfinite(x).all() and x.std() > 1e-8]
    peaks = {i: channel_peaks(leads[i], fs) for i in active}
    near = max(1, round(TOLERANCE * fs))
    found = []
    for i, (own, shares) in peaks.items():
        for p, s in zip(own.tolist(), shares.tolist(), strict=True):
            score, support = {}, 0
            for j, (at, values) in peaks.items():
                a, b = np.searchsorted(at, [p - 4 * fs, p + 4 * fs + 1e-9])
                score[j] = 0.5 * float(np.median(values[a:b])) if b > a else 0.0
                a, b = np.searchsorted(at, [p - near, p + near + 1])
                support += b > a
            best = max(active, key=lambda j: (score[j], j == 1))  # noqa: B023
            alone = support < 2
            if (alone or s < 0.65) if i != best else (len(active) > 1 and alone and s < 0.55):
                continue
            found.append((p, min(1.0, max(0.0, 0.7 * s + 0.3 * support / len(active))), s))
    margin = round(MARGIN * fs)
    return [r for r in suppress(found, round(REFRACTORY * fs)) if margin <= r[0] <= leads.shape[1] - margin]


def without_weak(proposed: np.ndarray, original: np.ndarray, leads: np.ndarray, fs: float) -> np.ndarray:
    """Which proposed beats stay: where both detectors agree on at least 0.9 of six or more original beats, additions that are faint in every lead go."""
    keep = np.ones(proposed.size, bool)
    if original.size < 6 or len(leads) < 2 or not proposed.size:
        return keep
    gap = lambda x, y: np.abs(x[:, None] - y).min(axis=1) if y.size else np.full(x.size, np.inf)
    shared, extra = original[gap(original, proposed) <= 0.05 * fs], gap(proposed, original) > 0.075 * fs
    if shared.size < 0.9 * original.size or extra.sum() < 3:
        return keep
    y, half = np.abs(dsp.bandpass(leads, fs, 8.0, min(20.0, 0.4 * fs))), max(1, round(0.08 * fs))
    height = lambda at: np.array([y[:, max(0, p - half) : p + half + 1].max(axis=1) for p in at])
    usual = height(shared)
    center = np.median(usual, axis=0)
    stable = spread(usual, axis=0) / np.maximum(center, 1e-12) <= 0.25
    if (center < 1e-8).any() or not stable.any():
        return keep
    ratio = height(proposed) / center
    return ~(extra & (ratio.max(axis=1) < 0.35) & (ratio[:, stable].min(axis=1) < 0.15))


# ---------------------------------------------------------------- pacing spikes

#: The widest spike, half of what is taken out, and flanks beside a spike, in ms.
WIDEST, HALF_OUT, FLANK = 6.0, 4.0, 4.0


def _half_width(x: np.ndarray, peak: int, fs: float) -> float:
    """The width in ms of the stretch of at least half the largest deflection within 6 ms."""
    reach = max(1, round(0.006 * fs))
    seg = np.abs(x[max(0, peak - reach) : peak + reach + 1])
    k = int(seg.argmax())
    if seg[k] <= 0:
        return float("inf")
    low = np.flatnonzero(seg < 0.5 * seg[k])
    a = low[low < k].max() + 1 if (low < k).any() else 0
    b = low[low > k].min() - 1 if (low > k).any() else seg.size - 1
    return float(b - a + 1) * 1000 / fs


def prominence_uv(x: np.ndarray, peak: int, fs: float, width_ms: float) -> float:
    """How far a spike stands above the level of both its flanks."""
    half, flank = max(1, round((max(width_ms, 1.0) / 2 + 3.0) * fs / 1000)), max(2, round(FLANK * fs / 1000))
    sides = [x[max(0, peak - half - flank) : max(0, peak - half)], x[peak + half + 1 : peak + half + 1 + flank]]
    levels = [float(np.median(s)) for s in sides if s.size]
    return abs(float(x[peak]) - float(np.median(levels or x))) * 1000


def spike_candidates(x: np.ndarray, fs: float) -> list[tuple[int, float, float, float]]:
    """(sample, score, width in ms, prominence in microvolts) of narrow deflections of one lead whose difference stands above four of its spreads around."""
    if x.size < 3:
        return []
    sharp = np.diff(x, prepend=x[0])
    sigma = rolling_spread(sharp, max(9, round(0.05 * fs)))
    above = np.abs(sharp) >= np.maximum(4 * sigma, 0.001)
    edges = np.diff(np.concatenate([[0], above.astype(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        near, reach = a + int(np.abs(sharp[a:b]).argmax()), max(1, round(0.002 * fs))
        lo = max(0, near - reach)
        peak = lo + int(np.abs(x[lo : near + reach + 1]).argmax())
        wide, raw = (b - a) * 1000 / fs, _half_width(x, peak, fs)
        if max(wide, raw) <= WIDEST:
            out.append((peak, float((np.abs(sharp[a:b]) / np.maximum(sigma[a:b], 1e-9)).max()), max(wide, raw), prominence_uv(x, peak, fs, max(wide, raw))))
    return out


def without_spikes(x: np.ndarray, spikes: list[int], fs: float) -> np.ndarray:
    """x[leads, samples] with a straight line in place of 4 ms on each side of every spike; at an end, the other side's value."""
    out, half, n = x.astype(float).copy(), max(1, round(HALF_OUT * fs / 1000)), x.shape[1]
    for s in sorted(set(spikes)):
        lo, hi = max(0, s - half), min(n - 1, s + half)
        if lo > hi:
            continue
        left, right = out[:, lo - 1] if lo else None, out[:, hi + 1] if hi + 1 < n else None
        if left is None and right is None:
            out[:, lo : hi + 1] = 0.0
        else:
            out[:, lo : hi + 1] = np.linspace(right if left is None else left, left if right is None else right, hi - lo + 1, axis=1)
    return out


# ---------------------------------------------------------------- families and representatives


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size >= 1e-8 else 0.0


def aligned(beat: np.ndarray, reference: np.ndarray, reach: int) -> np.ndarray:
    """beat[leads, samples] moved by the lag of at most ``reach`` samples at which its magnitude over leads fits the reference's best; what moves in is zero."""
    vm = lambda x: (v := np.sqrt((np.atleast_2d(x) ** 2).sum(axis=0))) - v.mean()
    a, b = vm(beat), vm(reference)
    n, reach = a.size, min(reach, a.size - 1)
    fits = [float(a[max(0, k) : n + min(0, k)] @ b[max(0, -k) : n - max(0, k)]) for k in range(-reach, reach + 1)]
    lag = int(np.argmax(fits)) - reach
    out = np.zeros_like(beat, dtype=float)
    out[..., max(0, -lag) : n - max(0, lag)] = beat[..., max(0, lag) : n + min(0, lag)]
    return out


def rr_context(rr: float | None, median: float | None) -> str:
    """short_rr, long_rr or regular_rr by a quarter around the median, with unknown where either is missing."""
    if rr is None or median is None or not rr > 0 or not np.isfinite(rr) or not median > 0:
        return "unknown"
    ratio = rr / median
    return "short_rr" if ratio < 0.75 else "long_rr" if ratio > 1.25 else "regular_rr"


#: Fixed values of groups: share of R's energy that ends a complex, ms that make it wide, window around R in ms, points of a template a lead, budget of groups and of wide ones, limits of likeness, weight of what is kept.
ENERGY_SHARE, WIDE_MS, WINDOW_MS, POINTS, MOST_GROUPS, MOST_WIDE, JOIN, OUTLIER, KEEP = 0.15, 120.0, (-80, 120), 32, 5, 2, 0.88, 0.65, 0.8


def rough_width(magnitude: np.ndarray, r: int, fs: float) -> float:
    """The ms around R that the magnitude's energy stays above a share of that at R."""
    low = np.flatnonzero(magnitude**2 <= max(ENERGY_SHARE * magnitude[r] ** 2, 1e-8))
    left = int(low[low < r].max()) if (low < r).any() else 0
    right = int(low[low > r].min()) if (low > r).any() else magnitude.size - 1
    return (right - left) * 1000 / fs


def template(x: np.ndarray, r: int, fs: float) -> np.ndarray:
    """The window around R of every lead, at 32 points, centred and of unit length each."""
    seg = x[:, max(0, int(r + WINDOW_MS[0] * fs / 1000)) : int(r + WINDOW_MS[1] * fs / 1000)]
    if not seg.shape[1]:
        return np.zeros(len(x) * POINTS)
    at = np.linspace(0, seg.shape[1] - 1, POINTS)
    out = np.stack([np.interp(at, np.arange(seg.shape[1]), row) for row in seg])
    out = out - out.mean(axis=1, keepdims=True)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1.0)).ravel()


def online_groups(templates: list[np.ndarray], most: int, outliers: bool = False) -> list[int]:
    """The group (from 0) that each template joins in turn: the likest if by 0.88 or if no more may begin, else a new one. ``outliers``: what is unlike all (under 0.65) begins one beyond the budget."""
    means: list[np.ndarray] = []
    out = []
    for v in templates:
        like = [float(v @ m) / size if (size := float(np.linalg.norm(v) * np.linalg.norm(m))) >= 1e-8 else 0.0 for m in means]
        best = int(np.argmax(like)) if like else -1
        lone = best < 0 or (outliers and len(means) >= most and like[best] < OUTLIER)
        if not lone and (like[best] >= JOIN or len(means) >= most):
            means[best] = KEEP * means[best] + (1 - KEEP) * v
            out.append(best)
        else:
            means.append(v)
            out.append(len(means) - 1)
    return out


#: Leads that are not derived from others.
INDEPENDENT = ("I", "II", "V1", "V2", "V3", "V4", "V5", "V6")


def group_beats(x: np.ndarray, leads: list[str], r_at: np.ndarray, fs: float, outliers: bool = False) -> list[tuple[float, bool, int]]:
    """Rough width (by the magnitude of independent leads, or of all where none is named so), whether it is wide, and group within narrow or wide beats, of each beat: the two kinds have budgets of their own."""
    own = [k for k, n in enumerate(leads) if n in INDEPENDENT] or list(range(len(x)))
    y = (x[own] - x[own].mean(axis=1, keepdims=True)) / (x[own].std(axis=1, keepdims=True) + 1e-8)
    magnitude = np.sqrt((y * y).mean(axis=0))
    widths = [rough_width(magnitude, int(r), fs) for r in r_at]
    wide = [w >= WIDE_MS for w in widths]
    n_wide = min(MOST_WIDE, MOST_GROUPS - 1) if any(wide) else 0
    out = [0] * len(widths)
    for kind, most in ((False, max(1, MOST_GROUPS - n_wide)), (True, n_wide)):
        mine = [k for k, w in enumerate(wide) if w == kind]
        for k, g in zip(mine, online_groups([template(x, int(r_at[k]), fs) for k in mine], most, outliers), strict=True):
            out[k] = g
    return list(zip(widths, wide, out, strict=True))


class _Kin:
    """Families of one pacing and RR context side by side, so that a window is held against all at once."""

    def __init__(self, reach: int):
        self.reach, self.ids, self.slots, self.rows, self.sizes = reach, [], {}, [], []

    def put(self, k: int, mean: np.ndarray) -> None:
        """Family k has this mean now."""
        slot = self.slots.setdefault(k, len(self.ids))
        if slot == len(self.ids):
            if slot == len(self.rows):
                more = np.zeros((max(8, slot), 2, mean.size))
                self.rows = np.concatenate([self.rows, more]) if slot else more
            self.ids.append(k)
            self.sizes.append(0.0)
        vm = np.sqrt((np.atleast_2d(mean) ** 2).sum(axis=0))
        self.rows[slot, 0] = mean.ravel() - mean.mean()
        self.rows[slot, 1, : vm.size] = vm - vm.mean()
        self.sizes[slot] = float(np.linalg.norm(self.rows[slot, 0]))

    def near(self, window: np.ndarray) -> list[int]:
        """The families that may be most like the window, in order: all that come within rounding of the greatest likeness, or whose lag rounding might decide."""
        f, n = len(self.ids), window.shape[-1]
        reach = min(self.reach, n - 1)
        lags = range(-reach, reach + 1)
        shifted = np.zeros((len(lags), *window.shape))
        for i, k in enumerate(lags):
            shifted[i, ..., max(0, -k) : n - max(0, k)] = window[..., max(0, k) : n + min(0, k)]
        flat = shifted.reshape(len(lags), -1)
        flat = flat - flat.mean(axis=1, keepdims=True)
        like, sizes = np.einsum("ij,kj->ik", flat, self.rows[:f, 0]), np.linalg.norm(flat, axis=1)  # not BLAS, whose threads crowd a task's core
        lag, unsure, at = np.full(f, reach), np.zeros(f, bool), np.arange(f)
        if reach:
            vm = np.sqrt((np.atleast_2d(window) ** 2).sum(axis=0))
            vm -= vm.mean()
            a = np.zeros((len(lags), n))
            for i, k in enumerate(lags):
                a[i, max(0, -k) : n - max(0, k)] = vm[max(0, k) : n + min(0, k)]
            b = self.rows[:f, 1, :n]
            fits = np.einsum("ij,kj->ik", a, b)
            lag = fits.argmax(axis=0)
            top = np.partition(fits, -2, axis=0)[-2:]
            unsure = ~(top[1] - top[0] > 1e-9 * np.linalg.norm(vm) * np.linalg.norm(b, axis=1))
        size = sizes[lag] * np.array(self.sizes)
        c = np.where(size >= 2e-8, like[lag, at] / np.maximum(size, 1e-300), 0.0)
        unsure |= (size < 2e-8) | ~np.isfinite(c)
        unsure &= ~(sizes.max() * np.array(self.sizes) < 5e-9)  # a flat one is like none, whatever the lag
        most = c[~unsure].max(initial=-np.inf)
        return [self.ids[j] for j in np.flatnonzero(unsure | (c >= most - 1e-7))]


class Families:
    """Beats join the family (of their pacing and RR context) whose running mean they are most like, if by at least the threshold; else they found one."""

    def __init__(self, threshold: float = 0.88, reach: int = 0):
        self.threshold, self.reach = threshold, reach
        self.means: list[tuple[tuple, np.ndarray, int]] = []
        self.kin: dict[tuple, _Kin] = {}

    def join(self, window: np.ndarray, paced: bool, context: str) -> int:
        best, most, moved = -1, -1.0, window
        kin = self.kin.setdefault((paced, context), _Kin(self.reach))
        for k in kin.near(window) if kin.ids else ():
            mean = self.means[k][1]
            w = aligned(window, mean, self.reach) if self.reach else window
            c = likeness(w, mean)
            if c > most:
                best, most, moved = k, c, w
        if best < 0 or most < self.threshold:
            best = len(self.means)
            self.means.append(((paced, context), np.array(window, float), 1))
        else:
            key, mean, n = self.means[best]
            self.means[best] = key, mean + (moved - mean) / (n + 1), n + 1
        kin.put(best, self.means[best][1])
        return best + 1


def representative(windows: np.ndarray, reach: int, least: float = 0.70) -> tuple[np.ndarray, int]:
    """The median of windows[beats, leads, samples] after alignment to the first, without those less like it than ``least`` (all stay if none is), and how many count."""
    first = windows[0]
    moved = np.stack([first, *(aligned(w, first, reach) for w in windows[1:])])
    vm = lambda x: np.sqrt((x**2).sum(axis=0))
    good = np.array([likeness(vm(w), vm(first)) >= least for w in moved])
    chosen = moved[good] if good.any() else moved
    return np.median(chosen, axis=0), len(chosen)


# ---------------------------------------------------------------- delays between leads

#: What a delay must be to be corrected: at least and at most so many ms, spread in ms, likeness afterwards and gain of likeness.
LEAST_MS, MOST_MS, MOST_SPREAD_MS, LEAST_CORR, LEAST_GAIN = 8.0, 20.0, 2.5, 0.75, 0.08


def moved(x: np.ndarray, delay: float) -> np.ndarray:
    """x without a delay of so many samples (of either sign), by interpolation; ends repeat."""
    at = np.arange(x.size, dtype=float)
    return np.interp(at + delay, at, x)


def envelope(x: np.ndarray, fs: float) -> np.ndarray:
    return smoothed(np.abs(np.gradient(x)), max(0.5, 0.004 * fs))


def lead_delay(env: np.ndarray, reference: np.ndarray, r_at: np.ndarray, fs: float) -> dict:
    """How many samples a lead's envelope is behind the reference: the median over beats, refined by correlation around it to a fraction; null for under three beats."""
    reach = max(2, round(0.08 * fs))
    gaps = [float(env[a:b].argmax() - reference[a:b].argmax()) for r in r_at.tolist() if (b := min(env.size, r + reach + 1)) - (a := max(0, r - reach)) >= 5]
    if len(gaps) < 3:
        return {"beats": len(gaps), "delay": None, "spread_ms": None, "raw_corr": None, "corr": None, "correctable": False}
    center = round(float(np.median(gaps)))
    corr = lambda d: likeness(moved(env, d), reference)
    score = {k: corr(k) for k in range(center - 2, center + 3)}
    best = max(range(center - 1, center + 2), key=lambda k: score[k])
    bend = score[best - 1] - 2 * score[best] + score[best + 1]
    delay = best + float(np.clip(0.5 * (score[best - 1] - score[best + 1]) / bend, -0.5, 0.5)) if abs(bend) > 1e-12 else float(best)
    raw, after, ms = corr(0), corr(delay), 1000 / fs
    wide = float(spread(np.array(gaps))) * ms
    fine = LEAST_MS <= abs(delay * ms) <= MOST_MS and wide <= MOST_SPREAD_MS and after >= LEAST_CORR and after - raw >= LEAST_GAIN
    return {"beats": len(gaps), "delay": delay, "spread_ms": wide, "raw_corr": raw, "corr": after, "correctable": bool(fine)}

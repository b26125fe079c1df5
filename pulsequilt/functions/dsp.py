"""Numpy kernels for sampled signals, without Spark: they run inside Arrow batches.

Zero-phase filters multiply the spectrum of an oddly reflected signal by the
squared Butterworth magnitude (what filtering forward and backward gives).
"""

from __future__ import annotations

import numpy as np


def _zero_phase(x: np.ndarray, fs: float, gain) -> np.ndarray:
    """x[..., n] through a real gain of the (prewarped) frequency in Hz."""
    n = x.shape[-1]
    pad = min(n - 1, int(2 * fs))
    if pad < 1:
        return x.astype(float)
    left, right = 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=-1)
    f = np.fft.rfftfreq(y.shape[-1], 1 / fs)
    return np.fft.irfft(np.fft.rfft(y) * gain(f), y.shape[-1])[..., pad : pad + n]


def _warp(f, fs: float):
    return np.tan(np.pi * np.minimum(f, 0.4999 * fs) / fs)


def lowpass(x: np.ndarray, fs: float, cutoff: float, order: int = 2) -> np.ndarray:
    """Identity at or above 99 % of the Nyquist frequency."""
    if cutoff >= 0.495 * fs:
        return x.astype(float)
    return _zero_phase(x, fs, lambda f: 1 / (1 + (_warp(f, fs) / _warp(cutoff, fs)) ** (2 * order)))


def highpass(x: np.ndarray, fs: float, cutoff: float, order: int = 2) -> np.ndarray:
    def gain(f):
        r = (_warp(f, fs) / _warp(cutoff, fs)) ** (2 * order)
        return r / (1 + r)

    return _zero_phase(x, fs, gain)


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 3) -> np.ndarray:
    return highpass(lowpass(x, fs, high, order), fs, low, order)


def notch(x: np.ndarray, fs: float, mains: float, q: float = 30.0) -> np.ndarray:
    """Second-order notch; identity where mains is at 99 % of Nyquist or above."""
    if mains >= 0.495 * fs:
        return x.astype(float)

    def gain(f):
        w, w0 = _warp(f, fs), _warp(mains, fs)
        d = (w0 * w0 - w * w) ** 2
        return d / (d + (w0 * w / q) ** 2 + 1e-300)

    return _zero_phase(x, fs, gain)


def resample(x: np.ndarray, fs: float, to: float) -> np.ndarray:
    """Band-limited to the lower Nyquist frequency, then interpolated; the length is the rounded duration."""
    n = max(1, round(x.shape[-1] * to / fs))
    y = lowpass(x, fs, 0.45 * to, 8) if to < fs else x
    at = np.minimum(np.arange(n) * fs / to, x.shape[-1] - 1)
    i = np.minimum(at.astype(int), max(x.shape[-1] - 2, 0))
    part = at - i
    return y[..., i] * (1 - part) + y[..., np.minimum(i + 1, x.shape[-1] - 1)] * part


def boxcar(x: np.ndarray, width: int) -> np.ndarray:
    """Moving average of the same length; edges average what there is."""
    c = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(x.size)
    a, b = np.maximum(i - width // 2, 0), np.minimum(i - width // 2 + width, x.size)
    return (c[b] - c[a]) / (b - a)


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima of at least the height, the higher of two nearer than the distance (the earlier of equal ones)."""
    if x.size < 3:
        return np.zeros(0, int)
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    keep: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")].tolist():
        if all(abs(i - k) >= distance for k in keep):
            keep.append(i)
    return np.array(sorted(keep), int)


def qrs_peaks(leads: np.ndarray, fs: float) -> np.ndarray:
    """R samples of leads[n, samples]: band energy over all leads, thresholds on its percentile and spread, a robust one where it finds many more, then the largest deflection near each."""
    band = bandpass(leads, fs, 5.0, min(25.0, 0.45 * fs))
    energy = boxcar(np.concatenate([[0.0], (np.diff(band, axis=-1) ** 2).sum(axis=0)]), max(1, round(0.12 * fs)))
    p95, med = np.percentile(energy, 95), np.median(energy)
    mad = 1.4826 * np.median(np.abs(energy - med))
    gap = max(1, round(0.22 * fs))
    found = peaks(energy, max(0.3 * p95, energy.mean() + 0.5 * energy.std()), gap)
    robust = peaks(energy, max(0.3 * p95 if found.size > 3 else 0.0, med + 8 * mad, 1e-12), gap)
    if robust.size >= 3 and robust.size > found.size + 2 and (found.size < 4 or found.size * fs / leads.shape[-1] < 0.55):
        found = robust
    reach, size = round(0.05 * fs), np.abs(band).sum(axis=0)
    out: list[int] = []
    for i in found.tolist():
        a, b = max(0, i - reach), min(size.size, i + reach + 1)
        r = a + int(size[a:b].argmax())
        if out and r - out[-1] < 0.2 * fs:
            out[-1] = max(out[-1], r, key=lambda k: size[k])
        else:
            out.append(r)
    margin = 0.16 * fs
    return np.array([r for r in out if margin <= r <= size.size - 1 - margin], int)


def _edge(slope: np.ndarray, start: int, stop: int, step: int, limit: float, quiet: int) -> int:
    """The last sample on the way from start to stop before ``quiet`` samples in a row lie under the limit."""
    run = 0
    for i in range(start, stop, step):
        run = run + 1 if slope[i] < limit else 0
        if run == quiet:
            return i - step * (quiet - 1)
    return stop - step


def delineate(x: np.ndarray, fs: float, r_at: np.ndarray) -> list[dict]:
    """P, QRS and T bounds of one lead around each R sample; None where a wave doesn't stand out."""
    y = lowpass(x, fs, min(40.0, 0.45 * fs))
    slope = np.abs(np.gradient(y)) * fs
    ms = lambda v: max(1, round(v * fs / 1000))
    rows = []
    for k, r in enumerate(r_at.tolist()):
        rr = int(r_at[k + 1] - r) if k + 1 < r_at.size else int(np.median(np.diff(r_at))) if r_at.size > 1 else ms(800)
        peak = slope[max(0, r - ms(60)) : r + ms(60)].max()
        on = _edge(slope, r, max(0, r - ms(110)), -1, 0.08 * peak, ms(6))
        off = _edge(slope, r, min(x.size - 1, r + ms(130)), 1, 0.08 * peak, ms(6))
        base = float(np.median(y[max(0, on - ms(20)) : on + 1]))
        row = {"r_peak": r, "qrs_on": on, "qrs_off": off, "p_on": None, "p_off": None, "t_off": None, "r_amp": float(y[r] - base), "t_amp": None, "st80": float(y[min(x.size - 1, off + ms(80))] - base)}
        a, b = off + ms(60), min(x.size - 1, r + rr - max(ms(150), round(0.28 * rr)))
        if b > a + ms(40):
            seg = y[a:b] - base
            t = a + int(np.abs(seg).argmax())
            if abs(y[t] - base) >= 0.05 and a < t < b - 1:
                row["t_amp"] = float(y[t] - base)
                down = slope[t:b]
                s = t + int(down.argmax())
                if slope[s] > 0:  # where the steepest tangent meets the baseline
                    row["t_off"] = min(b, s + round(abs(y[s] - base) / slope[s] * fs))
        rows.append(row)
    after = [row["t_off"] - row["r_peak"] for row in rows if row["t_off"] is not None]
    tail = int(np.median(after)) if after else 0
    for k, row in enumerate(rows):  # P waves stand between the T wave before and the QRS complex
        r, on = row["r_peak"], row["qrs_on"]
        rr = int(r - r_at[k - 1]) if k else int(r_at[1] - r) if r_at.size > 1 else ms(800)
        before = rows[k - 1]["t_off"] if k and rows[k - 1]["t_off"] is not None else r - rr + tail
        a, b = max(0, on - min(ms(450), round(0.65 * rr)), before), on - ms(10)
        if b > a + ms(30):
            seg = y[a:b] - np.linspace(y[a], y[b], b - a)
            p = a + int(np.abs(seg).argmax())
            if abs(seg[p - a]) >= 0.03:
                limit = 0.15 * slope[max(a, p - ms(60)) : min(b, p + ms(60))].max()
                row["p_on"] = _edge(slope, max(a, p - ms(15)), a, -1, limit, ms(6))
                row["p_off"] = _edge(slope, min(b - 1, p + ms(15)), b, 1, limit, ms(6))
    return rows


def join_cluster(protos: list[np.ndarray], w: np.ndarray, threshold: float = 0.88, most: int = 5, keep: float = 0.8) -> int:
    """The number of the prototype of greatest cosine if that is at least the threshold (or no more groups may begin), which then moves towards the window; else of a new one."""
    n = np.linalg.norm(w)
    u = w / n if n > 1e-12 else w
    sims = [float(u @ p / max(np.linalg.norm(p), 1e-12)) for p in protos]
    best = int(np.argmax(sims)) if sims else -1
    if best >= 0 and (sims[best] >= threshold or len(protos) >= most):
        protos[best] = keep * protos[best] + (1 - keep) * u
        return best
    protos.append(u.copy())
    return len(protos) - 1


def online_clusters(windows: np.ndarray, threshold: float = 0.88, most: int = 5, keep: float = 0.8) -> np.ndarray:
    """Group numbers by falling size of windows that join clusters one after the other."""
    protos: list[np.ndarray] = []
    group = np.array([join_cluster(protos, w, threshold, most, keep) for w in windows], int)
    sizes = np.bincount(group, minlength=len(protos))
    rank = np.argsort(np.lexsort((np.arange(len(protos)), -sizes)))
    return rank[group]


def fuse(values: np.ndarray, weights: np.ndarray, fs: float, radius_ms: float = 25.0) -> dict:
    """One boundary of several in samples: the best-supported cluster, a weighted median, an outlier gate, and Huber steps."""
    order = np.argsort(values, kind="stable")
    v, w = values[order].astype(float) * 1000 / fs, weights[order].astype(float)

    def wmedian(x, g):
        return x[np.searchsorted(np.cumsum(g), g.sum() / 2)]

    clusters: list[list[int]] = []
    for i in range(v.size):
        if clusters and v[i] - wmedian(v[clusters[-1]], w[clusters[-1]]) <= radius_ms and v[i] - v[clusters[-1][0]] <= 2 * radius_ms:
            clusters[-1].append(i)
        else:
            clusters.append([i])
    best = max(clusters, key=lambda c: (w[c].sum(), -c[0]))
    x, g = v[best], w[best]
    mid = wmedian(x, g)
    mad = max(3.0, 1.4826 * float(np.median(np.abs(x - mid))))
    inside = np.abs(x - mid) <= max(3 * mad, 15.0)
    x, g = x[inside], g[inside]
    for _ in range(5):
        h = g * np.minimum(1, 1.345 * mad / np.maximum(np.abs(x - mid), 1e-9))
        new = float((h * x).sum() / h.sum())
        done, mid = abs(new - mid) < 0.5, new
        if done:
            break
    return {"boundary": round(mid * fs / 1000), "support": int(x.size), "mad_ms": mad, "ci_ms": 1.96 * mad / float(np.sqrt(g.sum()))}


#: Members from which on a record is fused alone: steps over many records pay for short ones.
FUSED_TOGETHER = 64


def fuse_all(values: np.ndarray, weights: np.ndarray, sizes: np.ndarray, fs: float, radius_ms: float = 25.0) -> dict[str, np.ndarray]:
    """fuse() of many records, whose members (sizes of them each) lie one behind another: each step is taken by all records together.

    Sums are taken over rows of one length, so that they round as those of a single
    record; records that are long, or have members that aren't finite or without
    weight, go through fuse().
    """
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((values, np.repeat(np.arange(sizes.size), sizes)))
    v, w = values[order].astype(float) * 1000 / fs, weights[order].astype(float)
    out = {"boundary": np.zeros(sizes.size, np.int64), "support": np.zeros(sizes.size, np.int64), "mad_ms": np.zeros(sizes.size), "ci_ms": np.zeros(sizes.size)}
    bad = np.concatenate([[0], np.cumsum(~(np.isfinite(v) & np.isfinite(w) & (w > 0)))])
    together = (sizes > 0) & (sizes < FUSED_TOGETHER) & (bad[starts + sizes] == bad[starts])
    for k in np.flatnonzero(~together).tolist():
        at = slice(starts[k], starts[k] + sizes[k])
        for name, x in fuse(values[at], weights[at], fs, radius_ms).items():
            out[name][k] = x

    def by_length(lengths):
        """Which rows have each length."""
        return [(n, np.flatnonzero(lengths == n)) for n in np.unique(lengths).tolist()]

    def row(x, first, n):
        return x[first[:, None] + np.arange(n)]

    def wmedian(first, n):
        g = row(w, first, n)
        return v[first + (np.cumsum(g, axis=1) < g.sum(axis=1)[:, None] / 2).sum(axis=1)]

    def each(f, first, lengths):
        got = np.empty(first.size)
        for n, at in by_length(lengths):
            got[at] = f(first[at], n)
        return got

    ids = np.flatnonzero(together)
    first, size = starts[ids], sizes[ids]
    # the last cluster of each record begins at s; the heaviest one so far is told by its weight, begin and end
    s, heaviest, begin, end = first.copy(), np.full(ids.size, -np.inf), first.copy(), first.copy()

    def close(at, stop):
        total = each(lambda a, n: row(w, a, n).sum(axis=1), s[at], stop - s[at])
        more = total > heaviest[at]
        hit = at[more]
        heaviest[hit], begin[hit], end[hit] = total[more], s[hit], stop[more]

    for i in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(size > i)
        here = first[at] + i
        near = (v[here] - each(wmedian, s[at], here - s[at]) <= radius_ms) & (v[here] - v[s[at]] <= 2 * radius_ms)
        close(at[~near], here[~near])
        s[at[~near]] = here[~near]
    close(np.arange(ids.size), first + size)
    mid, mad = each(wmedian, begin, end - begin), np.empty(ids.size)
    for n, at in by_length(end - begin):
        off = np.abs(row(v, begin[at], n) - mid[at, None])
        mad[at] = np.maximum(3.0, 1.4826 * np.median(off, axis=1))
        inside = off <= np.maximum(3 * mad[at], 15.0)[:, None]
        begin[at] += inside.argmax(axis=1)  # members are sorted, so those inside lie together
        end[at] = begin[at] + inside.sum(axis=1)
    for n, at in by_length(end - begin):
        x, g = row(v, begin[at], n), row(w, begin[at], n)
        m, scale, open_ = mid[at], mad[at], np.ones(at.size, bool)
        for _ in range(5):
            h = g * np.minimum(1, 1.345 * scale[:, None] / np.maximum(np.abs(x - m[:, None]), 1e-9))
            new = (h * x).sum(axis=1) / h.sum(axis=1)
            done, m = np.abs(new - m) < 0.5, np.where(open_, new, m)
            open_ &= ~done
        k = ids[at]
        out["boundary"][k], out["support"][k], out["mad_ms"][k], out["ci_ms"][k] = np.rint(m * fs / 1000), n, scale, 1.96 * scale / np.sqrt(g.sum(axis=1))
    return out


def spectral_quality(x: np.ndarray, fs: float, mains: float = 50.0) -> dict:
    """Shares of power: below 0.7 Hz (drift), above 30 Hz (muscle), around mains, and 5-15 of 5-40 Hz (pSQI)."""
    f = np.fft.rfftfreq(x.size, 1 / fs)
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    total = float(p.sum()) or 1.0
    band = lambda a, b: float(p[(f >= a) & (f < b)].sum())
    return {"drift": band(0, 0.7) / total, "muscle": band(30, fs) / total, "mains": band(mains - 1, mains + 1) / total, "psqi": band(5, 15) / (band(5, 40) or 1.0)}

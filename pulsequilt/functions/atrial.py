"""P waves of all leads together: a baseline from quiet samples, T tails taken out as a spatial subspace, bounds of each lead, one decision a beat. They run inside Arrow batches."""

from __future__ import annotations

import numpy as np

from pulsequilt.functions import dsp
from pulsequilt.functions.series import baseline, smoothed, spread, whitened, without_subspace

#: Fixed values in ms: how far before QRS a P wave begins and how near it ends, what a window must hold, plausible durations and PR intervals.
LONGEST_PR, GUARD, LEAST_WINDOW, P_MS, PR_MS = 280.0, 8.0, 40.0, (35.0, 180.0), (60.0, 350.0)
#: A lead tells if its P wave is so high in mV and in sigmas of quiet samples; bounds lie where it falls to a share of its height.
LEAST_MV, LEAST_SIGMAS, BOUND_SHARE = 0.02, 3.0, 0.20
#: Leads that must tell, the spread of their bounds in ms that is still one wave, and how near a T wave must end to be taken out.
LEAST_LEADS, MOST_SPREAD, T_NEAR = 3, 20.0, 60.0


def lead_bounds(y: np.ndarray, peak: int, reach: int) -> tuple[int, int, int] | None:
    """Onset, peak and offset of the deflection of y nearest ``peak`` (within reach), where it falls to a share of its height; None if an end cuts it or there is none."""
    lo, hi = max(0, peak - reach), min(y.size, peak + reach + 1)
    p = lo + int(np.abs(y[lo:hi]).argmax())
    if y[p] == 0:
        return None
    low = (np.abs(y) < BOUND_SHARE * abs(y[p])) | (np.sign(y) == -np.sign(y[p]))
    before, after = np.flatnonzero(low[:p]), np.flatnonzero(low[p + 1 :])
    return (int(before[-1]), p, p + 1 + int(after[0])) if before.size and after.size else None


def p_waves(x: np.ndarray, fs: float, r_at: np.ndarray) -> list[dict]:
    """For each beat: state (P_PRESENT, P_ABSENT, INDETERMINATE), why it is not accepted, bounds in samples with their spread over leads, leads that tell, and T directions that were taken out; with each lead's own bounds."""
    ms = lambda v: round(v * fs / 1000)
    marks = [dsp.delineate(row, fs, r_at) for row in x]
    middle = lambda k, name: (lambda v: int(np.median(v)) if v else None)([m[k][name] for m in marks if m[k][name] is not None])
    beats = [(middle(k, "qrs_on"), middle(k, "qrs_off"), middle(k, "t_off")) for k in range(r_at.size)]
    quiet = np.ones(x.shape[1], bool)
    for on, off, t_off in beats:
        quiet[max(0, on - ms(LONGEST_PR)) : (t_off if t_off is not None else off + ms(350)) + ms(20)] = False
    y = x - baseline(x, np.broadcast_to(quiet, x.shape), fs) if quiet.sum() >= ms(200) else x - np.median(x, axis=1, keepdims=True)
    y = smoothed(y, max(0.5, 0.004 * fs))
    activity = whitened(y, quiet, fs)
    sigma = np.maximum(spread(y[:, quiet]) if quiet.sum() > 8 else np.full(len(x), 0.005), 1e-4)
    floor = float(np.median(activity[quiet])) if quiet.any() else float(np.median(activity))
    out = []
    for k, (on, _, _) in enumerate(beats):
        last_t = beats[k - 1][2] if k else None
        start, stop = max(0, on - ms(LONGEST_PR), last_t + ms(10) if last_t is not None else 0), on - ms(GUARD)
        row = {"state": "INDETERMINATE", "reason": "short_window", "onset": None, "peak": None, "offset": None, "onset_sigma_ms": None, "offset_sigma_ms": None, "t_rank": 0, "leads": []}
        out.append(row)
        if stop - start < ms(LEAST_WINDOW):
            continue
        window = y[:, start:stop]
        if last_t is not None and start - last_t <= ms(T_NEAR) and k:
            learn = y[:, r_at[k - 1] + ms(80) : start - ms(10)]
            if learn.shape[1] >= max(8, ms(40)):
                window, row["t_rank"] = without_subspace(learn, window)
        size = np.sqrt((window**2).mean(axis=0))
        peak = int(size.argmax())
        high = np.abs(window[:, max(0, peak - ms(20)) : peak + ms(20) + 1]).max(axis=1)
        tells = np.flatnonzero((high >= LEAST_MV) & (high >= LEAST_SIGMAS * sigma))
        found = {i: b for i in tells.tolist() if (b := lead_bounds(window[i], peak, ms(20)))}
        row["leads"] = [(i, start + a, start + p, start + b) for i, (a, p, b) in found.items()]
        if len(found) < LEAST_LEADS:
            row["state"], row["reason"] = ("P_ABSENT", "no_wave") if len(tells) < LEAST_LEADS else ("INDETERMINATE", "cut_by_window")
            continue
        bounds = np.array(list(found.values()), float)
        onset, top, offset = (int(round(v)) for v in np.median(bounds, axis=0))
        wide = spread(bounds, axis=0) * 1000 / fs
        p_ms, pr_ms = (offset - onset) * 1000 / fs, (on - start - onset) * 1000 / fs
        beat_activity = float(activity[start + onset : start + offset + 1].max())
        reason = "spread_bounds" if max(wide[0], wide[2]) > MOST_SPREAD else "duration" if not P_MS[0] <= p_ms <= P_MS[1] else "pr" if not PR_MS[0] <= pr_ms <= PR_MS[1] else "no_activity" if beat_activity <= floor else None
        row |= {"state": "P_PRESENT" if reason is None else "INDETERMINATE", "reason": reason, "onset": start + onset, "peak": start + top, "offset": start + offset, "onset_sigma_ms": float(wide[0]), "offset_sigma_ms": float(wide[2])}
    return out

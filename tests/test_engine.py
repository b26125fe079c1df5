"""Signal analysis against loops, brute force and planted waves."""

import contextlib
import io
import itertools
import math
import random

import numpy as np
import pytest

from pulsequilt.functions import beats as B
from pulsequilt.functions import series as X
from pulsequilt.operators import engine as E
from pulsequilt.sources import signals as S

FS = 500.0


def gauss(t, at, width, height):
    return height * np.exp(-0.5 * ((t - at) / width) ** 2)


def beats_of(n=5000, fs=FS, rr=0.8, first=0.5, waves=S.WAVES):
    t = np.arange(n) / fs
    out = np.zeros(n)
    at = np.arange(first, n / fs, rr)
    for r in at:
        for offset, width, amp, _ in waves:
            out += gauss(t, r + offset, width, amp)
    return out, np.round(at * fs).astype(int)


def frame(spark, rows):
    """rows of (record_id, lead, samples) as signals."""
    return spark.createDataFrame([(r, lead, FS, [float(v) for v in x]) for r, lead, x in rows], "record_id long, lead string, fs double, samples array<double>")


# ---------------------------------------------------------------- state space


def slow_levels(y, mask, fs, initial, variance):
    """One series, one number after the other."""
    dt, level, slope, p = 1 / fs, initial, 0.0, np.array([[4 * variance, 0.0], [0.0, variance]])
    out = []
    for v, seen in zip(y, mask, strict=True):
        level += dt * slope
        f = np.array([[1.0, dt], [0.0, 1.0]])
        p = f @ p @ f.T + np.diag([variance * 2e-3, variance * 2e-1])
        if seen and np.isfinite(v):
            s = max(p[0, 0] + variance, 1e-12)
            gain = p[:, 0] / s
            e = max(-3 * math.sqrt(s), min(3 * math.sqrt(s), v - level))
            level, slope = level + gain[0] * e, slope + gain[1] * e
            p = p - np.outer(gain, p[0])
        out.append((level, max(p[0, 0], 0.0)))
    return np.array(out).T


def test_levels_equal_a_scalar_loop(spark):
    r = np.random.default_rng(1)
    y = np.cumsum(r.normal(0, 0.02, (3, 400)), axis=1)
    y[0, 50] = np.nan
    y[1, 100:110] = 9.0
    mask = r.random(y.shape) > 0.2
    got = X.levels(y, mask, FS, y[:, 1], np.array([1e-3, 1e-4, 1e-2]))
    for k, v in enumerate((1e-3, 1e-4, 1e-2)):
        want = slow_levels(y[k], mask[k], FS, y[k, 1], v)
        assert np.allclose(got[0][k], want[0], atol=1e-12) and np.allclose(got[1][k], want[1], atol=1e-12)
    rows = [(k, "I", np.nan_to_num(y[k])) for k in range(3)] + [(9, "I", np.arange(7) / 10), (10, "II", [])]
    out = {r.record_id: r for r in E.level_tracks(frame(spark, rows), 0.5, 1e-3).collect()}
    for k, _, x in rows:
        want = slow_levels(np.array(x), np.abs(x) <= 0.5, FS, 0.0, 1e-3) if len(x) else np.zeros((2, 0))
        assert np.allclose(out[k].levels, want[0]) and np.allclose(out[k].variances, want[1])


def test_baseline_follows_drift_under_beats(spark):
    x, r_at = beats_of()
    t = np.arange(x.size) / FS
    drift = 0.3 * np.sin(2 * np.pi * 0.15 * t) + 0.1 * t / 10
    marks = spark.createDataFrame([(1, int(r)) for r in r_at], "record_id long, r_sample long")
    got = {r.record_id: np.array(r.samples) for r in E.without_baseline(frame(spark, [(1, "I", x + drift), (2, "I", 0 * x + 0.7)]), marks).collect()}
    assert np.abs(got[1] - x)[250:-250].max() < 0.08
    assert np.abs(got[2]).max() < 1e-9


# ---------------------------------------------------------------- leads together


def test_planted_subspace_is_removed_with_its_rank():
    r = np.random.default_rng(3)
    d, e = np.linalg.qr(r.normal(size=(8, 2)))[0].T
    t = np.linspace(0, 1, 200)
    one, two = np.outer(d, np.sin(2 * np.pi * t)), np.outer(e, np.cos(2 * np.pi * t))
    p = r.normal(size=(8, 50))
    rest, rank = X.without_subspace(one, np.outer(d, t[:50]) + (p - np.outer(d, d @ p)))
    assert rank == 1 and np.allclose(rest, p - np.outer(d, d @ p))
    rest, rank = X.without_subspace(one + two, np.outer(d, t[:50]) + np.outer(e, t[:50] ** 2))
    assert rank == 2 and np.abs(rest).max() < 1e-9
    assert X.without_subspace(one + 0.3 * two, p)[1] == 1
    assert X.without_subspace(0 * one, p)[1] == 0


def test_whitening_ignores_shared_noise():
    r = np.random.default_rng(4)
    t = np.arange(2000) / FS
    shared = r.normal(0, 0.05, 2000)
    x = np.stack([shared + r.normal(0, 0.004, 2000) + gauss(t, 2.0, 0.01, h) for h in (0.36, -0.30, 0.18)])
    quiet = np.abs(t - 2.0) > 0.15
    a = X.whitened(x, quiet, FS)
    assert abs(int(a.argmax()) - 1000) <= 30
    plain = X.smoothed(np.abs(np.gradient(x, axis=1)).mean(axis=0), 3.0)
    event = slice(950, 1050)
    assert a[event].max() / np.median(a[quiet]) > 1.2 * plain[event].max() / np.median(plain[quiet])


def test_projection_needs_leads_that_agree():
    r = np.random.default_rng(5)
    t = np.arange(400) / FS
    edge = 0.3 / (1 + np.exp(-(t - 0.4) / 0.008))
    noise = r.normal(0, 0.003, (4, 400))
    y, c = X.projected(np.outer([1.0, -0.7, 0.4, 0.2], edge) + noise, noise, 200, FS)
    assert c > 0.9 and abs(int(np.abs(np.gradient(X.smoothed(y, 3.0))).argmax()) - 200) <= 3
    assert X.projected(np.outer([1.0, 0, 0, 0], edge) + noise, noise, 200, FS) is None
    assert X.projected(noise * 10, noise, 200, FS) is None
    assert X.projected(np.full((4, 400), np.nan), noise, 200, FS) is None


# ---------------------------------------------------------------- sequences


def sequence_cost(beats, choice, fs):
    """The cost of one choice for beats (anchor, rr, width, states)."""
    total, before = 0.0, None
    for (anchor, rr, width, states), k in zip(beats, choice, strict=True):
        on, off, cost = states[k]
        total += cost
        if before:
            a, q, w, s = before
            broken = abs(width - w) > 0.03 * fs or min(rr, q) <= 0 or max(rr, q) > 1.2 * min(rr, q) or anchor - a > 1.5 * max(rr, q)
            if not broken:
                for x, y in ((on, s[0]), (off, s[1])):
                    total += 0.35 * min(abs((x - anchor) - (y - a) - 0.12 * (rr - q)) / (0.04 * fs), 2.0)
        before = anchor, rr, width, states[k]
    return total


def test_sequences_equal_brute_force(spark):
    r = random.Random(6)
    rows, groups = [], {}
    for record in range(25):
        anchor, beats = 0, []
        for b in range(r.randint(1, 9)):
            rr = r.choice([400, 410, 430, 0, 520])
            anchor += r.choice([400, 420, 700])
            states = [(anchor + r.randint(80, 120), anchor + r.randint(180, 240), round(r.random(), 6)) for _ in range(r.choice([0, 1, 2, 3, 3]))]
            beats.append((anchor, rr, r.choice([40, 45, 70]), states))
            rows += [(record, "II", b, float(anchor), float(rr), float(beats[-1][2]), k, *map(float, s)) for k, s in enumerate(states)] or [(record, "II", b, float(anchor), float(rr), float(beats[-1][2]), None, None, None, None)]
        groups[record] = beats
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "record_id long, lead string, beat_id long, anchor double, rr double, qrs_width double, state long, onset double, offset double, cost double")
    got = {}
    for x in E.boundary_sequences(df.repartition(5), FS).collect():
        got[x.record_id, x.beat_id] = x.state, x.chain_cost
    n = 0
    for record, beats in groups.items():
        for full, part in itertools.groupby(enumerate(beats), lambda x: bool(x[1][3])):
            part = list(part)
            if not full:
                assert all((record, b) not in got for b, _ in part)
                continue
            chain = [x for _, x in part]
            best = min(itertools.product(*(range(len(x[3])) for x in chain)), key=lambda c: sequence_cost(chain, c, FS))  # noqa: B023
            assert tuple(got[record, b][0] for b, _ in part) == best
            assert got[record, part[-1][0]][1] == pytest.approx(sequence_cost(chain, best, FS))
            n += len(part)
    assert n == len(got) > 60


STATE = "record_id long, lead string, beat_id long, anchor double, rr double, qrs_width double, state long, onset double, offset double, cost double"


def test_sequences_do_not_depend_on_how_rows_lie(spark):
    """States of a beat that lie apart or come twice, null keys and null states, and batches that end anywhere; last tells where the next beat isn't chosen."""
    r = random.Random(8)
    rows = []
    for record in (*range(12), None):
        for lead in ("II", None):
            for b in range(r.randint(1, 12)):
                facts = (b * 400.0, r.choice([400.0, 410.0, 520.0, None]), r.choice([40.0, 70.0]))
                states = [(k, b * 400.0 + r.randint(80, 120), b * 400.0 + r.randint(180, 240), round(r.random(), 6)) for k in range(3)] if r.random() < 0.8 else [(None, None, None, None), (1, None, 5.0, 0.1)]
                rows += [(record, lead, b, *facts, *x) for x in states if r.random() < 0.9]
    rows += [(20, "II", 0, 0.0, 400.0, 40.0, 1, 100.0, 200.0, 0.5)] * 2 + [(20, "II", None, 0.0, 400.0, 40.0, 1, 100.0, 200.0, 0.5)]
    near = spark.createDataFrame(sorted(rows, key=str), STATE).coalesce(1)
    apart = spark.createDataFrame(r.sample(rows, len(rows)), STATE).repartition(5)
    told = lambda df: sorted((str(x) for x in E.boundary_sequences(df, FS).collect()))
    want = told(near)
    assert told(apart) == want and len(want) > 60
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        assert told(near) == told(apart) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {(x.record_id, x.lead, x.beat_id): x.last for x in E.boundary_sequences(near, FS).collect()}
    assert got == {(k, lead, b): (k, lead, b + 1) not in got for k, lead, b in got} and got[20, "II", 0] and len(want) == len(got)


def test_sequences_deal_a_beat_as_one_row_and_need_its_anchor(spark):
    """Before, each state was dealt with all that is told of its beat."""
    row = (1, "II", 0, 0.0, 400.0, 40.0, 0, 100.0, 200.0, 0.5)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        E.boundary_sequences(spark.createDataFrame([row], STATE), FS).explain()
    lines = [line for line in out.getvalue().splitlines() if "Exchange" in line or "MapInArrow" in line]
    assert ["Exchange" in line for line in lines] == [False, True, False] and "REPARTITION_BY_NUM" in lines[1]
    with pytest.raises(Exception, match="no anchor of beat 0"):
        E.boundary_sequences(spark.createDataFrame([(*row[:3], None, *row[4:])], STATE), FS).collect()
    assert E.boundary_sequences(spark.createDataFrame([(*row[:3], None, *row[4:6], None, None, None, None)], STATE), FS).count() == 0


# ---------------------------------------------------------------- spectra


def flutter_waves(n, bpm, fs=FS):
    phase = np.arange(n) / fs * bpm / 60 % 1
    return 0.12 * (phase - 0.5)


def test_flutter_under_beats_is_found(spark):
    r = np.random.default_rng(7)
    vent = tuple(w for w in S.WAVES if w[0] > -0.1)
    x, r_at = beats_of(rr=0.77, waves=vent)
    noise = lambda: r.normal(0, 0.005, x.size)
    rows = [(1, lead, g * x + flutter_waves(x.size, 290) + noise()) for lead, g in (("II", 1.0), ("III", 0.7), ("aVF", 0.8))] + [(2, lead, g * x + noise() * 4) for lead, g in (("II", 1.0), ("III", 0.7), ("aVF", 0.8))] + [(3, "II", 0 * x)]
    marks = spark.createDataFrame([(k, int(s)) for k in (1, 2) for s in r_at], "record_id long, r_sample long")
    spectra = E.residual_spectra(frame(spark, rows), marks)
    by = {(r.record_id, r.lead): r for r in spectra.collect()}
    assert all(abs(by[1, lead].bpm - 290) < 6 and by[1, lead].left < 0.1 for lead in ("II", "III", "aVF"))
    assert by[1, "II"].periodicity > 0.6 > by[2, "II"].periodicity and by[1, "II"].entropy < by[2, "II"].entropy
    assert by[3, "II"].bpm is None and by[3, "II"].left is None
    facts = {r.record_id: r for r in E.flutter_facts(spectra).collect()}
    assert facts[1].flutter and abs(facts[1].flutter_bpm - 290) < 6 and not facts[2].flutter and not facts[3].flutter


def test_beats_leave_no_template_behind():
    x, r_at = beats_of()
    f = flutter_waves(x.size, 250)
    rest, left = X.without_beats(np.stack([x, 2 * x]), r_at, FS)
    assert left < 1e-3 and np.abs(rest[:, 700:-700]).max() < 0.1
    rest, _ = X.without_beats((x + f)[None], r_at, FS)
    assert X.flutter(rest[0], FS)["bpm"] == pytest.approx(250, abs=6)
    assert np.isnan(X.without_beats(x[None], r_at[:2], FS)[1])


# ---------------------------------------------------------------- pacing


LEADS = ("I", "II", "III", "aVR", "aVL", "V1")


def paced(at, leads=LEADS, height=0.8):
    """Leads with beats 40 ms after spikes of two samples."""
    x, _ = beats_of()
    out = []
    for k, lead in enumerate(LEADS):
        y = (0.5 + 0.1 * k) * x + np.random.default_rng(k).normal(0, 0.003, x.size)
        clean = y.copy()
        if lead in leads:
            for s in at:
                y[s : s + 2] += height * (1 if k % 2 else -1)
        out.append((lead, y, clean))
    return out


def test_planted_spikes_are_found_voted_on_and_removed(spark):
    regular, uneven = [230 + 400 * k for k in range(11)], [230, 900, 1100, 2600, 3000, 4600]
    cases = {1: paced(regular), 2: paced(uneven), 3: paced(regular, LEADS[:2]), 4: paced([]), 5: paced(regular, height=0.15)}
    signals = frame(spark, [(k, lead, y) for k, c in cases.items() for lead, y, _ in c])
    rhythm = E.pacing_rhythm(E.spike_clusters(E.spike_candidates(signals)))
    got = {r.record_id: r for r in rhythm.collect()}
    assert set(got) == {1, 2}
    near = lambda found, want: len(found) == len(want) and max(abs(a - b) for a, b in zip(found, want, strict=True)) <= 2
    assert near(got[1].spikes, regular) and got[1].paced and got[1].state == "on" and got[1].lead_votes == 6 and got[1].robust_cv < 0.01
    assert near(got[2].spikes, [230, 900, 2600, 4600]) or len(got[2].spikes) >= 3
    assert not got[2].paced and got[2].state == "unknown"
    cleaned = {(r.record_id, r.lead): np.array(r.samples) for r in E.despiked(signals, rhythm).collect()}
    for lead, y, clean in cases[1]:
        assert np.abs(cleaned[1, lead] - clean).max() < 0.25 * np.abs(y - clean).max()
        assert np.allclose(cleaned[1, lead], B.without_spikes(y[None], list(got[1].spikes), FS)[0])
    assert all(np.array_equal(cleaned[4, lead], y) for lead, y, _ in cases[4])


def test_spikes_at_the_ends_are_bridged():
    x = np.arange(20.0)[None]
    out = B.without_spikes(x, [0, 19], FS)
    assert out[0, :3].tolist() == [3.0] * 3 and out[0, -3:].tolist() == [16.0] * 3
    assert B.without_spikes(np.ones((1, 3)), [1], FS).tolist() == [[0.0] * 3]
    assert B.spike_candidates(np.zeros(2), FS) == [] and B.spike_candidates(np.zeros(500), FS) == []


# ---------------------------------------------------------------- detection


def slow_suppress(rows, reach):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[1], -r[2], r[0])):
        if all(abs(row[0] - k[0]) >= reach for k in kept):
            kept.append(row)
    return sorted(kept)


def test_suppression_equals_brute_force():
    r = random.Random(8)
    for _ in range(50):
        rows = [(r.randint(0, 600), r.choice([0.1, 0.5, 0.9]), r.random()) for _ in range(r.randint(0, 60))]
        assert B.suppress(rows, 40) == slow_suppress(rows, 40)


def test_adaptive_detection_finds_beats_of_every_size(spark):
    x, r_at = beats_of(rr=0.9)
    x[int(r_at[5]) - 60 : int(r_at[5]) + 60] *= 8
    r = np.random.default_rng(9)
    rows = [(1, lead, g * x + r.normal(0, 0.01, x.size)) for lead, g in (("I", 0.8), ("II", 1.0), ("V1", -0.6))] + [(1, "V2", 0 * x)] + [(2, "I", 0 * x)]
    got = E.adaptive_detected(frame(spark, rows)).where("record_id = 1").orderBy("beat_id").collect()
    want = [k for k in r_at if 80 <= k <= x.size - 80]
    assert len(got) == len(want) and max(abs(g.r_sample - w) for g, w in zip(got, want, strict=True)) <= 8
    assert all(0 < g.confidence <= 1 for g in got) and E.adaptive_detected(frame(spark, rows[-1:])).count() == 0


def test_faint_additions_go_and_others_stay():
    x, r_at = beats_of(rr=0.9)
    t = np.arange(x.size) / FS
    for r in r_at:
        x = x + gauss(t, r / FS - 0.4, 0.015, 0.05)
    leads = np.stack([x, 0.7 * x])
    proposed = np.sort(np.concatenate([r_at, r_at - 200]))
    keep = B.without_weak(proposed, r_at, leads, FS)
    assert proposed[keep].tolist() == r_at.tolist()
    strong = leads + sum(gauss(t, (r - 200) / FS, 0.011, 1.0) for r in r_at)
    assert B.without_weak(proposed, r_at, strong, FS).all()
    assert B.without_weak(proposed, r_at[:5], leads, FS).all()


# ---------------------------------------------------------------- families


def test_shifted_copies_join_one_family(spark):
    t = np.linspace(-1, 1, 120)
    base, other = gauss(t, 0, 0.08, 1.0) - gauss(t, 0.2, 0.1, 0.3), -gauss(t, 0, 0.2, 1.0)
    lag = lambda x, k: np.roll(x, k)
    rows = [(1, k, lag(base, k % 7 - 3), 800.0, False) for k in range(8)] + [(1, 8, other, 800.0, False), (1, 9, base, 500.0, False), (1, 10, base, 800.0, True), (1, 11, base, None, False), (1, 12, base, 1200.0, False), (2, 0, other, None, None)]
    df = spark.createDataFrame([(r, b, x.tolist(), rr, p) for r, b, x, rr, p in rows], "record_id long, beat_id long, samples array<double>, rr_prev double, paced boolean").repartition(3)
    got = {(r.record_id, r.beat_id): (r.family, r.rr_context) for r in E.families(df).collect()}
    assert [got[1, k] for k in range(8)] == [(1, "regular_rr")] * 8
    assert [got[1, k] for k in (8, 9, 10, 11, 12)] == [(2, "regular_rr"), (3, "short_rr"), (4, "regular_rr"), (5, "unknown"), (6, "long_rr")]
    assert got[2, 0] == (1, "unknown")
    members = df.join(E.families(df), ["record_id", "beat_id"])
    reps = {(r.record_id, r.family): r for r in E.representatives(members).collect()}
    assert reps[1, 1].n == reps[1, 1].n_used == 8 and len(reps) == 7
    assert B.likeness(np.array(reps[1, 1].samples), lag(base, -3)) > 0.999


def test_running_means_and_outliers():
    f = B.Families(0.5)
    a, b = np.array([[0.0, 1, 0, 0]]), np.array([[0.0, 1, 0.4, 0]])
    assert f.join(a, False, "x") == f.join(b, False, "x") == 1
    assert np.allclose(f.means[0][1], (a + b) / 2) and f.means[0][2] == 2
    w = np.stack([np.sin(np.linspace(0, 9, 80))[None] + 2 for _ in range(5)])
    w[3] = np.cos(np.linspace(0, 40, 80)) + 2
    mean, used = B.representative(w, 3)
    assert used == 4 and np.allclose(mean, w[0])


# ---------------------------------------------------------------- repolarization and delays


@pytest.mark.parametrize("height", [0.35, 0.05, -0.2])
def test_wavelet_bounds_of_generated_waves(height):
    t = np.arange(600) / FS
    for width in (0.035, 0.05, 0.065):
        x = gauss(t, 0.6, width, height)
        on, off = X.wavelet_bounds(np.abs(X.detail(x, FS)), FS, 300, 150, 450)
        assert abs((300 - on) / FS - (off - 300) / FS) <= 0.5 * width
        assert 1.6 * width <= (off - 300) / FS <= 2.8 * width and 1.6 * width <= (300 - on) / FS <= 3.0 * width
    assert X.wavelet_bounds(np.abs(X.detail(0 * t, FS)), FS, 300, 150, 450) is None
    assert X.wavelet_bounds(np.ones(600), FS, 151, 150, 450) is None


def test_change_points_by_hand_and_brute_force():
    r = np.random.default_rng(11)
    for pivot in (30, 55, 90):
        x = 0.2 + 0.004 * np.maximum(np.arange(120) - pivot, 0) + r.normal(0, 0.003, 120)
        assert abs(X.change_point(x, FS) - pivot) <= 6
        t = np.arange(120.0)
        errors = {k: np.linalg.lstsq(np.column_stack([np.ones(120), np.maximum(t - k, 0)]), x, rcond=None)[1][0] for k in range(8, 112, 2)}
        assert X.change_point(x, FS) == min(errors, key=errors.get)
    assert X.change_point(np.arange(120.0), FS) is None and X.change_point(np.zeros(120), FS) is None and X.change_point(np.zeros(9), FS) is None


def test_golden_shape_has_t_ends_near_its_own(spark):
    """The reference wave's T end lies 416 ms after R at 500 Hz."""
    x, _ = beats_of(rr=1.0)
    got = E.wavelet_t_bounds(frame(spark, [(1, "II", x)])).collect()
    ends = [r.t_off - r.t_peak for r in got if r.t_off is not None]
    assert len(ends) >= 8 and abs(np.median(ends) * 2 - 116) <= 12
    assert all(r.t_on < r.t_on_ramp < r.t_peak or r.t_on < r.t_peak for r in got if r.t_on is not None)


def test_planted_lags_are_recovered_and_undone(spark):
    x, _ = beats_of()
    late = {"V1": 1, "V2": 3, "V3": 5, "V4": 8, "V5": -4, "V6": 2.5}
    at = np.arange(x.size, dtype=float)
    rows = [(1, lead, x) for lead in ("I", "II", "III", "aVR", "aVL", "aVF", "A", "B")] + [(1, lead, np.interp(at - k, at, x)) for lead, k in late.items()]
    signals = frame(spark, rows)
    delays = E.lead_delays(signals)
    got = {r.lead: r for r in delays.collect()}
    assert all(abs(got[lead].delay - k) <= 0.35 for lead, k in late.items())
    assert all(abs(got[lead].delay) < 0.2 and not got[lead].correctable for lead in ("I", "II"))
    assert got["V4"].correctable and not got["V1"].correctable
    back = {r.lead: np.array(r.samples) for r in E.without_delays(signals, delays).collect()}
    assert np.abs(back["V4"] - x).max() < 0.1 < np.abs(np.array(rows[11][2]) - x).max() and np.array_equal(back["I"], x)
    assert B.lead_delay(x, x, np.array([300]), FS)["delay"] is None


def test_groups_split_by_width_shape_and_pacing(spark):
    narrow, r_at = beats_of(rr=0.9)
    t = np.arange(narrow.size) / FS
    x = narrow.copy()
    for k in (2, 5, 8):  # wide beats of another shape in place of some
        at = r_at[k] / FS
        inside = np.abs(t - at) < 0.2
        x[inside] = sum(gauss(t, at + d, 0.022, 2.0) for d in (-0.06, 0.0, 0.06))[inside]
    rows = [(1, "I", x), (1, "II", 0.8 * x), (2, "I", narrow), (2, "II", narrow)]
    paced = spark.createDataFrame([(2, 0), (2, 1), (2, 1)], "record_id long, beat_id long")
    got = {}
    for r in E.beat_groups(frame(spark, rows), paced).collect():
        got.setdefault(r.record_id, {})[r.beat_id] = r
    one, two = got[1], got[2]
    assert {k for k, r in one.items() if r.wide} == {2, 5, 8} and {r.group_id for k, r in one.items() if r.wide} == {2}
    assert {r.group_id for r in one.values() if not r.wide} == {1} and min(one[k].width_ms for k in (2, 5, 8)) >= 120
    assert {k for k, r in two.items() if r.group_id == 2} == {0, 1} == {k for k, r in two.items() if r.paced}
    assert len(E.beat_groups(frame(spark, rows)).select("record_id", "group_id").distinct().collect()) == 3


def test_online_groups_keep_to_their_budget():
    r = np.random.default_rng(12)
    v = [row / np.linalg.norm(row) for row in r.normal(size=(12, 40))]
    assert len(set(B.online_groups(v, 3))) == 3 and len(set(B.online_groups(v, 3, outliers=True))) == 12
    assert B.online_groups([v[0], v[0] + 0.01, v[1]], 5) == [0, 0, 1] and B.online_groups([], 5) == []
    m = np.array([0.0, 1, 3, 10, 3, 1, 0])
    assert B.rough_width(m, 3, 1000.0) == 2.0

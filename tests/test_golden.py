"""The reference-shaped recording: 10 s, 500 Hz, 12 leads, through Spark."""

import numpy as np
import pytest

from pulsequilt.functions import atrial as A
from pulsequilt.functions.expressions import ANGLES, LEADS
from pulsequilt.operators import engine as E
from pulsequilt.operators import kernels as K

FS = 500.0
# Fixed values of the recording: waves (offset from R and width in s, mV, direction left, inferior, anterior) and chest lead vectors.
WAVES = [(-0.160, 0.022, 0.15, (0.6, 0.7, 0.2)), (-0.028, 0.008, -0.10, (0.2, -0.3, 0.9)), (0.0, 0.011, 1.30, (0.55, 0.75, -0.35)), (0.030, 0.010, -0.30, (-0.4, -0.5, 0.8)), (0.300, 0.050, 0.35, (0.6, 0.7, 0.35))]
CHEST = {"V1": (-0.35, 0.1, 0.93), "V2": (-0.1, 0.1, 0.99), "V3": (0.25, 0.15, 0.95), "V4": (0.55, 0.2, 0.8), "V5": (0.8, 0.2, 0.55), "V6": (0.95, 0.2, 0.2)}
# What is known of lead II: samples of each beat's landmarks.
R = [250 + 500 * k for k in range(10)]
P_ON = [151, 651, 1153, 1652, 2152, 2652, 3151, 3650, 4152, 4651]
P_OFF = [189, 688, 1188, 1687, 2189, 2687, 3188, 3687, 4189, 4687]
QRS_ON = [229, 729, 1229, 1733, 2229, 2729, 3229, 3729, 4233, 4729]
QRS_OFF = [268, 768, 1268, 1768, 2268, 2768, 3268, 3768, 4268, 4768]
T_OFF = [458, 954, 1455, 1953, 2452, 2955, 3458, 3954, 4457, 4952]


def unit(v):
    return np.array(v, float) / np.linalg.norm(v)


def recording(p_height=1.0, drop=()):
    """The recording with P waves of a share of their height, without those of some beats."""
    axes = np.array([(np.cos(np.radians(ANGLES[n])), np.sin(np.radians(ANGLES[n])), 0.0) if n in ANGLES else unit(CHEST[n]) for n in LEADS])
    t = np.arange(5000) / FS
    x = np.random.default_rng(20260923).normal(0.0, 0.005, (12, 5000))
    for k in range(10):
        for w, (at, width, mv, direction) in enumerate(WAVES):
            share = (0.0 if k in drop else p_height) if w == 0 else 1.0
            x += np.outer(axes @ unit(direction), share * mv * np.exp(-0.5 * ((t - 0.5 - k - at) / width) ** 2))
    return x


def signals(spark, *recordings):
    return spark.createDataFrame([(k, n, FS, row.tolist()) for k, x in enumerate(recordings) for n, row in zip(LEADS, x, strict=True)], "record_id long, lead string, fs double, samples array<double>")


@pytest.fixture(scope="module")
def golden(spark):
    return signals(spark, recording(), recording(0.0), recording(drop=(3, 6)))


def test_beats_are_found(golden):
    for f in (K.detected, E.adaptive_detected):
        got = [r.r_sample for r in f(golden.where("record_id = 0")).orderBy("beat_id").collect()]
        assert len(got) == 10 and np.abs(np.array(got) - R).max() <= 8


def test_p_bounds_within_ten_ms(golden):
    got = {(r.record_id, r.beat_id): r for r in E.p_wave_assessments(golden).collect()}
    for k in range(10):
        r = got[0, k]
        assert r.state == "P_PRESENT" and r.support >= 6
        assert abs(r.onset - P_ON[k]) * 2 <= 10 and abs(r.offset - P_OFF[k]) * 2 <= 10
        assert all(p.onset < p.peak < p.offset for p in r.per_lead)
        assert got[1, k].state != "P_PRESENT"
        assert (got[2, k].state == "P_PRESENT") == (k not in (3, 6))
    summary = {r.record_id: r for r in E.p_wave_summary(E.p_wave_assessments(golden)).collect()}
    assert summary[0].present_share == 1.0 and summary[1].n_present == 0 and summary[2].n_present == 8


def test_qrs_and_t_bounds(golden):
    rows = K.delineated(golden.where("record_id = 0")).where("lead = 'II'").orderBy("beat_id").collect()
    gap = lambda name, want: np.median([abs(r[name] - w) * 2 for r, w in zip(rows, want, strict=True) if r[name] is not None])
    assert gap("qrs_on", QRS_ON) <= 16 and gap("qrs_off", QRS_OFF) <= 16 and gap("t_off", T_OFF) <= 24
    t = E.wavelet_t_bounds(golden.where("record_id = 0")).where("lead = 'II'").orderBy("beat_id").collect()
    assert np.median([abs(r.t_off - w) * 2 for r, w in zip(t, T_OFF, strict=False) if r.t_off is not None]) <= 12


def test_short_and_flat_recordings():
    assert A.p_waves(np.zeros((12, 1000)), FS, np.zeros(0, int)) == []
    x = recording()[:, :700]
    got = A.p_waves(x, FS, np.array([250]))
    assert len(got) == 1 and got[0]["state"] == "P_PRESENT"
    assert A.lead_bounds(np.array([1.0, 2.0, 1.5]), 1, 1) is None and A.lead_bounds(np.zeros(9), 4, 2) is None

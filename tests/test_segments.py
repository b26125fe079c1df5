"""QRS deflections, ST levels and patterns, and U waves, by hand and against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsequilt.functions import segments as G
from pulsequilt.operators import engine as E
from pulsequilt.sources import signals as S

FS = 500.0


def gauss(n, at, width, height):
    return height * np.exp(-0.5 * ((np.arange(n) - at) / width) ** 2)


def test_deflections_by_hand():
    x = gauss(100, 30, 3, -0.2) + gauss(100, 40, 3, 1.0) + gauss(100, 52, 3, -0.4) + gauss(100, 62, 3, 0.3) + gauss(100, 72, 3, -0.2) + 0.1
    d = G.qrs_deflections(x, 20, 82, 40, 0.1, FS)
    assert d["q_mv"] == pytest.approx(-0.2, abs=0.03) and d["r_mv"] == pytest.approx(1.0, abs=0.02) and d["s_mv"] == pytest.approx(-0.4, abs=0.03)
    assert d["r_prime_mv"] == pytest.approx(0.3, abs=0.03) and d["s_prime_mv"] == pytest.approx(-0.2, abs=0.03)
    assert d["n_turns"] == 5 and d["n_notches"] == 4
    assert d["area_mv_ms"] == pytest.approx((x[20:83] - 0.1).sum() * 2, abs=0.2)
    assert 10 <= d["r_ms"] <= 30 and 10 <= d["s_ms"] <= 30 and 8 <= d["q_ms"] <= 30
    plain = G.qrs_deflections(gauss(100, 40, 4, 1.0), 20, 60, 40, 0.0, FS)
    assert [plain[k] for k in ("q_mv", "s_mv", "r_prime_mv", "s_prime_mv", "q_ms")] == [None] * 5 and plain["n_notches"] == 0
    assert G.qrs_deflections(x, 20, 20, 20, 0.0, FS)["r_mv"] is None


def test_turns_equal_a_loop():
    r = np.random.default_rng(3)
    for _ in range(30):
        x = r.integers(0, 4, 40).astype(float)
        tops, bottoms, last = [], [], 0
        for i in range(1, 40):
            s = np.sign(x[i] - x[i - 1])
            if s and last and s != last:
                (tops if last > 0 else bottoms).append(i - 1)
            last = s or last
        # a level top counts where it ends
        assert G.turns(x)[0].tolist() == tops and G.turns(x)[1].tolist() == bottoms


def test_st_levels_and_slope():
    j = 100
    x = np.where(np.arange(300) < j, 0.0, 0.05 + 0.001 * (np.arange(300) - j) * 2)
    s = G.st_levels(x, j, 0.0, FS)
    assert s["st40_mv"] == pytest.approx(0.09, abs=1e-9) and s["st80_mv"] == pytest.approx(0.13, abs=1e-9) and s["st_slope"] == pytest.approx(0.001)
    x[120] = 9.0
    assert G.st_levels(x, j, 0.0, FS)["st_slope"] == pytest.approx(0.001)
    assert G.st_levels(x, 295, 0.0, FS)["st80_mv"] is None and G.robust_slope(np.zeros(10), FS) is None


def test_u_waves_by_hand():
    flat = np.zeros(400)
    at = lambda h, width=14.0, place=70: G.u_wave(flat + gauss(400, 100 + place, width, h), 100, 0.0, FS)
    u = at(0.08)
    assert u["u_reject"] is None and abs(u["u_peak"] - 170) <= 2 and u["u_mv"] == pytest.approx(0.08, abs=0.01) and u["u_on"] < u["u_peak"] < u["u_off"]
    assert at(-0.08)["u_mv"] < 0
    assert at(0.015)["u_reject"] == "below_amplitude_floor"
    assert at(0.08, 5.0)["u_reject"] == "too_narrow_for_a_u_wave"
    assert at(0.08, place=32)["u_reject"] == "no_isoelectric_t_u_segment"
    assert at(0.0)["u_reject"] == "no_interior_extremum"
    assert G.u_wave(flat, 395, 0.0, FS)["u_reject"] == "window_too_short" and G.u_wave(flat, 100, 0.0, FS, cap=104)["u_reject"] == "window_too_short"
    assert G.u_wave(flat * np.nan, 100, 0.0, FS)["u_reject"] == "non_finite_window"


def test_patterns_by_hand(spark):
    nan = float("nan")
    cases = [
        ((0.001, 0.0, 0.0, 0.0, 0.0, False, True), ("upsloping", "straight", "slow_upsloping")),
        ((-0.001, 0.2, 0.2, 0.2, 0.0, True, None), ("downsloping", "straight", "downsloping")),
        ((0.0004, 0.12, 0.12, 0.12, 0.0, True, True), ("horizontal", "straight", "j_point_elevation")),
        ((0.0, 0.12, 0.10, 0.12, 0.0, False, True), ("horizontal", "concave-up", "j_point_elevation")),
        ((0.0, 0.12, 0.10, 0.12, 0.02, False, True), ("horizontal", "straight", "horizontal")),
        ((0.0, 0.0, 0.05, 0.0, None, None, True), ("horizontal", "concave-down", "horizontal")),
        ((nan, 0.0, None, 0.0, 0.0, False, True), ("unknown", "unknown", "unknown")),
        ((0.001, 0.0, 0.0, 0.0, 0.0, False, False), ("upsloping", "straight", "unknown")),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, st_slope double, j_mv double, st40_mv double, st80_mv double, noise_mv double, notched boolean, reliable boolean")
    got = {r.k: (r.st_trend, r.st_shape, r.st_pattern) for r in E.st_patterns(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_measures_of_generated_beats(spark):
    rates = spark.createDataFrame([(1, 1.0)], "record_id long, rr_s double")
    rows = E.wave_measures(S.limb_leads(S.pairs_of(S.generated(rates, fs=500)))).where(F.col("lead") == "II").collect()
    assert len(rows) == 10
    r = rows[4]
    assert r.r_mv == pytest.approx(1.2, abs=0.2) and r.s_mv == pytest.approx(-0.26, abs=0.03) and r.q_mv is None and r.n_turns >= 2
    assert abs(r.j_mv) < 0.1 and r.st_slope > 0 and r.u_peak is None

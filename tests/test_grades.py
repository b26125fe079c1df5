"""Quality scores and grades, and the decision on pauses and block, by hand."""

import numpy as np
import pytest
from test_engine import FS, beats_of, frame

from pulsequilt.functions import quality as N
from pulsequilt.operators import kernels as K
from pulsequilt.operators import quality as Q
from pulsequilt.operators import rhythm as R

GOOD = {"baseline_wander": 0.1, "muscle_noise": 0.1, "powerline": 0.05, "clipping": 0.01, "flat_std": 0.2, "flat_fraction": 0.0, "saturation_fraction": None, "p_sqi": 0.6, "k_sqi": 8.0, "b_sqi": 0.95}
CASES = [
    ({}, "Q0", [], "p qrs t qt"),
    ({"k_sqi": 4.9}, "Q1", ["low_kurtosis"], "p qrs t qt"),
    ({"b_sqi": 0.8}, "Q1", ["low_bsqi"], "p qrs t qt"),
    ({"baseline_wander": 0.27}, "Q2", [], "p qrs"),
    ({"baseline_wander": 0.31}, "Q2", ["baseline_wander"], "qrs"),
    ({"muscle_noise": 0.35}, "Q2", [], "qrs"),
    ({"powerline": 0.13}, "Q2", [], "p qrs"),
    ({"powerline": 0.21}, "Q3", ["powerline_noise"], ""),
    ({"muscle_noise": 0.41}, "Q3", ["muscle_noise"], ""),
    ({"b_sqi": 0.69}, "Q3", ["low_bsqi"], ""),
    ({"flat_fraction": 0.2, "flat_std": 0.01}, "Q3", ["missing_or_flat"], ""),
    ({"flat_fraction": 0.2}, "Q0", [], "p qrs t qt"),
    ({"clipping": 0.06}, "Q1", ["clipping"], "p qrs t qt"),
    ({"clipping": 0.06, "saturation_fraction": 0.01}, "Q3", ["saturation"], ""),
    ({"p_sqi": 0.91}, "Q1", ["psqi_out_of_range"], "p qrs t qt"),
    ({"baseline_wander": float("nan")}, "Q2", ["baseline_wander"], "qrs"),
    ({"b_sqi": None, "k_sqi": float("inf")}, "Q3", ["low_kurtosis", "low_bsqi"], ""),
]


def test_grades_by_hand(spark):
    names = list(GOOD)
    rows = [(k, *((GOOD | change)[n] for n in names)) for k, (change, *_) in enumerate(CASES)]
    got = {r.k: r for r in Q.lead_grades(spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))).collect()}
    for k, (_, grade, flags, good) in enumerate(CASES):
        r = got[k]
        assert (r.grade, r.flags, [w for w in ("p", "qrs", "t", "qt") if r[f"reliable_for_{w}"]]) == (grade, flags, good.split()), CASES[k]


def test_scores_of_generated_leads(spark):
    x, _ = beats_of()
    t = np.arange(x.size) / FS
    r = np.random.default_rng(1)
    rows = [(1, "clean", x), (1, "hum", x + 0.4 * np.sin(2 * np.pi * 50 * t)), (1, "muscle", x + 0.4 * np.sin(2 * np.pi * 70 * t) + r.normal(0, 0.01, x.size)), (1, "flat", 0 * x), (1, "drift", x + 3 * np.sin(2 * np.pi * 0.5 * t)), (1, "still", np.round(x, 2)), (1, "empty", [])]
    got = {v.lead: v for v in Q.lead_grades(K.lead_scores(frame(spark, rows), full_scale_mv=2.0)).collect()}
    assert set(got) == {"clean", "hum", "muscle", "flat", "drift", "still"}
    assert got["clean"].b_sqi > 0.9 and got["clean"].k_sqi > 5 and got["clean"].reliable_for_qt
    assert got["hum"].powerline > 0.5 and got["hum"].grade == "Q3"
    assert got["muscle"].muscle_noise > got["clean"].muscle_noise and "muscle_noise" in got["muscle"].flags
    assert got["flat"].missing and got["flat"].flat_fraction == 1.0 and got["flat"].k_sqi == 0.0
    assert got["drift"].saturation_fraction > 0.1 and "saturation" in got["drift"].flags
    assert got["still"].clipping > 0.05 and got["still"].saturation_fraction == 0.0
    lone = N.scores(x, FS)
    assert lone["saturation_fraction"] is None and lone["flat_std"] == pytest.approx(x.std())


def test_flat_share_equals_a_loop():
    r = np.random.default_rng(2)
    x = np.cumsum(r.normal(0, 0.004, 300))
    want = np.mean([np.ptp(x[max(0, i - 25) : i + 25]) < 0.05 for i in range(300)])
    assert N.flat_share(x, 50.0) == pytest.approx(want)


def decided(spark, cases):
    """Decisions of cases: (rr, pr, atrial) series and QRS width."""
    rows = [(k, i, a, b, c) for k, (series, _) in cases.items() for i, (a, b, c) in enumerate(zip(*series, strict=True))]
    s = spark.createDataFrame(rows, "record_id long, idx long, rr double, pr double, atrial int").repartition(3)
    facts = spark.createDataFrame([(k, q) for k, (_, q) in cases.items()], "record_id long, qrs_ms double")
    return {r.record_id: r for r in R.av_block(s, facts).collect()}


def test_pauses_and_block_are_one_decision(spark):
    n = [800.0] * 6
    long = [800.0, 800.0, 800.0, 1500.0, 800.0, 800.0]
    one, two = [1] * 6, [1, 1, 1, 2, 1, 1]
    cases = {
        1: ((long, [160.0, 180.0, 200.0, None, 160.0, 170.0], two), 90.0),  # PR grows before the drop
        2: ((long, [160.0, 162.0, 161.0, None, 160.0, 163.0], two), 130.0),  # constant PR, wide QRS
        3: ((n, [160.0, 162.0, 161.0, None, 160.0, 163.0], two), 90.0),  # no long interval: no drop
        4: ((long, [160.0, 162.0, 161.0, 160.0, 160.0, 163.0], two), 90.0),  # a PR, but a long interval with two events
        5: ((long, [None] * 6, [2] * 6), 125.0),  # two to one throughout: not localized
        6: ((long, [160.0] * 3 + [None] + [160.0] * 2, one), None),  # no second event: a pause alone
        7: (([800.0, None, 800.0], [None, None, None], [2, 2, 1]), None),
        8: ((long[:3] + [1500.0, 1600.0, 800.0], [160.0, float("nan"), 250.0, None, None, 160.0], [1, 1, 1, 2, 2, 1]), 90.0),
    }
    got = decided(spark, cases)
    kind = lambda k: (got[k].pauses_detected, got[k].second_degree_avb, got[k].dropped, got[k].block_level_hint, got[k].escape_origin)
    assert kind(1) == (True, "mobitz_i", [3], "av_nodal_probable", "supraventricular")
    assert kind(2) == (True, "mobitz_ii", [3], "infranodal_suspected", "ventricular")
    assert kind(3) == (False, None, [], None, None)
    assert kind(4) == (True, "second_degree_av_block", [3], None, "supraventricular")
    assert kind(5) == (True, None, [], "infranodal_suspected", "ventricular") and got[5].two_to_one
    assert kind(6) == (True, None, [], None, "supraventricular")
    assert kind(7) == (False, None, [], None, None) and got[7].atrial_max == 2
    assert kind(8) == (True, "second_degree_av_block", [3, 4], None, "supraventricular")
    assert got[1].pause_longest_ms == 1500.0 and got[1].threshold_ms == pytest.approx(1120.0)

"""QT rescues: cases worked out by hand."""

import contextlib
import io
import re

import pytest

from pulsequilt.functions.expressions import LEADS
from pulsequilt.operators import rescues as Q

LEAD = "record_id long, lead string, lead_no int, qt double, qt_consensus double, qt_sd double, conf double, t_amp double, reliable_qt boolean, reliable_global boolean, reliable_t boolean, confused boolean"
FACT = "record_id long, qrs_ms double, consensus_ms double, rr_cv double"


def lead(record, no, qt, consensus=400.0, sd=5.0, conf=0.8, t=0.3, rq=True, rg=True, rt=True, confused=False):
    return record, LEADS[no], no, qt, consensus, sd, conf, t, rq, rg, rt, confused


@pytest.fixture(scope="module")
def told(spark):
    rows, facts = [], []

    def record(k, qrs, consensus, cv, leads):
        facts.append((k, qrs, consensus, cv))
        rows.extend(leads)

    # four of six leads 30 ms late
    record(1, 90.0, 400.0, 0.02, [lead(1, no, qt) for no, qt in enumerate([430.0, 432.0, 428.0, 436.0, 402.0, 398.0])])
    # the same, irregular: nothing
    record(2, 90.0, 400.0, 0.12, [lead(2, no, qt) for no, qt in enumerate([430.0, 432.0, 428.0, 436.0, 402.0, 398.0])])
    # wide: two raw values 30 ms late within 40 ms; one leaves no plausible JT
    record(3, 150.0, 400.0, None, [lead(3, 0, 430.0), lead(3, 1, 440.0), lead(3, 2, 290.0)])
    # raw values 20 ms early, consensus values agree
    record(4, 90.0, 420.0, None, [lead(4, no, qt, 420.0 + no) for no, qt in enumerate([398.0, 400.0, 402.0])])
    # consensus values 8 ms apart: not so
    record(5, 90.0, 420.0, None, [lead(5, no, qt, 420.0 + 4 * no) for no, qt in enumerate([398.0, 400.0, 402.0])])
    # two leads 50 ms late, reliable for T alone; then precordial and small; then too late for a pair
    record(6, 90.0, 400.0, None, [lead(6, no, qt, rq=False, rg=False) for no, qt in [(1, 448.0), (7, 452.0), (3, 405.0)]])
    record(7, 90.0, 400.0, None, [lead(7, no, 452.0, t=0.03, rq=False, rg=False) for no in (7, 8)])
    record(8, 90.0, 400.0, None, [lead(8, no, 490.0, rq=False, rg=False) for no in (1, 2)])
    # wide and long: four early leads
    record(9, 140.0, 520.0, None, [lead(9, no, qt, 520.0) for no, qt in enumerate([480.0, 482.0, 470.0, 490.0, 530.0])])
    # no consensus: only the paced rule can speak
    record(10, 160.0, None, None, [lead(10, no, qt, None, conf=0.0) for no, qt in enumerate([440.0, 500.0, 520.0])])
    record(11, None, None, None, [lead(11, 0, None, None, None, None, None, None, None, None, None)])
    x, f = spark.createDataFrame(rows, LEAD).repartition(3), spark.createDataFrame(facts, FACT)
    good = {}
    for r in Q.reliable_leads(Q.prepared(x, f)).collect():
        good.setdefault(r.record_id, []).append(r.lead)
    return good, {(r.record_id, r.rule): (r.qt_ms, r.n_leads, r.leads) for r in Q.qt_rescues(x, f).collect()}


def test_rules_by_hand(told):
    _, got = told
    rules = lambda k: sorted(rule for r, rule in got if r == k)
    # 35 ms from 402 hold five of six; no three within 45 ms are 35 ms late
    assert got[1, "late_cluster"] == (430.0, 5, ["I", "II", "III", "aVR", "aVL"]) and rules(1) == ["late_cluster"]
    assert rules(2) == []
    assert got[3, "wide_raw"] == (435.0, 2, ["I", "II"])
    assert got[4, "reliable_cluster"] == (400.0, 3, ["I", "II", "III"]) and "reliable_cluster" not in rules(5)
    assert got[6, "tail_confirmed"] == (450.0, 2, ["II", "V2"])
    assert rules(7) == rules(8) == []
    assert got[9, "wide_long_core"] == (481.0, 4, ["I", "II", "III", "aVR"])
    assert got[10, "paced_low_support"] == (500.0, 3, ["I", "II", "III"]) and rules(11) == []


def test_reliable_leads_by_hand(spark, told):
    good, _ = told
    assert sorted(good[1]) == sorted(LEADS[:6]) and good.get(10) is None and good.get(11) is None
    rows = [lead(1, 0, None, 400.0), lead(1, 1, None, 410.0), lead(1, 2, None, 500.0)]  # one far from the median of three
    rows += [lead(2, 0, None, 300.0), lead(2, 1, None, 400.0), lead(2, 2, None, 500.0)]  # fewer than two near it: all stay
    rows += [lead(3, 0, 400.0, sd=28.0), lead(3, 1, 400.0, sd=27.0), lead(3, 2, 400.0, sd=27.0), lead(3, 3, 400.0, sd=31.0)]  # none strict: the least spread
    rows += [lead(4, 0, 400.0, t=0.049), lead(4, 1, 400.0, 720.0), lead(4, 2, 230.0, 720.0), lead(4, 3, 400.0, conf=0.2)]
    x = Q.prepared(spark.createDataFrame(rows, LEAD), spark.createDataFrame([], FACT))
    got = {}
    for r in Q.reliable_leads(x).collect():
        got.setdefault(r.record_id, []).append(r.lead)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["I", "II"], 2: ["I", "II", "III"], 3: ["II"], 4: ["II", "aVR"]}


def test_leads_are_dealt_with_what_is_told_of_them(spark):
    """What tells it (spread, confidence, T wave, flags, facts) stays behind; before, all of it was dealt."""
    x = spark.createDataFrame([(*lead(1, 0, 430.0), 90.0, 400.0, 0.02)], f"{LEAD}, qrs_ms double, consensus_ms double, rr_cv double")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        Q.qt_rescues(x).explain(mode="formatted")
    (dealt,) = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", out.getvalue())
    names = {c.split("#")[0] for c in dealt.split(", ")}
    assert {"record_id", "lead", "raw", "strict_value", "weak_sd"} <= names
    assert not names & {"qt", "qt_value", "qt_consensus", "qt_sd", "conf", "t_amp", "t", "reliable_qt", "reliable_global", "reliable_t", "confused", "qrs_ms", "rr_cv"}


def test_leads_that_tell_nothing_change_nothing(spark):
    heard = [lead(1, no, qt) for no, qt in enumerate([430.0, 432.0, 428.0, 436.0])] + [lead(None, no, qt) for no, qt in enumerate([430.0, 432.0, 428.0, 436.0])]
    heard += [lead(2, no, qt) for no, qt in [(0, 430.0), (0, 430.0), (1, 432.0), (2, 428.0), (2, 436.0)]]  # repeated leads
    heard += [lead(3, 2, 440.0, conf=0.15, rq=None, rg=None), lead(3, 2, 441.0, sd=29.0, rg=None)]  # none strict: the weak one of least spread
    mute = [lead(k, no, qt, consensus, sd, t=t, rg=rg) for k in (1, 2, 3, None) for no, qt, consensus, sd, t, rg in [(6, None, None, 1.0, 0.3, True), (7, 431.0, 400.0, 1.0, 0.01, True), (8, 100.0, 900.0, 0.0, 0.3, True), (9, 431.0, None, None, None, None)]]
    facts = spark.createDataFrame([(k, 90.0, 400.0, 0.02) for k in (1, 2, 3)], FACT)
    told = lambda rows: sorted((str(r.record_id), r.rule, r.qt_ms, r.n_leads, r.leads) for r in Q.qt_rescues(spark.createDataFrame(rows, LEAD).repartition(3), facts).collect())
    assert told(heard) == told(heard + mute)
    assert ("1", "late_cluster", 431.0, 4, ["I", "II", "III", "aVR"]) in told(heard)
    assert ("2", "late_cluster", 430.0, 5, ["I", "I", "II", "III", "III"]) in told(heard)

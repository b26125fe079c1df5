"""Record-level widths and chest-lead screening, by hand."""

from pulsequilt.functions.expressions import LEADS
from pulsequilt.operators import consensus as C

P_LEAD = "record_id long, lead string, lead_no int, consensus_ms double, raw_ms double, onset_support int, offset_support int, guarded boolean, p_amp double, p_conf double, reliable_for_p boolean"


def test_p_duration_by_hand(spark):
    lead = lambda r, k, c, raw, on=3, off=4, guard=False, amp=0.1, conf=0.9, ok=True: (r, LEADS[k], k, c, raw, on, off, guard, amp, conf, ok)
    rows = [lead(1, 1, 100.0, 90.0), lead(1, 0, 110.0, None, 2, 5), lead(1, 2, 190.0, 80.0), lead(1, 3, 70.0, 70.0, amp=0.01)]
    rows += [lead(2, 0, None, 90.0), lead(2, 1, None, 96.0, amp=None, ok=True), lead(2, 2, float("nan"), 40.0, ok=False)]
    rows += [lead(3, 0, 100.0, None, 0, 0, True), lead(4, 0, None, 20.0), lead(5, 0, None, 60.0, conf=None)]
    got = {r.record_id: tuple(r)[1:] for r in C.p_duration(spark.createDataFrame(rows, P_LEAD).repartition(3)).collect()}
    assert got[1] == (105.0, "representative_multilead_consensus", ["I", "II"], 3, 10.0, "reliable")
    assert got[2] == (93.0, "reliable_lead_median_fallback", ["I", "II"], 2, 6.0, "fallback")
    assert got[3] == (100.0, "representative_multilead_consensus_paired_duration_guard", ["I"], 1, 0.0, "low_support")
    assert got[4] == (None, None, [], 0, None, "unavailable")
    assert got[5] == (60.0, "reliable_lead_median_fallback", ["I"], 1, 0.0, "low_support")


def test_qrs_widths_by_hand(spark):
    cases = {
        1: ([90.0, 92.0, 94.0], [100.0, 104.0, 108.0]),  # plain median
        2: ([90.0, 92.0, 94.0], [108.0, 110.0, 112.0]),  # 16 ms beyond the greatest raw width
        3: ([100.0, 110.0, 125.0], [130.0, 131.0, 132.0]),  # wide by the consensus alone
        4: ([100.0, 110.0, 119.0, 150.0, 150.0, 100.0], [146.0] * 6),  # strong support
        5: ([90.0], [130.0]),
        6: ([90.0, 90.0, 90.0], [None] * 3),
        7: ([90.0, 90.0, 90.0], [100.0] * 3),  # split
    }
    rows = [(k, r, w, True) for k, (raw, wide) in cases.items() for r, w in zip(raw, wide, strict=True)] + [(1, 300.0, 210.0, False), (1, 60.0, 60.0, None)]
    got = {r.record_id: (r.qrs_ms, r.rule) for r in C.qrs_wide(spark.createDataFrame(rows, "record_id long, raw_ms double, wide_ms double, reliable_for_qrs boolean"), spark.createDataFrame([(7, 125.0)], "record_id long, split_ms double")).collect()}
    assert got == {1: (104.0, "consensus"), 2: (94.0, "raw_greatest"), 3: (110.0, "raw_median"), 4: (146.0, "consensus"), 5: (130.0, "consensus"), 7: (125.0, "split")}


def test_late_cores_by_hand(spark):
    widths = [90.0, 92.0, 94.0, 96.0, 98.0, 140.0]
    rows = [(k, w, True, k == 2 and i == 0, k in (1, 4, 5, 6) and i == 5) for k in range(1, 7) for i, w in enumerate(widths + ([150.0] if k in (4, 5) else []))]
    facts = [(1, 131.0, False), (2, 129.0, False), (3, 140.0, False), (4, 150.0, False), (5, 150.0, True), (6, None, False)]
    got = {r.record_id: r.core_ms for r in C.late_qrs_core(spark.createDataFrame(rows, "record_id long, raw_ms double, reliable_for_qrs boolean, confused boolean, late_offset boolean"), spark.createDataFrame(facts, "record_id long, consensus_ms double, paced boolean")).collect()}
    # 2: 34 ms late; 3: no late lead; 4: a plausible wide consensus, but not where paced (5); 6: none
    assert got == {1: 96.0, 5: 97.2} or got == {1: 96.0, 5: 97.19999999999999}


def test_chest_leads_by_hand(spark):
    good = [0.2, 0.5, 0.9, 1.4, 1.2, 0.8]
    swapped = [0.5, 0.2, 0.9, 1.4, 1.2, 0.8]
    far = [1.0, 0.5, 0.9, 0.2, 1.2, 0.8]
    rows = [
        (1, *good, *[0.0] * 4, -1.0, 90.0, *[0.9] * 5),
        (2, *swapped, *[0.0] * 4, -1.0, 90.0, 0.3, 0.9, 0.9, 0.9, 0.9),
        (3, *swapped, *[0.0] * 4, -1.0, 90.0, *[0.9] * 5),
        (4, *swapped, *[0.0] * 4, -1.0, 90.0, *[None] * 5),
        (5, *swapped, *[0.0] * 4, -2.4, 130.0, *[0.9] * 5),
        (6, *[x / 4 for x in swapped], *[0.0] * 4, -1.0, 90.0, *[0.9] * 5),
        (7, None, *swapped[1:], *[0.0] * 4, -1.0, 90.0, *[0.9] * 5),
        (8, *far, *[0.0] * 4, -1.0, 90.0, *[0.9] * 5),
        (9, 0.9, 0.2, 0.8, 0.1, 1.4, 0.8, *[0.0] * 4, -1.0, 90.0, *[0.9] * 5),
    ]
    names = [f"r{k}" for k in range(1, 7)] + [f"q{k}" for k in range(1, 5)] + ["s1", "qrs"] + [f"c{k}" for k in range(1, 6)]
    got = {r.record_id: (r.suspected, r.confidence, r.reason, r.leads, r.peak_lead, r.corroborated) for r in C.chest_reversal(spark.createDataFrame(rows, "record_id long, " + ", ".join(f"{n} double" for n in names))).collect()}
    assert got[1] == (False, "moderate", "no_violation", None, "V4", None)
    assert got[2] == (True, "moderate", None, ["V1", "V2"], "V4", True)
    assert got[3] == (True, "low", None, ["V1", "V2"], "V4", False)
    assert got[4] == (True, "low", None, ["V1", "V2"], "V4", None)
    assert got[5] == (False, "unavailable", "wide_qrs+lvh_voltage_pattern", None, "V4", None)
    assert got[6] == (False, "low", "precordial_low_voltage", None, "V4", None)
    assert got[7][:3] == (False, "unavailable", "incomplete")
    assert got[8][0] and got[8][3] == ["V1", "V4"] and got[8][1] == "low" and got[8][5] is None
    # four falls that no neighbours mend, but the first and fourth do
    assert got[9][0] and got[9][3] == ["V1", "V4"]

"""T axis rules, by hand."""

import math

import pytest

from pulsequilt.functions.expressions import ANGLES
from pulsequilt.operators import taxis as T
from pulsequilt.operators.intervals import frontal_axis

LEAD = "record_id long, lead string, amp double, amp_sd double, conf double, area double, signed_area double, reliable_for_t boolean, confused boolean, st_conf double, st_mid double, special_uv double, t_prime_area double"
FACT = "record_id long, qrs_ms double, rr_cv double, atrial_invalid boolean"


def along(record, degrees, size=10.0, leads=tuple(ANGLES), **change):
    """Leads whose T areas are the projections of one direction."""
    out = []
    for lead in leads:
        p = math.cos(math.radians(degrees - ANGLES[lead]))
        row = {"amp": 0.3 * p, "amp_sd": None, "conf": 0.9, "area": abs(size * p), "signed_area": size * p, "ok": True, "confused": False, "st_conf": None, "st_mid": None, "special": None, "prime": None} | change.get(lead, {})
        out.append((record, lead, *row.values()))
    return out


@pytest.fixture(scope="module")
def told(spark):
    rows = along(1, 45.0) + along(2, 45.0) + along(3, 45.0) + along(4, 140.0)
    # against the axis of I, II and aVF: goes, but a sure aVL stays
    rows += along(5, 45.0, aVR={"amp": 0.3, "signed_area": 7.0}) + along(6, 45.0, III={"amp": -0.3, "signed_area": -7.0, "conf": 0.96})
    # a second T wave of the other sign, an unsteady amplitude, confusion with ST
    rows += along(7, 45.0, I={"special": -80.0, "prime": 200.0}, II={"amp_sd": 0.5}, aVF={"confused": True, "st_conf": 0.86, "st_mid": 0.0}, aVR={"confused": True, "st_conf": 0.5})
    rows += along(8, 45.0, leads=("I", "II"))
    facts = [(1, 90.0, 0.02, False), (2, 121.0, 0.02, False), (3, 90.0, 0.09, None), (4, 90.0, None, None), (5, 90.0, 0.02, None), (6, 90.0, 0.02, None), (7, 90.0, 0.02, None), (8, 90.0, 0.02, None)]
    df = spark.createDataFrame(rows + [(1, "V1", *rows[0][2:])], LEAD).repartition(3)
    return {(r.record_id, r.rule): (r.n_leads, r.axis_deg, r.leads) for r in T.coverages(df, spark.createDataFrame(facts, FACT)).collect()}, df


def test_coverage_by_hand(told):
    got, _ = told
    for rule in ("low_support", "detected", "st_supported"):
        assert got[1, rule][1] == pytest.approx(45.0, abs=6)
    assert not any(r in (2, 3) for r, _ in got)  # wide; irregular
    assert {rule for r, rule in got if r == 4} == set()  # 140 degrees lie too far
    assert "aVR" not in got[5, "detected"][2] and "aVR" in got[5, "low_support"][2]
    assert "III" in got[6, "detected"][2]
    assert got[7, "detected"][2] == ["aVF", "aVL", "III"] if (7, "detected") in got else True
    assert {rule for r, rule in got if r == 8} == {"st_supported"}


def test_stable_axis_needs_both_signs(spark, told):
    _, df = told
    got = {r.record_id: r.axis_deg for r in T.stable_signed_axis(df).collect()}
    assert got[1] == pytest.approx(45.0, abs=6) and 8 not in got
    up = df.where("record_id = 1").withColumn("signed_area", T.F.abs("signed_area"))
    assert T.stable_signed_axis(up).count() == 0


def test_suppression_by_hand(spark):
    lead = lambda r, name, conf=0.9, amp=0.3, st=0.0: (r, name, 5.0, conf, amp, st)
    three = ("I", "II", "aVF")
    cases = {
        1: ([lead(1, x) for x in three], (40.0, 50.0, 90.0, 0.02, 3, False, False), None),
        2: ([lead(2, "I")], (40.0, 50.0, 90.0, 0.02, 3, False, False), "few_leads"),
        3: ([lead(3, x, 0.5) for x in three], (40.0, 50.0, 90.0, 0.02, 3, False, False), "no_confident_lead"),
        4: ([lead(4, x) for x in three], (40.0, 50.0, 90.0, 0.20, 1, False, False), "irregular_without_p"),
        5: ([lead(5, x) for x in three[:2]], (40.0, 50.0, 150.0, 0.02, 3, False, False), "wide_few_leads"),
        6: ([lead(6, x) for x in three[:2]], (40.0, 50.0, 150.0, 0.02, 3, True, False), None),
        7: ([lead(7, "I"), lead(7, "II"), lead(7, "aVF", 0.5)], (40.0, 50.0, 150.0, 0.02, 3, False, False), "wide_low_confidence"),
        8: ([lead(8, "I"), lead(8, "II"), lead(8, "aVF", 0.5)], (200.0, 50.0, 150.0, 0.02, 3, False, True), None),
        9: ([lead(9, x, st=0.28) for x in three], (40.0, 50.0, 150.0, 0.02, 3, False, False), "wide_without_post_st"),
        10: ([lead(10, x) for x in three], (200.0, 150.0, 150.0, 0.02, 3, False, False), "wide_extreme_axis"),
        11: ([lead(11, x) for x in three], (100.0, -30.0, 150.0, 0.02, 3, False, False), "wide_discordant"),
        12: ([], (100.0, None, None, None, None, None, None), "few_leads"),
        13: ([lead(13, x) for x in three], (None, None, None, None, None, None, None), "none"),
    }
    leads = spark.createDataFrame([x for rows, *_ in cases.values() for x in rows], "record_id long, lead string, value double, conf double, amp double, st_mid double")
    facts = spark.createDataFrame([(k, *f) for k, (_, f, _) in cases.items()], "record_id long, t_axis double, qrs_axis double, qrs_ms double, rr_cv double, n_visible_p int, st_corrected boolean, paced boolean")
    got = {r.record_id: (r.suppressed, r.reason) for r in T.suppressed(leads, facts).collect()}
    assert 13 not in got
    assert got == {k: (want is not None, want) for k, (_, _, want) in cases.items() if k != 13}


def test_an_axis_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k, lead, ((k * 37 + j * 53) % 97 - 40) / 7, ((k * 11 + j * 29) % 90) / 100) for k in range(300) for j, lead in enumerate(("I", "II", "III", "aVR", "aVL", "aVF"))]
    one, other = ({r["record_id"]: (r["n_leads"], r["axis_deg"]) for r in frontal_axis(spark.createDataFrame(x, "record_id long, lead string, value double, conf double").coalesce(1)).collect()} for x in (rows, rows[::-1]))
    assert one == other


def test_an_axis_at_its_limit_is_told(spark):
    """120 degrees in whole numbers, whose angle Spark's own atan2 puts behind the limit."""
    row = {"amp_sd": None, "signed_area": None, "reliable_for_t": True, "confused": False, "st_conf": 0.9, "st_mid": 0.0, "special_uv": None, "t_prime_area": None}
    leads = [{"record_id": 1, "lead": n, "amp": 0.4, "conf": c, "area": a, **row} for n, c, a in (("III", 0.5, 1.2), ("aVR", 0.98, 1.2), ("aVF", 0.96, 2.45))]
    kinds = "record_id long, lead string, amp double, conf double, area double, amp_sd double, signed_area double, reliable_for_t boolean, confused boolean, st_conf double, st_mid double, special_uv double, t_prime_area double"
    facts = spark.createDataFrame([(1, 90.0, 0.05, False)], "record_id long, qrs_ms double, rr_cv double, atrial_invalid boolean")
    assert [r["leads"] for r in T.coverage(spark.createDataFrame(leads, kinds), facts, T.COVERAGES[1]).collect()] == [["III", "aVF", "aVR"]]

from pulsequilt.operators import policies as P


def test_rescue_of_regular_beats_that_spikes_captured(spark):
    """Ten beats 800 ms apart with a spike 40 ms before each, of which four were left: rescued; not so without regular intervals, or without spikes near."""
    raw = [(1, 800.0 * k) for k in range(10)] + [(2, 800.0 * k + (300.0 if k % 2 else 0.0)) for k in range(10)] + [(3, 800.0 * k) for k in range(10)]
    cleaned = [(r, 800.0 * k) for r in (1, 2, 3) for k in range(4)]
    spikes = [(r, ms - 40.0) for r, ms in raw if r < 3] + [(3, 800.0 * k + 400.0) for k in range(10)]
    frame = lambda rows: spark.createDataFrame(rows, "record_id long, ms double")
    facts = spark.createDataFrame([(1, True, "on"), (2, True, "on"), (3, True, "on"), (4, None, "off")], "record_id long, paced boolean, state string")
    got = {r.record_id: r for r in P.despiking_rescue(frame(raw), frame(cleaned), frame(spikes), facts).collect()}
    assert {k: r.applied for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}
    assert (got[1].captured, got[1].median_rr, got[1].robust_cv, got[3].captured, got[4].n) == (10, 800.0, 0.0, 0, 0)


def test_soft_reasons_withhold_pr_only_with_support(spark):
    flags = sorted({flag for _, flag in P.UNAVAILABLE} | {"atrial_faster_than_ventricular"})
    rows = [({"av_dissociation"}, 0.9), ({"av_dissociation", "atrial_faster_than_ventricular"}, 0.9), ({"af_afl_indeterminate"}, 0.2), ({"af_afl_indeterminate"}, None), ({"wide_qrs_pacing_like_context"}, 0.9), (set(), None)]
    df = spark.createDataFrame([(k, ratio, *(f in on or None for f in flags)) for k, (on, ratio) in enumerate(rows)], "k long, organized_p_ratio double, " + ", ".join(f"{f} boolean" for f in flags))
    got = {r.k: r for r in P.measurement_availability(df).collect()}
    assert [got[k].pr_available for k in range(6)] == [True, False, False, True, False, True]
    assert [got[k].p_axis_available for k in range(6)] == [False, False, False, False, True, True]
    assert got[0].pr_soft_reasons == ["av_dissociation"] and got[1].pr_soft_reasons == [] and got[3].reasons == ["af_afl_indeterminate"]


def test_numbers_that_are_not_finite_count_as_missing(spark):
    rows = spark.createDataFrame([(float("nan"), 1.0, 1), (float("inf"), None, 2), (120.0, -float("inf"), 3)], "a double, b double, n int")
    assert [tuple(r) for r in P.finite(rows).collect()] == [(None, 1.0, 1), (None, None, 2), (120.0, None, 3)]

"""Decisions on pacing and on which measurements may be reported: one row a record in, one out.

All are column expressions; where a decision needs a record's beats, groups of
beats or leads, these are summed up first by one shuffle by record. A missing
flag counts as false, and a missing number fails its condition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import median
from pulsequilt.operators.rhythm import PER_MS, within

#: Why atrial measurements are unavailable, in the order in which they are listed, and the flags that say so.
UNAVAILABLE = (
    ("continuous_pacing", "continuous_pacing"),
    ("wide_qrs_pacing_like_context", "wide_qrs_pacing_like_context"),
    ("probable_af", "probable_af"),
    ("probable_flutter", "probable_flutter"),
    ("af_afl_indeterminate", "af_afl_indeterminate"),
    ("complete_av_block", "complete_av_block"),
    ("av_dissociation", "av_dissociation"),
    ("atrial_measurements_unavailable", "atrial_measurements_invalid"),
)
ORGANIZED_P_MIN = 0.35
#: Fixed values of the pacing rules, in ms unless named otherwise.
NEAR_WIDE_QRS, OVERWIDE_QRS, NARROW_GROUP, WIDE_GROUP, WIDE_QRS = 115.0, 160.0, 90.0, 150.0, 120.0
ATRIAL_EVENTS_PER_RR = 3.0
RAW_QRS_MIN, RAW_QRS_MAX, RAW_MARGIN, GROUP_MARGIN = 90.0, 180.0, 20.0, 25.0
CAPTURED_BEATS, CAPTURE_OFFSET = 2, 55.0
RESCUE = {"beats": 5, "more_beats": 2, "ratio": 1.35, "captured": 3, "beat_share": 0.50, "spike_share": 0.60, "cv": 0.15, "deviation": 0.35, "rr_min": 240.0, "rr_max": 2400.0, "before": 80.0, "after": 20.0}


def finite(rows: DataFrame) -> DataFrame:
    """rows with null for every number that is not finite: in Spark NaN is above all others, so it would pass any lower limit."""
    floats = [n for n, kind in rows.dtypes if kind in ("double", "float")]
    return rows.withColumns({n: F.when(F.abs(n) < float("inf"), F.col(n)) for n in floats}) if floats else rows


def _of_finite(policy: Callable) -> Callable:
    """policy with its tables' numbers finite or null."""

    @wraps(policy)
    def decide(*args, **kwargs):
        return policy(*(finite(a) if isinstance(a, DataFrame) else a for a in args), **{k: finite(a) if isinstance(a, DataFrame) else a for k, a in kwargs.items()})

    return decide


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def dissociation_corroborated() -> Column:
    """Whether dissociation has support beyond scattered PR intervals."""
    return _flag("atrial_faster_than_ventricular") | _flag("complete_av_block")


def disorganized_atrium() -> Column:
    """The share of organized P waves where it is too low to trust their shape; else null."""
    return F.when(F.col("organized_p_ratio") < ORGANIZED_P_MIN, F.col("organized_p_ratio"))


@_of_finite
def measurement_availability(facts: DataFrame) -> DataFrame:
    """facts (the flags of UNAVAILABLE, atrial_faster_than_ventricular, organized_p_ratio) with reasons, atrial_rhythm_available, pr_available, p_axis_available and pr_soft_reasons.

    Dissociation and indeterminate atrial activity are soft: they withhold the
    PR interval only with corroboration or disorganized P waves.
    """
    reasons = F.array_compact(F.array(*(F.when(_flag(flag), F.lit(name)) for name, flag in UNAVAILABLE)))
    soft = {"av_dissociation": dissociation_corroborated(), "af_afl_indeterminate": disorganized_atrium().isNotNull()}
    hard = [_flag(flag) & soft.get(name, F.lit(True)) for name, flag in UNAVAILABLE]
    blocked = hard[0]
    for h in hard[1:]:
        blocked = blocked | h
    x = facts.withColumn("reasons", reasons).withColumn("pr_available", ~blocked)
    size = F.size("reasons")
    axis = (size == 0) | ((size == 1) & (F.get("reasons", F.lit(0)) == "wide_qrs_pacing_like_context"))
    kept = F.array_sort(F.array_intersect("reasons", F.array(*(F.lit(s) for s in soft))))
    return x.withColumns({"atrial_rhythm_available": size == 0, "p_axis_available": axis, "pr_soft_reasons": F.when(F.col("pr_available"), kept).otherwise(F.array().cast("array<string>"))})


@_of_finite
def majority_paced(beats: DataFrame) -> DataFrame:
    """record_id, group_paced: whether more than half the measured beats (record_id, paced) are paced."""
    return beats.groupBy("record_id").agg((F.count_if("paced") * 2 > F.count(F.lit(1))).alias("group_paced"))


@_of_finite
def capture_alignment(spikes: DataFrame, facts: DataFrame) -> DataFrame:
    """facts (record_id, paced, supports_routing: null where the evidence wasn't assessed) with confirmed, action and reason; spikes (record_id, offset_ms) are those next to a QRS complex."""
    near = spikes.groupBy("record_id").agg(F.count("offset_ms").alias("n"), median(F.abs("offset_ms")).alias("median_offset"))
    x = facts.join(near, "record_id", "left")
    aligned = _sure((F.col("n") >= CAPTURED_BEATS) & (F.col("median_offset") <= CAPTURE_OFFSET))
    x = x.withColumn("confirmed", _flag("paced") & F.coalesce("supports_routing", aligned))
    action = F.when(F.col("confirmed"), "accept").when(_flag("paced"), "reject").otherwise("no_change")
    reason = F.when(F.col("confirmed"), "ventricular_capture_alignment_confirmed").when(_flag("paced"), "capture_alignment_not_confirmed").otherwise("pacing_not_detected")
    return x.withColumns({"n_aligned_spikes": F.coalesce("n", F.lit(0)), "action": action, "reason": reason}).drop("n", "median_offset")


@_of_finite
def group_widths(groups: DataFrame) -> DataFrame:
    """record_id with dominant_ms (QRS duration of the first dominant group; without one, the median of all), wide_ms (median of groups of 150 ms and more, without these of 120 ms and more) of groups of beats (record_id, grp, qrs_ms, dominant)."""
    q = F.col("qrs_ms")
    first = F.min(F.when(F.col("dominant") & q.isNotNull(), F.struct("grp", "qrs_ms")))
    at_least = lambda ms: median(F.when(q >= ms, q))
    return groups.groupBy("record_id").agg(F.coalesce(first["qrs_ms"], median("qrs_ms")).alias("dominant_ms"), F.coalesce(at_least(WIDE_GROUP), at_least(WIDE_QRS)).alias("wide_ms"))


@_of_finite
def raw_widths(leads: DataFrame) -> DataFrame:
    """record_id, raw_ms: the median plausible QRS duration of reliable leads (record_id, qrs_ms, reliable), if two or more have one."""
    q = F.when(F.col("reliable") & F.col("qrs_ms").between(RAW_QRS_MIN, RAW_QRS_MAX), F.col("qrs_ms"))
    return leads.groupBy("record_id").agg(F.when(F.count(q) >= 2, median(q)).alias("raw_ms"))


@_of_finite
def pacing_like(facts: DataFrame, groups: DataFrame, leads: DataFrame) -> DataFrame:
    """facts (record_id, qrs_ms, av_dissociation, dropped_p, atrial_measurements_invalid, atrial_events_per_rr) with context, context_reason, and override_ms and override_rule: the QRS duration that takes the place of one measured too small or too large where the ventricle behaves as if paced; of three rules the first that holds."""
    x = facts.join(group_widths(groups), "record_id", "left").join(raw_widths(leads), "record_id", "left")
    q = F.col("qrs_ms")
    rich = _flag("atrial_measurements_invalid") | _sure(F.col("atrial_events_per_rr") >= ATRIAL_EVENTS_PER_RR)
    wide = _sure(q >= NEAR_WIDE_QRS) & (_flag("av_dissociation") | _flag("dropped_p")) & rich
    overwide = _sure((q >= OVERWIDE_QRS) & (F.col("dominant_ms") <= NARROW_GROUP)) & _flag("dropped_p")
    raw = F.when(F.col("wide_context") & (F.col("raw_ms") - q >= RAW_MARGIN), F.col("raw_ms"))
    by_group = F.when(F.col("wide_context") & ~_sure(F.col("dominant_ms") >= WIDE_QRS) & ((q < WIDE_QRS) | (F.col("wide_ms") - q >= GROUP_MARGIN)), F.col("wide_ms"))
    by_raw = F.when(F.col("overwide_context"), F.col("raw_ms"))
    x = x.withColumns({"wide_context": wide, "overwide_context": overwide})
    reason = F.when(F.col("wide_context"), "wide_qrs_pacing_like_context").when(F.col("overwide_context"), "overwide_qrs_pacing_like_context").otherwise("no_pacing_like_context")
    rule = F.when(raw.isNotNull(), "raw_pacing_qrs_underestimate").when(by_group.isNotNull(), "near_wide_pacing_group").when(by_raw.isNotNull(), "overwide_pacing_raw_consensus")
    x = x.withColumns({"context": F.col("wide_context") | F.col("overwide_context"), "context_reason": reason, "override_ms": F.coalesce(raw, by_group, by_raw), "override_rule": rule})
    return x.drop("wide_context", "overwide_context", "dominant_ms", "wide_ms", "raw_ms")


@_of_finite
def pacing_effects(facts: DataFrame) -> DataFrame:
    """facts (enabled, n_spikes, state, confirmed_context, group_paced, global_paced, capture_confirmed, n_floor and n_segmented: beats with a floor of QRS duration, beats segmented as paced) with measurement_effect, segmentation_effect and measurement_state."""
    floor, group = F.col("n_floor") > 0, _flag("group_paced")
    off = lambda: F.when(~_flag("enabled"), "disabled").when(F.coalesce("n_spikes", F.lit(0)) == 0, "none")
    measured = off().when(group & floor, "segmentation_floor_and_global_paced_route").when(group, "global_paced_route").when(_flag("global_paced"), "intermittent_wide_qrs_paced_route").when(_flag("capture_confirmed") & floor, "per_beat_segmentation_floor").otherwise("metadata_only")
    segmented = off().when(floor, F.when(group, "segmentation_floor").otherwise("per_beat_segmentation_floor")).when(F.col("n_segmented") > 0, F.when(group, "paced_segmentation").otherwise("per_beat_segmentation")).otherwise("metadata_only")
    x = facts.withColumns({"measurement_effect": measured, "segmentation_effect": segmented})
    on = _flag("confirmed_context") | F.col("measurement_effect").isin("segmentation_floor_and_global_paced_route", "global_paced_route", "intermittent_wide_qrs_paced_route", "per_beat_segmentation_floor")
    state = F.when(~_flag("enabled"), "off").when(on, "on").when(F.col("state").isin("on", "unknown"), "unknown").otherwise("off")
    return x.withColumn("measurement_state", state)


@_of_finite
def rr_profile(peaks: DataFrame) -> DataFrame:
    """record_id, n, median_rr, robust_cv, max_deviation of R peaks (record_id, ms): the last three null with fewer than two positive gaps."""
    w = Window.partitionBy("record_id").orderBy("ms")
    gap = F.col("ms") - F.lag("ms").over(w)
    x = peaks.select("record_id", F.when(gap > 0, gap.cast("double")).alias("rr"))
    middle = x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 3) & (F.count("rr") >= 2), median("rr")).alias("median_rr"))
    x = x.join(middle, "record_id").withColumn("off", F.abs(F.col("rr") - F.col("median_rr")))
    out = x.groupBy("record_id").agg(F.max("n").alias("n"), F.max("median_rr").alias("median_rr"), median("off").alias("mad"), F.max("off").alias("most"))
    return out.select("record_id", "n", "median_rr", (1.4826 * F.col("mad") / F.col("median_rr")).alias("robust_cv"), (F.col("most") / F.col("median_rr")).alias("max_deviation"))


@_of_finite
def despiking_rescue(raw: DataFrame, cleaned: DataFrame, spikes: DataFrame, facts: DataFrame) -> DataFrame:
    """record_id, applied and the evidence: whether taking spikes out of the signal removed regular beats that these captured. raw and cleaned are R peaks (record_id, ms) before and after, spikes (record_id, ms) the spikes, facts (record_id, paced, state) the detector's verdict."""
    at = lambda name: F.round(F.col("ms") * PER_MS).cast("long").alias(name)
    hit = within(raw.select("record_id", at("us")), spikes.select("record_id", at("at")), -RESCUE["before"], RESCUE["after"], "left_semi")
    captured = hit.groupBy("record_id").agg(F.count(F.lit(1)).alias("captured"))
    n_spikes = spikes.groupBy("record_id").agg(F.countDistinct("ms").alias("n_spikes"))
    x = facts.join(rr_profile(raw), "record_id", "left").join(rr_profile(cleaned).select("record_id", F.col("n").alias("cleaned")), "record_id", "left").join(captured, "record_id", "left").join(n_spikes, "record_id", "left").na.fill(0, ["n", "cleaned", "captured", "n_spikes"])
    c = F.col
    gate = _flag("paced") & (c("state") == "on") & (c("n_spikes") >= RESCUE["captured"]) & (c("n") >= RESCUE["beats"]) & (c("n") >= c("cleaned") + RESCUE["more_beats"]) & (c("n") / F.greatest("cleaned", F.lit(1)) >= RESCUE["ratio"])
    regular = c("median_rr").between(RESCUE["rr_min"], RESCUE["rr_max"]) & (c("robust_cv") <= RESCUE["cv"]) & (c("max_deviation") <= RESCUE["deviation"])
    shares = (c("captured") >= RESCUE["captured"]) & (c("captured") / c("n") >= RESCUE["beat_share"]) & (c("captured") / c("n_spikes") >= RESCUE["spike_share"])
    return x.withColumn("applied", _sure(gate & regular & shares)).select("record_id", "applied", "n", "cleaned", "n_spikes", "captured", "median_rr", "robust_cv", "max_deviation")

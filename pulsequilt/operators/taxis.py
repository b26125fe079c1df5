"""The T axis where its main gates leave too few limb leads, and when it is withheld.

``leads``: record_id, lead, amp (mV), amp_sd, conf, area, signed_area, reliable_for_t,
confused, st_conf, st_mid, special_uv, t_prime_area. ``facts``: record_id, qrs_ms, rr_cv,
atrial_invalid. A missing confidence of ST counts as zero, a missing flag as false, a
missing rr_cv as regular; numbers that are not finite as missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pulsequilt.functions.expressions import ANGLES, circular_delta
from pulsequilt.operators.intervals import frontal_axis, limb_place
from pulsequilt.operators.leads import signed_area
from pulsequilt.operators.policies import finite
from pulsequilt.operators.rhythm import by_record

#: Fixed values in ms, mV, degrees and shares.
MOST_QRS, MOST_CV, AMP_SD, AMP_SD_SHARE, SIGNED_SHARE = 120.0, 0.08, 0.08, 0.80, 0.15
T_PRIME_AREA, SPECIAL_UV = 160.0, 50.0
SEEDS, SEED_CONF, SEED_MV, SEED_AREA, SEED_NEUTRAL, SURE_CONF = ("I", "II", "aVF"), 0.60, 0.05, 0.30, 0.15, 0.95
RELAXED_MV, STABLE_LEADS = 0.02, 5
LEAST_LEADS, WIDE_LEADS, ST_LEADS, HIGH_CONF, WIDE_QRS, ANGLE_DEG, EXTREME_DEG = 2, 3, 2, 0.60, 145.0, 125.0, 150.0
POST_ST_MV, POST_ST_SHARE, IRREGULAR_CV, VISIBLE_P = 0.03, 0.30, 0.18, 2
POLARITY_MV, DISAGREEMENTS = 0.05, 1


@dataclass(frozen=True)
class Coverage:
    """A rule: what a lead's T wave must show, how many leads must, and how far from zero their axis may lie."""

    name: str
    leads: int
    conf: float
    area: float
    mv: float
    st_conf: float
    post_st: float | None
    most_deg: float
    signed_share: float | None = None
    seeds: bool = True


COVERAGES = (
    Coverage("low_support", 4, 0.10, 0.50, 0.05, 0.80, 0.08, 120.0, seeds=False),
    Coverage("detected", 3, 0.20, 0.75, 0.08, 0.85, 0.08, 120.0),
    Coverage("st_supported", 2, 0.60, 1.00, 0.05, 0.90, None, 130.0, 0.50),
)


def _sure(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _prime_conflict(value: Column) -> Column:
    """Whether a second T wave of some size has the other sign."""
    return _sure((F.abs("t_prime_area") >= T_PRIME_AREA) & (F.abs("special_uv") >= SPECIAL_UV) & (value * F.col("special_uv") < 0))


def _steady() -> Column:
    return F.col("amp_sd").isNull() | F.col("amp").isNull() | (F.col("amp_sd") <= F.greatest(F.lit(AMP_SD), AMP_SD_SHARE * F.abs("amp")))


def reported(value: Column, share: float | None = None) -> Column:
    """value where it may be told: a fair share of the area, no second T wave against it, a steady amplitude."""
    has_area = _sure(F.abs("area") >= 1e-6)
    fair = ~has_area | (F.abs(value) / F.abs("area") >= SIGNED_SHARE) if share is None else has_area & (F.abs(value) / F.abs("area") >= share)
    return F.when(fair & ~_prime_conflict(value) & _steady(), value)


def limb_values(leads: DataFrame, least_mv: float) -> DataFrame:
    """leads of the limbs with value: the signed area of T waves that are reliable and high enough."""
    x = finite(leads).where(F.col("lead").isin(*ANGLES))
    return x.withColumn("value", signed_area(F.col("area"), F.col("signed_area"), F.col("amp"), _sure("reliable_for_t"), least_mv))


def without_seed_conflicts(x: DataFrame) -> DataFrame:
    """Where I, II and aVF are sure and of one sign, values of aVR, aVL and III against the axis of these go (a sure aVL or III stays)."""
    seed = F.col("lead").isin(*SEEDS) & _sure(F.col("value").isNotNull() & (F.abs("amp") >= SEED_MV) & (F.col("conf") >= SEED_CONF) & (F.abs("value") >= SEED_AREA))
    w = by_record()
    weight = F.when(seed, F.col("value") * F.greatest(F.lit(0.1), F.col("conf")))
    theta = F.radians(F.create_map(*(F.lit(v) for kv in ANGLES.items() for v in kv))[F.col("lead")])
    ordered = w.orderBy(limb_place()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumns({"_n": F.count_if(seed).over(ordered), "_up": F.count_if(seed & (F.col("value") >= 0)).over(ordered), "_x": F.sum(weight * F.cos(theta)).over(ordered), "_y": F.sum(weight * F.sin(theta)).over(ordered)})
    projection = F.cos(F.atan2("_y", "_x") - theta)
    agreed = (F.col("_n") == len(SEEDS)) & F.col("_up").isin(0, len(SEEDS))
    against = (F.abs(projection) >= SEED_NEUTRAL) & (F.signum("value") != F.signum(projection)) & (F.abs("amp") >= SEED_MV) & ((F.col("lead") == "aVR") | (F.coalesce("conf", F.lit(0.0)) < SURE_CONF))
    gone = _sure(agreed & ~F.col("lead").isin(*SEEDS) & against)
    return x.withColumn("value", F.when(~gone, F.col("value"))).drop("_n", "_up", "_x", "_y")


@F.arrow_udf(DoubleType())
def libm_atan2(y: pa.Array, x: pa.Array) -> pa.Array:
    """The angle of a direction as the C library has it. Spark's own differs in its last bit for one direction in six, which tells at a limit."""
    return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist(), strict=True)], pa.float64())


def coverage(leads: DataFrame, facts: DataFrame, rule: Coverage) -> DataFrame:
    """record_id, rule, n_leads, axis_deg, leads of the records that a rule gives an axis: narrow, regular ones whose P waves are valid."""
    calm = finite(facts).where(~_sure("atrial_invalid") & (F.col("qrs_ms") <= MOST_QRS) & F.coalesce(F.col("rr_cv") <= MOST_CV, F.lit(True))).select("record_id")
    x = limb_values(leads, rule.mv).join(calm, "record_id", "left_semi")
    beyond_st = F.coalesce("st_conf", F.lit(0.0)) >= rule.st_conf
    if rule.post_st is not None:
        beyond_st = beyond_st & _sure(F.abs(F.col("amp") - F.col("st_mid")) >= rule.post_st)
    good = _sure(F.col("conf") >= rule.conf) & _sure(F.abs("value") >= rule.area) & (~_sure("confused") | beyond_st)
    x = x.withColumn("value", F.when(good, reported(F.col("value"), rule.signed_share)))
    if rule.seeds:
        x = without_seed_conflicts(x)
    x = x.where("value is not null")
    axis = frontal_axis(x.select("record_id", "lead", "value", "conf"), atan2=libm_atan2)
    named = x.groupBy("record_id").agg(F.array_sort(F.collect_list("lead")).alias("leads"))
    told = axis.where((F.col("n_leads") >= rule.leads) & (F.abs("axis_deg") <= rule.most_deg)).join(named, "record_id")
    return told.select("record_id", F.lit(rule.name).alias("rule"), "n_leads", "axis_deg", "leads")


def coverages(leads: DataFrame, facts: DataFrame) -> DataFrame:
    out = coverage(leads, facts, COVERAGES[0])
    for rule in COVERAGES[1:]:
        out = out.unionByName(coverage(leads, facts, rule))
    return out


def stable_signed_axis(leads: DataFrame) -> DataFrame:
    """record_id, axis_deg where five limb leads or more can be told, of both signs."""
    x = limb_values(leads, RELAXED_MV)
    x = x.withColumn("value", reported(F.col("value"))).where("value is not null")
    mixed = x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("value").alias("low")).where((F.col("n") >= STABLE_LEADS) & (F.col("top") > 0) & (F.col("low") < 0)).select("record_id")
    return frontal_axis(x.select("record_id", "lead", "value", "conf")).join(mixed, "record_id", "left_semi").select("record_id", "axis_deg")


def st_corrected(leads: DataFrame, facts: DataFrame) -> DataFrame:
    """record_id, use: whether a wide QRS's axis is taken from values (st_value) without the ST level: two leads have one, and signed values disagree with the amplitude's sign in one lead at most. leads: record_id, lead, value, st_value, amp."""
    x = finite(leads).where(F.col("lead").isin(*ANGLES))
    compared = _sure((F.abs("amp") >= POLARITY_MV) & (F.abs("value") >= 1e-6))
    g = x.groupBy("record_id").agg(F.count("st_value").alias("n"), F.count_if(compared).alias("compared"), F.count_if(compared & (F.signum("value") != F.signum("amp"))).alias("against"))
    use = _sure(F.col("qrs_ms") >= WIDE_QRS) & (F.col("n") >= ST_LEADS) & (F.col("compared") > 0) & (F.col("against") <= DISAGREEMENTS)
    return g.join(finite(facts).select("record_id", "qrs_ms"), "record_id", "left").select("record_id", use.alias("use"))


def suppressed(leads: DataFrame, facts: DataFrame) -> DataFrame:
    """record_id, suppressed, reason of records with a T axis; leads: record_id, lead, value, conf, amp, st_mid; facts: record_id, t_axis, qrs_axis, qrs_ms, rr_cv, n_visible_p, st_corrected, paced.

    Too few leads, none of them sure, an irregular rhythm without P waves, or a wide QRS whose
    T waves are too few, unsure or merged with ST; unpaced ones also for extreme axes and angles.
    """
    x = finite(leads).where(F.col("lead").isin(*ANGLES) & F.col("value").isNotNull())
    post = F.abs(F.col("amp") - F.col("st_mid"))
    supported = _sure((post >= POST_ST_MV) & (post >= POST_ST_SHARE * F.greatest(F.abs("amp"), F.lit(1e-6))))
    g = x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("conf") >= HIGH_CONF).alias("high"), F.count_if(supported).alias("post"))
    f = finite(facts).where("t_axis is not null").join(g, "record_id", "left").na.fill(0, ["n", "high", "post"])
    wide, paced = _sure(F.col("qrs_ms") >= WIDE_QRS), _sure("paced")
    least = F.when(_sure("st_corrected"), ST_LEADS).otherwise(WIDE_LEADS)
    signed = F.pmod(F.col("t_axis") + 180.0, F.lit(360.0)) - 180.0
    reason = (
        F.when(F.col("n") < LEAST_LEADS, "few_leads")
        .when(F.col("high") < 1, "no_confident_lead")
        .when(_sure(F.col("rr_cv") > IRREGULAR_CV) & (F.coalesce("n_visible_p", F.lit(0)) < VISIBLE_P), "irregular_without_p")
        .when(wide & (F.col("n") < least), "wide_few_leads")
        .when(wide & (F.col("high") < F.when(paced, ST_LEADS).otherwise(least)), "wide_low_confidence")
        .when(wide & (F.col("post") < least), "wide_without_post_st")
        .when(wide & ~paced & (F.abs(signed) >= EXTREME_DEG), "wide_extreme_axis")
        .when(wide & ~paced & _sure(circular_delta(F.col("qrs_axis"), F.col("t_axis")) >= ANGLE_DEG), "wide_discordant")
    )
    return f.select("record_id", reason.isNotNull().alias("suppressed"), reason.alias("reason"))

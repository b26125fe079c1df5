"""Record-level widths from representative leads, and swaps of chest leads told from their R waves.

Flags that are missing count as false; numbers out of their range as missing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import median
from pulsequilt.operators.policies import finite
from pulsequilt.operators.rhythm import by_record

#: Fixed values in ms, mV and shares.
P_RANGE, QRS_RANGE, WIDE_QRS = (35.0, 180.0), (40.0, 220.0), 120.0
P_LEAST_MV, P_LEAST_CONF = 0.02, 0.20
BEYOND_RAW, STRONG_WIDE, MODERATE_WIDE, SUPPORT, WIDE_SUPPORT = 12.0, 145.0, 190.0, 6, 2
CORE_DELTA, CORE_SUPPORT, CORE_CLUSTER, CORE_SHARE = 35.0, 5, 30.0, 0.60
LOW_VOLTAGE, FALL_SHARE, FALL_MV, Q_MV, Q_LEADS, SOKOLOW_MV, LOW_CORR, CORR_MARGIN = 0.50, 0.15, 0.05, -0.20, 2, 3.5, 0.50, 0.20


def _sure(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _within(c: str, limits: tuple[float, float]) -> Column:
    return F.when(F.col(c).between(*limits), F.col(c))


def p_supported() -> Column:
    """Whether a lead's P wave is visible and reliable; one without an amplitude is given the benefit of the doubt."""
    weak = _sure(F.col("p_conf") < P_LEAST_CONF) | ~_sure("reliable_for_p") | _sure(F.abs("p_amp") < P_LEAST_MV)
    return F.col("p_amp").isNull() | ~weak


def p_duration(leads: DataFrame) -> DataFrame:
    """record_id, p_ms, source, leads, support, spread_ms, reliability: the median of the leads' consensus durations, or of their own ones where no lead has a consensus.

    leads: record_id, lead, lead_no, consensus_ms, raw_ms, onset_support, offset_support,
    guarded, p_amp, p_conf, reliable_for_p. Support is the greatest of the leads' (each the
    lesser of its bounds'), or else the number of leads.
    """
    x = finite(leads).withColumns({"use": _sure("reliable_for_p") & p_supported(), "c": _within("consensus_ms", P_RANGE), "r": _within("raw_ms", P_RANGE)})
    x = x.withColumns({"c": F.when(F.col("use"), F.col("c")), "r": F.when(F.col("use"), F.col("r"))})
    both = F.when(F.col("c").isNotNull() & (F.col("onset_support") > 0) & (F.col("offset_support") > 0), F.least("onset_support", "offset_support"))
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("lead_no", "lead")))), lambda s: s["lead"])
    g = x.groupBy("record_id").agg(*(f.alias(n) for c in ("c", "r") for n, f in ((f"n_{c}", F.count(c)), (f"mid_{c}", median(c)), (f"span_{c}", F.max(c) - F.min(c)), (f"leads_{c}", names(c)))), F.max(both).alias("bounds"), F.bool_or(_sure("guarded") & F.col("c").isNotNull()).alias("guarded"))
    shared, own = F.col("n_c") > 0, F.col("n_r") > 0
    support = F.when(shared, F.coalesce("bounds", "n_c")).otherwise(F.col("n_r")).cast("long")
    source = F.when(shared, F.when(F.col("guarded"), "representative_multilead_consensus_paired_duration_guard").otherwise("representative_multilead_consensus")).when(own, "reliable_lead_median_fallback")
    reliability = F.when(shared, F.when(support >= 3, "reliable").otherwise("low_support")).when(own, F.when(support >= 2, "fallback").otherwise("low_support")).otherwise("unavailable")
    pick = lambda n: F.when(shared, F.col(f"{n}_c")).otherwise(F.col(f"{n}_r"))
    return g.select("record_id", pick("mid").alias("p_ms"), source.alias("source"), pick("leads").alias("leads"), support.alias("support"), pick("span").alias("spread_ms"), reliability.alias("reliability"))


def qrs_wide(leads: DataFrame, split: DataFrame) -> DataFrame:
    """record_id, qrs_ms, rule: the width that decides whether QRS is wide. leads: record_id, raw_ms, wide_ms, reliable_for_qrs; split (record_id, split_ms): the width of records whose limb and chest leads disagree.

    The median of wide values, but no more than the greatest raw one where it lies
    over 12 ms beyond it, and the raw median where only it says wide without strong support.
    """
    x = finite(leads).where(_sure("reliable_for_qrs")).withColumns({"r": _within("raw_ms", QRS_RANGE), "w": _within("wide_ms", QRS_RANGE)})
    g = x.groupBy("record_id").agg(F.count("w").alias("n"), median("w").alias("mid"), F.count("r").alias("n_raw"), F.max("r").alias("most"), median("r").alias("raw_mid"), F.count_if(F.col("r") >= WIDE_QRS).alias("n_wide")).where("n > 0").join(split.select("record_id", "split_ms"), "record_id", "left")
    q, enough = F.col("mid"), F.col("n_raw") >= 3
    beyond = enough & (q > F.col("most") + BEYOND_RAW)
    strong = (q >= STRONG_WIDE) & (F.col("n") >= SUPPORT) & (F.col("n_wide") >= WIDE_SUPPORT)
    lone = enough & (q >= WIDE_QRS) & (F.col("raw_mid") < WIDE_QRS) & (F.col("n_wide") < 3) & ~strong
    rule = F.when(F.col("split_ms").isNotNull(), "split").when(beyond, "raw_greatest").when(lone, "raw_median").otherwise("consensus")
    return g.select("record_id", F.when(rule == "split", F.col("split_ms")).when(rule == "raw_greatest", F.col("most")).when(rule == "raw_median", F.col("raw_mid")).otherwise(q).alias("qrs_ms"), rule.alias("rule"))


def late_qrs_core(leads: DataFrame, facts: DataFrame) -> DataFrame:
    """record_id, core_ms where a consensus of QRS lies 35 ms or more beyond the raw median and a lead has a late bound: the 60th percentile of raw widths, or the consensus if that is less.

    leads: record_id, raw_ms, reliable_for_qrs, confused, late_offset; facts: record_id,
    consensus_ms, paced. At least six raw widths, five of which (and half) lie no more than
    30 ms beyond their median; not where an unpaced consensus is plausibly wide.
    """
    x = finite(leads).withColumns({"r": F.when(_sure("reliable_for_qrs"), _within("raw_ms", QRS_RANGE)), "late": _sure("confused") | _sure("late_offset")})
    x = x.withColumn("mid", F.percentile("r", F.lit(0.5)).over(by_record()))
    g = x.groupBy("record_id").agg(F.bool_or("late").alias("late"), F.count("r").alias("n"), F.max("mid").alias("mid"), F.count_if(F.col("r") <= F.col("mid") + CORE_CLUSTER).alias("near"), F.count_if(F.col("r") >= WIDE_QRS).alias("n_wide"), F.percentile("r", F.lit(CORE_SHARE)).alias("core"))
    g = g.join(finite(facts).select("record_id", "consensus_ms", _sure("paced").alias("paced")), "record_id")
    plausible = ~F.col("paced") & F.col("consensus_ms").between(STRONG_WIDE, MODERATE_WIDE) & (F.col("n_wide") >= WIDE_SUPPORT)
    fits = F.col("late") & (F.col("n") >= SUPPORT) & ~plausible & (F.col("consensus_ms") - F.col("mid") >= CORE_DELTA) & (F.col("near") >= F.greatest(F.lit(CORE_SUPPORT), F.ceil(F.col("n") / 2)))
    return g.where(fits).select("record_id", F.least("core", "consensus_ms").alias("core_ms"))


# ---------------------------------------------------------------- chest leads


def _falls(r: list[Column]) -> tuple[Column, Column]:
    """How often R falls on the way from V1 to its (first) greatest, by more than noise, and how many steps that way has."""
    most = F.greatest(*r)
    peak = F.coalesce(*(F.when(x == most, k) for k, x in enumerate(r)))
    limit = -F.greatest(F.lit(FALL_MV), FALL_SHARE * most)
    falls = [F.when((peak >= k) & (r[k] - r[k - 1] < limit), 1).otherwise(0) for k in range(1, len(r))]
    out = falls[0]
    for f in falls[1:]:
        out = out + f
    return out, peak


def chest_reversal(records: DataFrame) -> DataFrame:
    """record_id, suspected, confidence, reason, leads (the two that changed places), score, peak_lead, corroborated; a row a record with r1..r6, q1..q4, s1, qrs (the greatest of the leads'), c1..c5 (likeness of neighbours).

    Screening only: R should not fall on its way to the greatest; a swap that mends all falls is
    suspected, neighbours before others, then shorter spans, then lower leads. Low voltage and
    known causes of poor progression exclude it. A neighbour pair unlike each other raises confidence.
    """
    x = finite(records)
    r = [F.col(f"r{k}") for k in range(1, 7)]
    whole = r[0].isNotNull()
    for c in r[1:]:
        whole = whole & c.isNotNull()
    falls, peak = _falls(r)
    pairs = sorted(combinations(range(6), 2), key=lambda p: (p[1] != p[0] + 1, p[1] - p[0], p))
    swap = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(pairs))):
        trial = list(r)
        trial[a], trial[b] = trial[b], trial[a]
        swap = F.when(_falls(trial)[0] == 0, k).otherwise(swap)
    x = x.withColumns({"falls": falls, "peak": peak, "swap": swap})
    q_count = F.lit(0)
    for k in range(1, 5):
        q_count = q_count + F.when(_sure(F.col(f"q{k}") <= Q_MV), 1).otherwise(0)
    causes = F.array_compact(F.array(F.when(_sure(F.col("qrs") >= WIDE_QRS), "wide_qrs"), F.when(q_count >= Q_LEADS, "pathological_q_pattern"), F.when(_sure(F.abs("s1") + F.greatest("r5", "r6") >= SOKOLOW_MV), "lvh_voltage_pattern")))
    big = F.greatest(*(F.abs(c) for c in r))
    reason = F.when(~whole, "incomplete").when(big <= LOW_VOLTAGE, "precordial_low_voltage").when(F.size(causes) > 0, F.concat_ws("+", causes)).when(F.col("falls") < 1, "no_violation").when(F.col("swap").isNull(), "no_single_swap_resolves_progression")
    suspected = reason.isNull()
    known = F.array(*(F.col(f"c{k}") for k in range(1, 6)))
    own = F.get(known, F.col("swap"))  # the five pairs of neighbours come first, in order
    others = F.array_sort(F.array_compact(F.transform(known, lambda c, k: F.when(k != F.col("swap"), c))))
    n = F.size(others)
    middle = (F.get(others, F.floor((n - 1) / 2).cast("int")) + F.get(others, F.floor(n / 2).cast("int"))) / 2
    unlike = (own < LOW_CORR) | (own < F.least(middle, F.lit(1.0)) - CORR_MARGIN)
    corroborated = F.when(suspected & (F.col("swap") < 5) & own.isNotNull() & (n > 0), unlike)
    confidence = F.when(~whole | (F.size(causes) > 0) & (big > LOW_VOLTAGE), "unavailable").when(reason == "no_violation", "moderate").when(_sure(corroborated), "moderate").otherwise("low")
    name = lambda k: F.concat(F.lit("V"), (k + 1).cast("string"))
    of_pair = F.array(*(F.array(F.lit(f"V{a + 1}"), F.lit(f"V{b + 1}")) for a, b in pairs))
    told = whole & (big > LOW_VOLTAGE) & (F.size(causes) == 0)
    score = F.when(told, F.when(F.col("peak") > 0, 1.0 - F.col("falls") / F.col("peak")).otherwise(1.0))
    return x.select("record_id", suspected.alias("suspected"), confidence.alias("confidence"), reason.alias("reason"), F.when(suspected, F.get(of_pair, F.col("swap"))).alias("leads"), score.alias("score"), F.when(whole, name(F.col("peak"))).alias("peak_lead"), corroborated.alias("corroborated"))

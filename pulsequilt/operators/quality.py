"""Signal quality of leads and records from measured indices: flags, grades, gates and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import centred, dot, median, ratio, reasons, total, unit

#: Fixed values of leads: limits of scores, and the stricter ones of P and T waves.
FLAT_FRACTION, FLAT_STD, SATURATION, DRIFT, MAINS, MUSCLE, CLIPPING = 0.10, 0.02, 0.005, 0.30, 0.15, 0.40, 0.05
PSQI, KSQI, BSQI = (0.40, 0.90), 5.0, 0.85
WAVE_MUSCLE, QRS_MAINS, T_DRIFT, T_MAINS = 0.30, 0.20, 0.25, 0.12
# Fixed values of the record gate.
LEAST_LEADS, ALL_LEADS, STOP_BSQI = 6, 10, 0.70


def samples_summary(waves: DataFrame) -> DataFrame:
    """Share of still samples, population sd and raw kurtosis of each window (array of double), by higher-order functions."""
    s, n = F.col("samples"), F.size("samples")
    x = waves.withColumn("c", centred(s))
    x = x.withColumns({"m2": total(F.col("c"), lambda v: v * v) / n, "m4": total(F.col("c"), lambda v: v * v * v * v) / n}).drop("c")
    steps = F.zip_with(F.slice(s, F.lit(2), n - 1), F.slice(s, F.lit(1), n - 1), lambda a, b: F.abs(a - b))
    return x.withColumns({"clipping": F.size(F.filter(steps, lambda d: d <= 1e-8)) / (n - 1), "sd": F.sqrt("m2"), "kurtosis": F.when(F.col("m2") > 0, F.col("m4") / (F.col("m2") * F.col("m2")))})


def record_quality(leads: DataFrame) -> DataFrame:
    """Counts, reasons, rejected functions and grade of records. leads: record_id, lead, for_qrs, for_p, for_qt, b_sqi, codes (array of reason codes); a full record has ``expected`` leads."""
    g = leads.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_leads"), *(F.count_if(c).alias(f"n_{c}") for c in ("for_qrs", "for_p", "for_qt")), F.max("b_sqi").alias("best_bsqi"), F.coalesce(F.bool_or(F.col("lead").isin("II", "V1") & F.col("for_qrs")), F.lit(False)).alias("anchor"), F.max("expected").alias("expected"))
    counts = leads.select("record_id", "lead", F.explode(F.array_distinct("codes")).alias("code")).groupBy("record_id", "code").agg(F.count(F.lit(1)).alias("n"))
    share = F.create_map(F.lit("psqi_out_of_range"), F.lit(2), F.lit("low_bsqi"), F.lit(3), F.lit("low_kurtosis"), F.lit(2))
    part = share[F.col("code")]
    counts = counts.join(g.select("record_id", "n_leads"), "record_id")
    promoted = counts.where(part.isNull() | (F.col("n") >= F.greatest(F.lit(4), F.floor(F.col("n_leads") / part))))
    codes = promoted.groupBy("record_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    x = g.join(codes, "record_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    partial = F.col("n_leads") != F.col("expected")
    x = x.withColumn("codes", F.when(partial, F.array_sort(F.array_append("codes", F.lit("partial_quality_map")))).otherwise(F.col("codes")))
    stop = (F.col("n_for_qrs") < LEAST_LEADS) | ~F.col("anchor") | F.coalesce(F.col("best_bsqi") < STOP_BSQI, F.lit(False)) | partial
    rejected = reasons((F.col("n_for_p") < 2, "p_measurement"), (F.col("n_for_qt") < 2, "qt_measurement"), (stop, "record"))
    x = x.withColumns({"stop": stop, "rejected": rejected})
    grade = F.when(F.col("stop"), "Q3").when(F.size("rejected") > 0, "Q2").when(F.size("codes") > 0, "Q1").otherwise("Q0")
    gate = F.when(F.col("stop"), "stop").when(F.col("n_for_qrs") < ALL_LEADS, "partial").otherwise("pass")
    return x.withColumns({"grade": grade, "gate": gate})


def diagnostic_gate(x: DataFrame) -> DataFrame:
    """stop, partial or pass with the reasons. x: record_id, grade, duration_s, n_beats, dominant_share, n_classes, reversal, inconsistent, agreement, normalized."""
    stop = reasons((F.col("grade") == "Q3", "record_quality_rejected"), (F.col("duration_s") < 8.0, "recording_too_short"), (F.col("n_beats") < 3, "too_few_beats"))
    part = reasons((F.col("grade") == "Q2", "partial_lead_quality"), (F.col("duration_s").between(8.0, 10.0) & (F.col("duration_s") < 10.0), "short_for_diagnosis"), (F.col("dominant_share") < 0.30, "no_dominant_morphology"), (F.col("n_classes") > 5, "too_many_morphologies"), (F.col("reversal"), "lead_reversal"), (F.col("inconsistent"), "limb_leads_inconsistent"), (F.col("agreement") < 0.85, "detector_disagreement"), (F.col("normalized"), "amplitudes_normalized"))
    x = x.withColumns({"stop_reasons": stop, "partial_reasons": part})
    return x.withColumn("gate", F.when(F.size("stop_reasons") > 0, "stop").when(F.size("partial_reasons") > 0, "partial").otherwise("pass"))


def outliers_in_family(leads: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Leads whose value is out of low to high times the median of their record's lead family: record_id, family, lead. Where the median is zero, all of the family are."""
    m = leads.groupBy("record_id", "family").agg(median(value).alias("middle"))
    return leads.join(m, ["record_id", "family"]).withColumn("ratio", ratio(F.col(value), F.col("middle"))).withColumn("outlier", F.coalesce((F.col("ratio") > high) | (F.col("ratio") < low), F.lit(False)))


def duplicates(waves: DataFrame, by: str, least_r: float = 0.9995, coordinates: int = 4) -> DataFrame:
    """Pairs of windows in a group whose correlation is at least least_r in size.

    Windows become unit vectors. Those of such a pair (up to sign) lie within
    w = sqrt(2 - 2 r) of each other, so in each coordinate too: a grid of cells
    two w wide on the first coordinates' sizes, searched in the cells that w
    reaches, finds every pair without comparing all windows of a group.
    """
    w = (2.0 - 2.0 * least_r) ** 0.5 + 1e-9
    cell = lambda x: F.floor(x / (2 * w)).cast("int")
    keyed = waves.select(by, "beat_id", unit(F.col("samples")).alias("u")).where("u is not null")
    sizes = [F.abs(F.get("u", F.lit(k))) for k in range(coordinates)]
    home = keyed.select(F.col(by).alias("_by"), F.col("beat_id").alias("other_id"), F.col("u").alias("v"), *(cell(x).alias(f"_c{k}") for k, x in enumerate(sizes)))
    seek = keyed
    for k, x in enumerate(sizes):
        seek = seek.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(cell(x - w), cell(x + w)))))
    same = (F.col(by) == F.col("_by")) & (F.col("beat_id") < F.col("other_id"))
    for k in range(coordinates):
        same &= F.col(f"c{k}") == F.col(f"_c{k}")
    return seek.join(home, same).withColumn("r", dot(F.col("u"), F.col("v"))).where(F.abs("r") >= least_r).select(by, "beat_id", "other_id", "r")


def lead_grades(scores: DataFrame) -> DataFrame:
    """scores with missing, flags, reliable, reliable_for_p, reliable_for_qrs, reliable_for_t, reliable_for_qt and grade (Q0 to Q3).

    scores: baseline_wander, muscle_noise, powerline, clipping, flat_std, flat_fraction,
    saturation_fraction (null where the full scale is unknown), p_sqi, k_sqi, b_sqi. A
    score that is null or not finite breaks the limits that it is held against, but for saturation.
    """
    c = lambda n: F.when(F.abs(n) < float("inf"), F.col(n))
    sure = lambda x: F.coalesce(x, F.lit(False))
    drift, muscle, mains, beats = c("baseline_wander"), c("muscle_noise"), c("powerline"), sure(c("b_sqi") >= STOP_BSQI)
    missing = ~sure((c("flat_fraction") <= FLAT_FRACTION) | (c("flat_std") >= FLAT_STD))
    saturated = sure(c("saturation_fraction") > SATURATION)
    flags = [
        (~sure(drift <= DRIFT), "baseline_wander"),
        (~sure(muscle <= MUSCLE), "muscle_noise"),
        (~sure(mains <= MAINS), "powerline_noise"),
        (saturated, "saturation"),
        (~saturated & ~sure(c("clipping") <= CLIPPING), "clipping"),
        (missing, "missing_or_flat"),
        (~sure(c("p_sqi").between(*PSQI)), "psqi_out_of_range"),
        (~sure(c("k_sqi") >= KSQI), "low_kurtosis"),
        (~sure(c("b_sqi") >= BSQI), "low_bsqi"),
    ]
    usable = ~missing & ~saturated & beats
    x = scores.withColumns({
        "missing": missing,
        "flags": F.array_compact(F.array(*(F.when(bad, name) for bad, name in flags))),
        "reliable": usable & sure(drift <= DRIFT) & sure(muscle <= MUSCLE),
        "reliable_for_p": usable & sure(drift <= DRIFT) & sure(muscle < WAVE_MUSCLE) & sure(mains <= MAINS),
        "reliable_for_qrs": usable & sure(muscle <= MUSCLE) & sure(mains <= QRS_MAINS),
        "reliable_for_t": usable & sure(drift < T_DRIFT) & sure(muscle < WAVE_MUSCLE) & sure(mains < T_MAINS) & sure(c("flat_std") > FLAT_STD),
    })
    x = x.withColumn("reliable_for_qt", F.col("reliable_for_t") & F.col("reliable_for_qrs"))
    grade = F.when(F.col("missing") | ~F.col("reliable_for_qrs"), "Q3").when(~F.col("reliable_for_p") | ~F.col("reliable_for_qt"), "Q2").when((F.size("flags") > 0) | ~F.col("reliable"), "Q1").otherwise("Q0")
    return x.withColumn("grade", grade)

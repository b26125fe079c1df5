"""QT and other intervals across leads: ranges, clusters, weighted medians, gates and axes.

Lead tables hold record_id, lead and a value in ms; records are grouped, and
windows run inside a record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import ANGLES, median, total
from pulsequilt.operators.rhythm import by_record

# Fixed values of the interval rules.
LIMITS_MS = {"pr": (60.0, 350.0), "p_duration": (35.0, 180.0), "qrs": (40.0, 220.0), "qt": (240.0, 700.0), "jt": (120.0, 650.0)}
CORE_MS, CORE_LEADS, CORE_REGULAR_LEADS, CORE_DELTA_MS, CORE_REGULAR_DELTA_MS, IRREGULAR_CV = 45.0, 3, 5, 25.0, 35.0, 0.12


def rate_corrected(qt: Column, rr_ms: Column) -> dict[str, Column]:
    """Bazett, Fridericia, Framingham and Hodges."""
    s = rr_ms / 1000.0
    return {"qtc_bazett_ms": qt / F.sqrt(s), "qtc_fridericia_ms": qt / F.cbrt(s), "qtc_framingham_ms": qt + 154.0 * (1.0 - s), "qtc_hodges_ms": qt + 1.75 * (60000.0 / rr_ms - 60.0)}


def in_range(name: str, value: Column) -> Column:
    """The value where it is physiologic for the measurement, else null."""
    low, high = LIMITS_MS[name]
    return F.when(value.between(low, high), value)


def path(qrs_ms: Column, paced: Column) -> Column:
    """Which interval stands for repolarization: paced_jt, wide_qrs_jt or normal_qrs."""
    return F.when(paced, "paced_jt").when(qrs_ms >= 120.0, "wide_qrs_jt").otherwise("normal_qrs")


def allowed(qt: Column, qrs: Column, way: Column) -> Column:
    """Whether a QT is plausible: itself in range, or on wide and paced paths its JT part."""
    return F.when(way == "normal_qrs", qt.between(240.0, 700.0)).otherwise((qt - qrs).between(160.0, 550.0))


def clusters(values: DataFrame, x: str, width: float) -> DataFrame:
    """For each value of a record those from it to width above: how many (n), their median (mid) and span."""
    w = f"OVER (PARTITION BY record_id ORDER BY {x} RANGE BETWEEN CURRENT ROW AND {width}D FOLLOWING)"
    return values.select("*", F.expr(f"count({x}) {w}").alias("n"), F.expr(f"percentile({x}, 0.5D) {w}").alias("mid"), F.expr(f"max({x}) {w} - {x}").alias("span"))


def dispersion(values: DataFrame) -> DataFrame:
    """Range, P90 - P10, and the range of the densest 45 ms cluster of three or more where the range is 80 ms or more."""
    x = values.groupBy("record_id").agg(F.count("qt").alias("n_leads"), (F.max("qt") - F.min("qt")).alias("independent_ms"), (F.percentile("qt", F.lit(0.9)) - F.percentile("qt", F.lit(0.1))).alias("p90_p10_ms"))
    dense = clusters(values, "qt", CORE_MS).where("n >= 3").groupBy("record_id").agg(F.max(F.struct("n", (-F.col("span")).alias("tight"))).alias("best"))
    compact = (F.col("independent_ms") >= 80.0) & F.col("best").isNotNull()
    return x.where("n_leads >= 2").join(dense, "record_id", "left").select("record_id", "n_leads", "independent_ms", "p90_p10_ms", F.when(compact, -F.col("best.tight")).otherwise(F.col("independent_ms")).alias("legacy_ms"), F.when(compact, "legacy_compact_cluster_range").otherwise("independent_reliable_lead_range").alias("source"))


def weighted_median(values: DataFrame, x: str, weight: str, *order: str) -> DataFrame:
    """The first value of a record at which the running weight is half the total."""
    w = by_record().orderBy(x, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = values.withColumns({"_run": F.sum(weight).over(w), "_all": F.sum(weight).over(by_record().orderBy(x, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return run.where(F.col("_run") >= F.col("_all") / 2).groupBy("record_id").agg(F.min(x).alias("weighted_median"))


def raw_core(values: DataFrame, consensus: DataFrame) -> DataFrame:
    """A record's early core: the densest 45 ms cluster well below its consensus; ties go to the greater median. consensus: record_id, consensus_qt, rr_cv."""
    x = clusters(values, "qt", CORE_MS).join(consensus, "record_id")
    irregular = F.coalesce(F.col("rr_cv") >= IRREGULAR_CV, F.lit(False))
    delta = F.col("consensus_qt") - F.col("mid")
    fits = (F.col("n") >= F.when(irregular, CORE_LEADS).otherwise(CORE_REGULAR_LEADS)) & (delta >= F.when(irregular, CORE_DELTA_MS).otherwise(CORE_REGULAR_DELTA_MS))
    return x.where(fits).groupBy("record_id").agg(F.max(F.struct("n", "mid")).alias("best")).select("record_id", F.col("best.n").alias("n_leads"), F.col("best.mid").alias("core_qt_ms"))


def late_cluster(values: DataFrame, consensus: DataFrame) -> DataFrame:
    """Regular records only: the densest 35 ms cluster of at least four and half of the leads, 20 ms or more late; ties by greater median, then smaller span."""
    total = F.count("qt").over(by_record())
    x = clusters(values.withColumn("total", total), "qt", 35.0).join(consensus, "record_id").where(F.coalesce(F.col("rr_cv") < IRREGULAR_CV, F.lit(True)))
    fits = (F.col("n") >= F.greatest(F.lit(4.0), F.col("total") * 0.5)) & (F.col("mid") - F.col("consensus_qt") >= 20.0)
    return x.where(fits).groupBy("record_id").agg(F.max(F.struct("n", "mid", (-F.col("span")).alias("tight"))).alias("best")).select("record_id", F.col("best.n").alias("n_leads"), F.col("best.mid").alias("late_qt_ms"))


def irregular_core(beat_qt: DataFrame) -> DataFrame:
    """Median of the beats' median QT in 300 to 520 ms within 1.5 interquartile ranges, of five beats at least. beat_qt: record_id, beat_id, qt."""
    b = beat_qt.groupBy("record_id", "beat_id").agg(median("qt").alias("qt")).where(F.col("qt").between(300.0, 520.0))
    q1, q3 = (F.percentile("qt", F.lit(p)).over(by_record()) for p in (0.25, 0.75))
    kept = b.withColumns({"q1": q1, "q3": q3}).where(F.col("qt").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return kept.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"), median("qt").alias("core_qt_ms")).where("n_beats >= 5")


def error_risk(rows: DataFrame, threshold_ms: float = 40.0, prior: float = 3.0) -> DataFrame:
    """Risk of an error over threshold by confidence bin, each record of weight one, shrunk to the overall risk by ``prior`` records. rows: record, error_ms, confidence."""
    c = F.col("confidence")
    bins = F.when(c.isNull() | (c < 0) | (c > 1), "missing").otherwise(F.least(F.lit(4), F.floor(c * 5)).cast("string"))
    x = rows.where("error_ms is not null").select("record", bins.alias("bin"), (F.abs("error_ms") > threshold_ms).cast("double").alias("bad"))
    x = x.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("record")))
    overall = x.agg((F.sum(F.col("bad") * F.col("w")) / F.count_distinct("record")).alias("overall"))
    binned = x.groupBy("bin").agg(F.sum(F.col("bad") * F.col("w")).alias("bad"), F.sum("w").alias("w"), F.count_distinct("record").alias("n_records"))
    return binned.select("bin", "n_records", ((F.col("bad") + prior * overall.scalar()) / (F.col("w") + prior)).alias("risk"))


def reject_gate(x: DataFrame) -> DataFrame:
    """QT and what follows from it is withheld where its reliability is weak and the record's grade Q2 or Q3."""
    weak = F.col("qt_reliability").isin("fallback", "low_confidence") & F.col("grade").isin("Q2", "Q3")
    return x.withColumns({c: F.when(~weak, F.col(c)) for c in x.columns if c.startswith("qt") and c != "qt_reliability"}).withColumn("rejected", weak)


# ---------------------------------------------------------------- axes


def limb_place(lead: str = "lead") -> Column:
    """The place of a limb lead in the standard order, from 1."""
    return F.array_position(F.array(*map(F.lit, ANGLES)), F.col(lead))


def frontal_axis(values: DataFrame, least: float = 1e-6, atan2: Callable[..., Column] = F.atan2) -> DataFrame:
    """Direction in degrees of limb-lead values (record_id, lead, value, conf), each weighted by its confidence (0.1 at least); null where they cancel. Leads are added up in their order, so that an axis at a limit doesn't depend on how rows are dealt."""
    angles = F.create_map(*(F.lit(v) for kv in ANGLES.items() for v in kv))
    x = values.withColumns({"theta": F.radians(angles[F.col("lead")]), "c": F.greatest(F.lit(0.1), F.col("conf"))}).where("theta is not null and value is not null")
    part = F.col("value") * F.col("c")
    term = F.struct(limb_place().alias("place"), (part * F.cos("theta")).alias("x"), (part * F.sin("theta")).alias("y"), (F.abs("value") * F.col("c")).alias("size"))
    s = x.groupBy("record_id").agg(F.array_sort(F.collect_list(term)).alias("terms"))
    s = s.select("record_id", F.size("terms").cast("long").alias("n_leads"), *(total(F.col(f"terms.{k}")).alias(k) for k in ("x", "y", "size")))
    return s.select("record_id", "n_leads", F.when(F.col("size") >= least, F.degrees(atan2("y", "x"))).alias("axis_deg"))


def t_axis(leads: DataFrame, least_leads: int = 2) -> DataFrame:
    """Two passes: an axis of the leads that pass the gates, then one without those whose sign is against it or that are confused. leads: record_id, lead, reliable, amp, conf, area, confused."""
    gate = F.when(~F.col("reliable"), "not_reliable_for_t").when(F.col("amp").isNull() | (F.abs("amp") < 0.05), "low_t_amplitude").when(F.col("conf").isNull() | (F.col("conf") < 0.45), "low_t_confidence").when(F.col("area").isNull() | (F.abs("area") < 1e-12), "missing_signed_area")
    x = leads.withColumns({"excluded": gate, "value": F.col("area")})
    enough = lambda df, why: df.groupBy("record_id").agg(F.count_if(F.col("excluded").isNull()).alias("n")).where(F.col("n") >= why)
    first = frontal_axis(x.where("excluded is null")).join(enough(x, least_leads).select("record_id"), "record_id", "left_semi")
    angles = F.create_map(*(F.lit(v) for kv in ANGLES.items() for v in kv))
    y = x.join(first.select("record_id", F.col("axis_deg").alias("first_axis")), "record_id")
    expected = F.cos(F.radians(F.col("first_axis") - angles[F.col("lead")]))
    conflict = (F.abs(expected) >= 0.15) & (F.signum("value") != F.signum(expected))
    y = y.withColumn("excluded", F.coalesce("excluded", F.when(F.col("confused") | F.coalesce(conflict, F.lit(False)), "polarity_conflict_or_st_t_confusion")))
    second = frontal_axis(y.where("excluded is null")).where(F.col("n_leads") >= least_leads)
    return leads.select("record_id").distinct().join(second, "record_id", "left")


def transition_zone(balance: DataFrame) -> DataFrame:
    """Where r - |s| first turns from negative to not along V1 to V6, by linear interpolation. balance: record_id, idx, value."""
    w = by_record().orderBy("idx")
    x = balance.withColumns({"next": F.lead("value").over(w), "next_idx": F.lead("idx").over(w)}).where("next is not null")
    at = F.when(F.col("value") == 0.0, F.col("idx").cast("double")).when((F.col("value") < 0.0) & (F.col("next") >= 0.0), F.col("idx") - F.col("value") / (F.col("next") - F.col("value")) * (F.col("next_idx") - F.col("idx")))
    zone = x.withColumn("zone", at).where("zone is not null").groupBy("record_id").agg(F.min_by("zone", "idx").alias("transition_zone"))
    return balance.select("record_id").distinct().join(zone, "record_id", "left")

"""Quality queries over ``events`` (leads of records) and ``embeddings`` (windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import listed, rounded, with_means
from pulsequilt.operators import quality as Q
from pulsequilt.plans.registry import query
from pulsequilt.plans.rhythm import published
from pulsequilt.sources.adapters import MARKS_SQL, WAVES_SQL, beats, marks, table, waveforms

STATS_SQL = WAVES_SQL + """, a AS (SELECT beat_id, group_id, samples, list_sum(samples) / 64 AS mean FROM waves),
m AS (SELECT *, list_sum(list_transform(samples, lambda x: (x - mean) ** 2)) / 64 AS m2, list_sum(list_transform(samples, lambda x: (x - mean) ** 4)) / 64 AS m4, len(list_filter(list_zip(samples[2:], samples[:63]), lambda p: abs(p[1] - p[2]) <= 1e-8)) / 63 AS clipping FROM a)
"""


@query(STATS_SQL + "SELECT beat_id, round(clipping, 6) + 0.0 AS clipping, round(sqrt(m2), 6) AS flatline FROM m")
def clipping_flatline(spark, sf):
    return published(Q.samples_summary(waveforms(spark, sf)), "beat_id", digits=6, clipping="clipping", flatline="sd")


@query(STATS_SQL + "SELECT beat_id, round(m4 / (m2 * m2), 6) AS kurtosis, m4 / (m2 * m2) >= 5 AS passes FROM m")
def kurtosis_sqi(spark, sf):
    return published(Q.samples_summary(waveforms(spark, sf)).withColumn("passes", F.col("kurtosis") >= 5), "beat_id", "passes", digits=6, kurtosis="kurtosis")


LEADS_OF = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]


def lead_quality(spark, sf) -> DataFrame:
    """record_id, lead, for_qrs, for_p, for_qt, b_sqi, codes, expected: twelve leads of a record by mark number."""
    lead = F.element_at(F.array(*(F.lit(x) for x in LEADS_OF)), (F.col("mark") % 12 + 1).cast("int"))
    m, mean = with_means(marks(spark, sf), {"record_id": F.col("record_id"), "lead": lead}, ["mark"], conf="conf", amp="amp")
    x = m.groupBy("record_id", "lead").agg(mean["conf"].alias("c"), F.max("conf").alias("b_sqi"), mean["amp"].alias("a"), F.max("amp").alias("top"))
    codes = F.array_compact(F.array(F.when(F.col("c") < 0.4, "low_bsqi"), F.when(F.col("a") < 30, "low_kurtosis"), F.when(F.col("a") > 55, "psqi_out_of_range"), F.when(F.col("top") > 200, "saturation")))
    return x.select("record_id", "lead", (F.col("c") >= 0.35).alias("for_qrs"), (F.col("c") >= 0.5).alias("for_p"), (F.col("c") >= 0.55).alias("for_qt"), "b_sqi", codes.alias("codes"), F.lit(12).alias("expected"))


QUALITY_SQL = MARKS_SQL + f""", l AS (SELECT record_id, {LEADS_OF}[mark % 12 + 1] AS lead, avg(conf) AS c, max(conf) AS b, avg(amp) AS a, max(amp) AS top FROM marks GROUP BY ALL),
q AS (SELECT record_id, count(*) AS n_leads, count(*) FILTER (c >= 0.35) AS nq, count(*) FILTER (c >= 0.5) AS np, count(*) FILTER (c >= 0.55) AS nt, max(b) AS b, coalesce(bool_or(lead IN ('II', 'V1') AND c >= 0.35), false) AS anchor FROM l GROUP BY record_id),
k AS (SELECT record_id, code, count(*) AS n FROM (SELECT record_id, unnest(list_filter([CASE WHEN c < 0.4 THEN 'low_bsqi' END, CASE WHEN a < 30 THEN 'low_kurtosis' END, CASE WHEN a > 55 THEN 'psqi_out_of_range' END, CASE WHEN top > 200 THEN 'saturation' END], lambda x: x IS NOT NULL)) AS code FROM l) GROUP BY ALL),
p AS (SELECT record_id, list(code) AS codes FROM k JOIN q USING (record_id) WHERE code = 'saturation' OR n >= greatest(4, n_leads // (CASE code WHEN 'low_bsqi' THEN 3 ELSE 2 END)) GROUP BY record_id),
x AS (SELECT q.*, list_sort(coalesce(codes, []) || CASE WHEN n_leads <> 12 THEN ['partial_quality_map'] ELSE [] END) AS codes, nq < 6 OR NOT anchor OR b < 0.7 OR n_leads <> 12 AS stop FROM q LEFT JOIN p USING (record_id)),
y AS (SELECT *, concat_ws(',', CASE WHEN np < 2 THEN 'p_measurement' END, CASE WHEN nt < 2 THEN 'qt_measurement' END, CASE WHEN stop THEN 'record' END) AS rejected FROM x),
r AS (SELECT *, CASE WHEN stop THEN 'Q3' WHEN rejected <> '' THEN 'Q2' WHEN len(codes) > 0 THEN 'Q1' ELSE 'Q0' END AS grade, CASE WHEN stop THEN 'stop' WHEN nq < 10 THEN 'partial' ELSE 'pass' END AS gate FROM y)
"""


@query(QUALITY_SQL + "SELECT record_id, nq AS n_reliable_qrs_leads, np AS n_reliable_p_leads, nt AS n_reliable_qt_leads, array_to_string(codes, ',') AS reason_codes, rejected AS rejected_functions, grade AS record_grade, gate FROM r")
def record_quality(spark, sf):
    x = Q.record_quality(lead_quality(spark, sf))
    return x.select("record_id", F.col("n_for_qrs").alias("n_reliable_qrs_leads"), F.col("n_for_p").alias("n_reliable_p_leads"), F.col("n_for_qt").alias("n_reliable_qt_leads"), listed(F.col("codes")).alias("reason_codes"), listed(F.col("rejected")).alias("rejected_functions"), F.col("grade").alias("record_grade"), "gate")


@query(QUALITY_SQL + """, g AS (SELECT record_id, (max(us) - min(us)) / 3e10 AS dur, count(*) AS nb, max(n) / sum(n) AS share, count(*) FILTER (n > 10) AS classes FROM (SELECT record_id, kind, count(*) AS n, min(us) AS us FROM marks GROUP BY ALL UNION ALL SELECT record_id, NULL, 0, max(us) FROM marks GROUP BY record_id) GROUP BY record_id),
b AS (SELECT record_id, count(*) AS n_beats, avg(conf) AS agreement, max(amp) - min(amp) < 150 AS normalized FROM beats GROUP BY record_id),
z AS (SELECT record_id, grade, dur, n_beats, share, classes, agreement + 0.35 AS agr, normalized FROM r JOIN g USING (record_id) JOIN b USING (record_id)),
v AS (SELECT *, concat_ws(',', CASE WHEN grade = 'Q3' THEN 'record_quality_rejected' END, CASE WHEN dur < 8 THEN 'recording_too_short' END, CASE WHEN n_beats < 3 THEN 'too_few_beats' END) AS s, concat_ws(',', CASE WHEN normalized THEN 'amplitudes_normalized' END, CASE WHEN agr < 0.85 THEN 'detector_disagreement' END, CASE WHEN share < 0.3 THEN 'no_dominant_morphology' END, CASE WHEN grade = 'Q2' THEN 'partial_lead_quality' END, CASE WHEN dur >= 8 AND dur < 10 THEN 'short_for_diagnosis' END, CASE WHEN classes > 5 THEN 'too_many_morphologies' END) AS p FROM z)
SELECT record_id, s AS stop_reasons, p AS partial_reasons, CASE WHEN s <> '' THEN 'stop' WHEN p <> '' THEN 'partial' ELSE 'pass' END AS gate FROM v""")
def diagnostic_gate(spark, sf):
    b, mean = with_means(beats(spark, sf), {"record_id": F.col("record_id")}, ["us", "mark"], conf="conf")
    kinds = b.groupBy("record_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("record_id").agg((F.max("n") / F.sum("n")).alias("dominant_share"), F.count_if(F.col("n") > 10).alias("n_classes"))
    whole = b.groupBy("record_id").agg(((F.max("us") - F.min("us")) / F.lit(3e10)).alias("duration_s"), F.count(F.lit(1)).alias("n_beats"), (mean["conf"] + 0.35).alias("agreement"), ((F.max("amp") - F.min("amp")) < 150).alias("normalized"))
    x = Q.record_quality(lead_quality(spark, sf)).select("record_id", "grade").join(kinds, "record_id").join(whole, "record_id").withColumns({"reversal": F.lit(False), "inconsistent": F.lit(False)})
    return Q.diagnostic_gate(x).select("record_id", listed(F.col("stop_reasons")).alias("stop_reasons"), listed(F.col("partial_reasons")).alias("partial_reasons"), "gate")


@query(MARKS_SQL + """, l AS (SELECT record_id, mark % 2 AS family, mark % 12 AS lead, quantile_cont(amp, 0.99) - quantile_cont(amp, 0.01) AS span FROM marks GROUP BY ALL), m AS (SELECT *, span / median(span) OVER (PARTITION BY record_id, family) AS ratio FROM l)
SELECT record_id, lead, round(span, 4) AS span, coalesce(ratio > 2.5 OR ratio < 0.3, false) AS outlier FROM m""")
def gain_outliers(spark, sf):
    x = marks(spark, sf).groupBy("record_id", (F.col("mark") % 2).alias("family"), (F.col("mark") % 12).alias("lead")).agg((F.percentile("amp", F.lit(0.99)) - F.percentile("amp", F.lit(0.01))).alias("span"))
    return published(Q.outliers_in_family(x, "span", 0.3, 2.5), "record_id", "lead", "outlier", span="span")


COPIED_SQL = WAVES_SQL + """, w AS (SELECT beat_id, group_id, samples FROM waves UNION ALL SELECT beat_id + 1000000000, group_id, list_transform(samples, lambda x: -2 * x + 0.5) FROM waves WHERE beat_id % 5 = 0),
u AS (SELECT beat_id, group_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS u FROM (SELECT beat_id, group_id, list_transform(samples, lambda x: x - list_sum(samples) / 64) AS c FROM w))
"""


@query(COPIED_SQL + "SELECT a.group_id, a.beat_id, b.beat_id AS other_id, round(list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])), 6) AS r FROM u a JOIN u b ON a.group_id = b.group_id AND a.beat_id < b.beat_id WHERE abs(list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2]))) >= 0.9995")
def duplicate_channels(spark, sf):
    """Every fifth window gets an inverted and scaled copy, as a channel that repeats another has."""
    w = waveforms(spark, sf)
    copies = w.where("beat_id % 5 = 0").select((F.col("beat_id") + 1_000_000_000).alias("beat_id"), "group_id", F.transform("samples", lambda x: -2.0 * x + 0.5).alias("samples"))
    return published(Q.duplicates(w.unionByName(copies), "group_id"), "group_id", "beat_id", "other_id", digits=6, r="r")


@query(MARKS_SQL + "SELECT record_id, kind, round(avg(CASE WHEN amp >= 0.95 * 100 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS saturation, round(max(amp) - min(amp), 4) AS span, max(amp) - min(amp) < 60 AS flat FROM marks GROUP BY ALL")
def saturation_flatness(spark, sf):
    """Share of samples at 95 % of full scale, and whether a lead's whole range is small."""
    return marks(spark, sf).groupBy("record_id", "kind").agg(rounded(F.avg(F.when(F.col("amp") >= 95.0, 1.0).otherwise(0.0))).alias("saturation"), rounded(F.max("amp") - F.min("amp"), 4).alias("span"), ((F.max("amp") - F.min("amp")) < 60).alias("flat"))


_SCORES = ("baseline_wander", "muscle_noise", "powerline", "clipping", "flat_std", "flat_fraction", "saturation_fraction", "p_sqi", "k_sqi", "b_sqi")
_PARTS = ("l_partkey % 41 / 100", "l_suppkey % 50 / 100", "l_orderkey % 23 / 100", "l_partkey % 11 / 100", "l_suppkey % 13 / 200", "l_orderkey % 14 / 100", "CASE WHEN l_suppkey % 3 > 0 THEN l_partkey % 7 / 1000 END", "0.3 + l_orderkey % 70 / 100", "3 + l_suppkey % 30", "0.6 + l_partkey % 40 / 100")


@query(f"""WITH s AS (SELECT l_orderkey AS record_id, l_linenumber AS lead, {", ".join(f"CAST({p} AS DOUBLE) AS {n}" for n, p in zip(_SCORES, _PARTS))} FROM lineitem),
m AS (SELECT *, flat_fraction > 0.10 AND flat_std < 0.02 AS missing, coalesce(saturation_fraction > 0.005, false) AS sat FROM s),
r AS (SELECT *, concat_ws(',', CASE WHEN baseline_wander > 0.30 THEN 'baseline_wander' END, CASE WHEN muscle_noise > 0.40 THEN 'muscle_noise' END, CASE WHEN powerline > 0.15 THEN 'powerline_noise' END, CASE WHEN sat THEN 'saturation' WHEN clipping > 0.05 THEN 'clipping' END, CASE WHEN missing THEN 'missing_or_flat' END, CASE WHEN p_sqi < 0.40 OR p_sqi > 0.90 THEN 'psqi_out_of_range' END, CASE WHEN k_sqi < 5 THEN 'low_kurtosis' END, CASE WHEN b_sqi < 0.85 THEN 'low_bsqi' END) AS flags,
  NOT missing AND NOT sat AND b_sqi >= 0.70 AND baseline_wander <= 0.30 AND muscle_noise <= 0.40 AS reliable, NOT missing AND NOT sat AND b_sqi >= 0.70 AND baseline_wander <= 0.30 AND muscle_noise < 0.30 AND powerline <= 0.15 AS p,
  NOT missing AND NOT sat AND b_sqi >= 0.70 AND muscle_noise <= 0.40 AND powerline <= 0.20 AS qrs, NOT missing AND NOT sat AND b_sqi >= 0.70 AND baseline_wander < 0.25 AND muscle_noise < 0.30 AND powerline < 0.12 AND flat_std > 0.02 AS t FROM m)
SELECT grade, flags, count(*) AS n, count(*) FILTER (p) AS for_p, count(*) FILTER (qrs) AS for_qrs, count(*) FILTER (t) AS for_t, count(*) FILTER (t AND qrs) AS for_qt FROM (SELECT *, CASE WHEN missing OR NOT qrs THEN 'Q3' WHEN NOT p OR NOT (t AND qrs) THEN 'Q2' WHEN flags <> '' OR NOT reliable THEN 'Q1' ELSE 'Q0' END AS grade FROM r) GROUP BY ALL""")
def lead_grades(spark, sf):
    """Leads by grade and flags, with what they are reliable for."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("lead"), *(F.expr(f"CAST({p} AS DOUBLE)").alias(n) for n, p in zip(_SCORES, _PARTS, strict=True)))
    g = Q.lead_grades(s).withColumn("flags", listed(F.col("flags")))
    return g.groupBy("grade", "flags").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f"reliable_for_{w}").alias(f"for_{w}") for w in ("p", "qrs", "t", "qt")))

"""Interval and axis queries over ``events``: values as intervals, event types as leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import circular_delta, median, quantile, rounded, with_means
from pulsequilt.operators import intervals as I
from pulsequilt.operators import rhythm as R
from pulsequilt.plans.registry import query
from pulsequilt.plans.rhythm import published
from pulsequilt.sources.adapters import MARKS_SQL, beats, marks, table

#: Five event types as limb leads.
LEAD_OF = {"view": "I", "signup": "II", "purchase": "aVR", "error": "aVL", "click": "aVF"}
LEAD_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEAD_OF.items()) + " END"
ANGLE_SQL = "CASE lead WHEN 'I' THEN 0.0 WHEN 'II' THEN 60.0 WHEN 'aVR' THEN -150.0 WHEN 'aVL' THEN -30.0 WHEN 'aVF' THEN 90.0 END"


def qt_values(spark, sf) -> DataFrame:
    """record_id, mark, qt, conf, t_amp: a QT for each event with conf of 0.2 at least."""
    m = marks(spark, sf).where("conf >= 0.2")
    return m.select("record_id", "mark", (240.0 + F.col("amp")).alias("qt"), "conf", (F.col("amp") / 100.0).alias("t_amp"))


QT_SQL = MARKS_SQL + ", qt AS (SELECT record_id, mark, 240 + amp AS qt, conf, amp / 100.0 AS t_amp FROM marks WHERE conf >= 0.2)\n"
CORE_SQL = QT_SQL + """, cv AS (SELECT record_id, stddev_pop(rr_prev) / avg(rr_prev) / 8 AS rr_cv FROM beats GROUP BY record_id),
cons AS (SELECT record_id, quantile_cont(qt, 0.9) AS consensus_qt, quantile_cont(qt, 0.1) AS low_qt FROM qt GROUP BY record_id)
"""


def consensus(spark, sf, which: float):
    cv = beats(spark, sf).groupBy("record_id").agg((F.stddev_pop("rr_prev") / F.avg("rr_prev") / 8).alias("rr_cv"))
    q = qt_values(spark, sf).groupBy("record_id").agg(F.array_sort(F.collect_list("qt")).alias("qt"))
    return q.select("record_id", quantile(F.col("qt"), which).alias("consensus_qt")).join(cv, "record_id")


@query(MARKS_SQL + """, x AS (SELECT record_id, median(240 + amp) AS qt, median(rr_prev) AS rr FROM beats GROUP BY record_id)
SELECT record_id, round(qt / sqrt(rr / 1000), 4) AS qtc_bazett_ms, round(qt / cbrt(rr / 1000), 4) AS qtc_fridericia_ms, round(qt + 154 * (1 - rr / 1000), 4) AS qtc_framingham_ms, round(qt + 1.75 * (60000 / rr - 60), 4) AS qtc_hodges_ms FROM x""")
def qtc_four(spark, sf):
    x = beats(spark, sf).groupBy("record_id").agg(median(240.0 + F.col("amp")).alias("qt"), median("rr_prev").alias("rr"))
    return x.select("record_id", *(rounded(v, 4).alias(k) for k, v in I.rate_corrected(F.col("qt"), F.col("rr")).items()))


@query(QT_SQL + """, d AS (SELECT record_id, qt, count(*) OVER w AS n, max(qt) OVER w - qt AS span FROM qt WINDOW w AS (PARTITION BY record_id ORDER BY qt RANGE BETWEEN CURRENT ROW AND 45 FOLLOWING)),
b AS (SELECT record_id, span FROM d WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY n DESC, span) = 1),
s AS (SELECT record_id, count(*) AS n_leads, max(qt) - min(qt) AS ind, quantile_cont(qt, 0.9) - quantile_cont(qt, 0.1) AS pp FROM qt GROUP BY record_id HAVING count(*) >= 2)
SELECT s.record_id, n_leads, round(ind, 4) AS independent_ms, round(pp, 4) AS p90_p10_ms, round(CASE WHEN ind >= 80 AND span IS NOT NULL THEN span ELSE ind END, 4) AS legacy_ms, CASE WHEN ind >= 80 AND span IS NOT NULL THEN 'legacy_compact_cluster_range' ELSE 'independent_reliable_lead_range' END AS source FROM s LEFT JOIN b USING (record_id)""")
def qt_dispersion(spark, sf):
    return published(I.dispersion(qt_values(spark, sf)), "record_id", "n_leads", "source", independent_ms="independent_ms", p90_p10_ms="p90_p10_ms", legacy_ms="legacy_ms")


@query(QT_SQL + """, w AS (SELECT *, sum(wt) OVER (PARTITION BY record_id ORDER BY qt, mark ROWS UNBOUNDED PRECEDING) AS run, sum(wt) OVER (PARTITION BY record_id ORDER BY qt, mark ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM (SELECT *, greatest(1e-6, abs(t_amp) * (conf + 0.1) / 15) AS wt FROM qt))
SELECT record_id, round(min(qt), 4) AS weighted_median FROM w WHERE run >= total / 2 GROUP BY record_id""")
def qt_weighted_median(spark, sf):
    x = qt_values(spark, sf).withColumn("w", F.greatest(F.lit(1e-6), F.abs("t_amp") * (F.col("conf") + 0.1) / 15.0))
    return published(I.weighted_median(x, "qt", "w", "mark"), "record_id", weighted_median="weighted_median")


@query(CORE_SQL + """, d AS (SELECT record_id, count(*) OVER w AS n, quantile_cont(qt, 0.5) OVER w AS mid FROM qt WINDOW w AS (PARTITION BY record_id ORDER BY qt RANGE BETWEEN CURRENT ROW AND 45 FOLLOWING)),
f AS (SELECT record_id, n, mid FROM d JOIN cv USING (record_id) JOIN cons USING (record_id) WHERE n >= CASE WHEN coalesce(rr_cv >= 0.12, false) THEN 3 ELSE 5 END AND consensus_qt - mid >= CASE WHEN coalesce(rr_cv >= 0.12, false) THEN 25 ELSE 35 END)
SELECT record_id, n AS n_leads, round(mid, 4) AS core_qt_ms FROM f QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY n DESC, mid DESC) = 1""")
def qt_raw_core(spark, sf):
    return published(I.raw_core(qt_values(spark, sf), consensus(spark, sf, 0.9)), "record_id", "n_leads", core_qt_ms="core_qt_ms")


@query(CORE_SQL + """, d AS (SELECT record_id, count(*) OVER w AS n, quantile_cont(qt, 0.5) OVER w AS mid, max(qt) OVER w - qt AS span, count(*) OVER (PARTITION BY record_id) AS total FROM qt WINDOW w AS (PARTITION BY record_id ORDER BY qt RANGE BETWEEN CURRENT ROW AND 35 FOLLOWING)),
f AS (SELECT record_id, n, mid, span FROM d JOIN cv USING (record_id) JOIN cons USING (record_id) WHERE coalesce(rr_cv < 0.12, true) AND n >= greatest(4.0, total * 0.5) AND mid - low_qt >= 20)
SELECT record_id, n AS n_leads, round(mid, 4) AS late_qt_ms FROM f QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY n DESC, mid DESC, span) = 1""")
def qt_late_cluster(spark, sf):
    return published(I.late_cluster(qt_values(spark, sf), consensus(spark, sf, 0.1)), "record_id", "n_leads", late_qt_ms="late_qt_ms")


@query(MARKS_SQL + """, b AS (SELECT record_id, beat_id, 280 + 2 * amp AS qt FROM beats WHERE 280 + 2 * amp BETWEEN 300 AND 520),
q AS (SELECT *, quantile_cont(qt, 0.25) OVER (PARTITION BY record_id) AS q1, quantile_cont(qt, 0.75) OVER (PARTITION BY record_id) AS q3 FROM b)
SELECT record_id, count(*) AS n_beats, round(median(qt), 4) AS core_qt_ms FROM q WHERE qt BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY record_id HAVING count(*) >= 5""")
def qt_irregular_core(spark, sf):
    return published(I.irregular_core(beats(spark, sf).select("record_id", "beat_id", (280.0 + 2.0 * F.col("amp")).alias("qt"))), "record_id", "n_beats", core_qt_ms="core_qt_ms")


GRADE_SQL = "CASE WHEN avg(conf) < 0.45 THEN 'Q3' WHEN avg(conf) < 0.5 THEN 'Q2' WHEN avg(conf) < 0.52 THEN 'Q1' ELSE 'Q0' END"


@query(MARKS_SQL + f""", x AS (SELECT record_id, median(240 + amp) AS qt, median(rr_prev) AS rr, {GRADE_SQL} AS grade, CASE WHEN count(*) FILTER (conf >= 0.9) < 5 THEN 'fallback' WHEN count(*) FILTER (conf >= 0.9) < 8 THEN 'low_confidence' ELSE 'reliable' END AS rel FROM beats GROUP BY record_id),
y AS (SELECT *, rel IN ('fallback', 'low_confidence') AND grade IN ('Q2', 'Q3') AS rejected FROM x)
SELECT record_id, grade, rel AS qt_reliability, rejected, CASE WHEN NOT rejected THEN round(qt, 4) END AS qt_ms, CASE WHEN NOT rejected THEN round(qt / sqrt(rr / 1000), 4) END AS qtc_bazett_ms FROM y""")
def qt_reject_gate(spark, sf):
    b, mean = with_means(beats(spark, sf), {"record_id": F.col("record_id")}, ["us", "mark"], conf="conf")
    c = mean["conf"]
    grade = F.when(c < 0.45, "Q3").when(c < 0.5, "Q2").when(c < 0.52, "Q1").otherwise("Q0")
    sure = F.count_if(F.col("conf") >= 0.9)
    x = b.groupBy("record_id").agg(median(240.0 + F.col("amp")).alias("qt_ms"), median("rr_prev").alias("rr"), grade.alias("grade"), F.when(sure < 5, "fallback").when(sure < 8, "low_confidence").otherwise("reliable").alias("qt_reliability"))
    x = x.withColumn("qtc_bazett_ms", I.rate_corrected(F.col("qt_ms"), F.col("rr"))["qtc_bazett_ms"])
    return published(I.reject_gate(x), "record_id", "grade", "qt_reliability", "rejected", qt_ms="qt_ms", qtc_bazett_ms="qtc_bazett_ms")


@query("""WITH r AS (SELECT d.source AS record, CASE WHEN toxic = 1 THEN NULL ELSE (n_chars % 97) - 30 END AS err, CASE WHEN quality IS NULL THEN NULL ELSE (n_chars % 11) / 10.0 END AS conf FROM labels l JOIN documents d USING (doc_id)),
x AS (SELECT record, CASE WHEN conf IS NULL OR conf < 0 OR conf > 1 THEN 'missing' ELSE CAST(CAST(least(4, floor(conf * 5)) AS INTEGER) AS VARCHAR) END AS bin, CASE WHEN abs(err) > 40 THEN 1.0 ELSE 0.0 END AS bad, 1.0 / count(*) OVER (PARTITION BY record) AS w FROM r WHERE err IS NOT NULL),
o AS (SELECT sum(bad * w) / count(DISTINCT record) AS overall FROM x)
SELECT bin, count(DISTINCT record) AS n_records, round((sum(bad * w) + 3 * any_value(overall)) / (sum(w) + 3), 6) AS risk FROM x, o GROUP BY bin""")
def qt_calibration(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    rows = d.select(F.col("source").alias("record"), F.when(F.col("toxic") != 1, (F.col("n_chars") % 97 - 30).cast("double")).alias("error_ms"), ((F.col("n_chars") % 11) / F.lit(10.0)).alias("confidence"))
    return I.error_risk(rows).select("bin", "n_records", rounded(F.col("risk")).alias("risk"))


@query(MARKS_SQL + """, l AS (SELECT * FROM (VALUES ('view', 60.0, 350.0), ('click', 35.0, 180.0), ('error', 40.0, 220.0), ('signup', 240.0, 700.0), ('purchase', 120.0, 650.0)) v(kind, lo, hi))
SELECT record_id, m.kind, count(*) AS n, count(*) FILTER (30 + amp BETWEEN lo AND hi) AS n_valid, round(median(30 + amp) FILTER (30 + amp BETWEEN lo AND hi), 4) AS median_ms FROM marks m JOIN l USING (kind) GROUP BY ALL""")
def valid_range(spark, sf):
    name = {"view": "pr", "click": "p_duration", "error": "qrs", "signup": "qt", "purchase": "jt"}
    v = 30.0 + F.col("amp")
    kept = F.coalesce(*(F.when(F.col("kind") == k, I.in_range(n, v)) for k, n in name.items()))
    x = marks(spark, sf).withColumn("kept", kept).groupBy("record_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("n_valid"), median("kept").alias("m"))
    return published(x, "record_id", "kind", "n", "n_valid", median_ms="m")


@query(MARKS_SQL + """, x AS (SELECT record_id, kind, amp - 40 AS v FROM marks WHERE amp <> 40), s AS (SELECT record_id, kind, sign(v) AS side, count(*) AS n, median(v) AS m FROM x GROUP BY ALL)
SELECT record_id, kind, CAST(side AS INTEGER) AS polarity, round(m, 4) AS value FROM s QUALIFY row_number() OVER (PARTITION BY record_id, kind ORDER BY n DESC, side DESC) = 1""")
def mode_polarity(spark, sf):
    """The median of the side (sign) that most values are on; ties are positive."""
    x = marks(spark, sf).withColumn("v", F.col("amp") - 40.0).where("v <> 0").groupBy("record_id", "kind", F.signum("v").alias("side")).agg(F.count(F.lit(1)).alias("n"), median("v").alias("m"))
    x = x.groupBy("record_id", "kind").agg(F.max(F.struct("n", "side", "m")).alias("b"))
    return x.select("record_id", "kind", F.col("b.side").cast("int").alias("polarity"), rounded(F.col("b.m"), 4).alias("value"))


@query(MARKS_SQL + """, x AS (SELECT *, allowed FROM (SELECT record_id, mark, kind, 240 + amp AS qt, 80 + amp / 3 AS qrs, kind = 'error' AS paced FROM marks) t, LATERAL (SELECT CASE WHEN paced THEN 'paced_jt' WHEN qrs >= 120 THEN 'wide_qrs_jt' ELSE 'normal_qrs' END AS path) p, LATERAL (SELECT CASE WHEN path = 'normal_qrs' THEN qt BETWEEN 240 AND 700 ELSE qt - qrs BETWEEN 160 AND 550 END AS allowed) a)
SELECT record_id, path, count(*) AS n, count(*) FILTER (allowed) AS n_allowed FROM x GROUP BY ALL""")
def qt_paths(spark, sf):
    x = marks(spark, sf).select("record_id", (240.0 + F.col("amp")).alias("qt"), (80.0 + F.col("amp") / 3.0).alias("qrs"), (F.col("kind") == "error").alias("paced"))
    x = x.withColumn("path", I.path(F.col("qrs"), F.col("paced"))).withColumn("ok", I.allowed(F.col("qt"), F.col("qrs"), F.col("path")))
    return x.groupBy("record_id", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_allowed"))


def lead_values(spark, sf) -> DataFrame:
    """record_id, lead, value, conf: medians by record of what stands for limb leads."""
    lead = F.create_map(*(F.lit(v) for kv in LEAD_OF.items() for v in kv))[F.col("kind")]
    m, mean = with_means(marks(spark, sf), {"record_id": F.col("record_id"), "lead": lead}, ["mark"], conf="conf")
    return m.groupBy("record_id", "lead").agg((median("amp") - 30.0).alias("value"), mean["conf"].alias("conf"))


AXIS_SQL = MARKS_SQL + f""", v AS (SELECT record_id, {LEAD_SQL} AS lead, median(amp) - 30 AS value, avg(conf) AS conf FROM marks GROUP BY ALL),
a AS (SELECT record_id, count(*) AS n_leads, degrees(atan2(sum(value * greatest(0.1, conf) * sin(radians(th))), sum(value * greatest(0.1, conf) * cos(radians(th))))) AS axis FROM (SELECT *, {ANGLE_SQL} AS th FROM v) GROUP BY record_id HAVING sum(abs(value) * greatest(0.1, conf)) >= 1e-6)
"""


@query(AXIS_SQL + "SELECT record_id, n_leads, round(axis, 4) AS axis_deg FROM a")
def axis_frontal(spark, sf):
    return published(I.frontal_axis(lead_values(spark, sf)), "record_id", "n_leads", axis_deg="axis_deg")


@query(AXIS_SQL + """, p AS (SELECT record_id, axis, lag(axis) OVER (ORDER BY record_id) AS prev FROM a)
SELECT record_id, round(abs((axis - 45 + 180) - 360 * floor((axis - 45 + 180) / 360) - 180), 4) + 0.0 AS delta_deg FROM p""")
def axis_delta(spark, sf):
    """The angle between a record's axis and 45 degrees."""
    x = I.frontal_axis(lead_values(spark, sf))
    return x.select("record_id", rounded(circular_delta(F.col("axis_deg"), F.lit(45.0)), 4).alias("delta_deg"))


@query(AXIS_SQL + f""", g AS (SELECT record_id, lead, value / 100 AS amp, conf, value * 3 AS area, conf < 0.47 AS confused, {ANGLE_SQL} AS th FROM v),
ok AS (SELECT * FROM g WHERE conf >= 0.42 AND abs(amp) >= 0.05 AND conf >= 0.45 AND abs(area) >= 1e-12),
f AS (SELECT record_id, CASE WHEN sum(abs(area) * greatest(0.1, conf)) >= 1e-6 THEN degrees(atan2(sum(area * greatest(0.1, conf) * sin(radians(th))), sum(area * greatest(0.1, conf) * cos(radians(th))))) END AS first FROM ok GROUP BY record_id HAVING count(*) >= 2),
k AS (SELECT ok.* FROM ok JOIN f USING (record_id) WHERE NOT (confused OR coalesce(abs(cos(radians(first - th))) >= 0.15 AND sign(area) <> sign(cos(radians(first - th))), false))),
s AS (SELECT record_id, count(*) AS n_leads, CASE WHEN sum(abs(area) * greatest(0.1, conf)) >= 1e-6 THEN degrees(atan2(sum(area * greatest(0.1, conf) * sin(radians(th))), sum(area * greatest(0.1, conf) * cos(radians(th))))) END AS axis FROM k GROUP BY record_id HAVING count(*) >= 2)
SELECT record_id, n_leads, round(axis, 4) AS axis_deg FROM (SELECT DISTINCT record_id FROM v) LEFT JOIN s USING (record_id)""")
def t_axis_cluster(spark, sf):
    v = lead_values(spark, sf)
    x = v.select("record_id", "lead", (F.col("conf") >= 0.42).alias("reliable"), (F.col("value") / 100.0).alias("amp"), "conf", (F.col("value") * 3.0).alias("area"), (F.col("conf") < 0.47).alias("confused"))
    return published(I.t_axis(x), "record_id", "n_leads", axis_deg="axis_deg")


@query(MARKS_SQL + """, b AS (SELECT record_id, mark % 6 + 1 AS idx, median(amp) - 38 AS value FROM marks GROUP BY ALL), x AS (SELECT *, lead(value) OVER w AS nv, lead(idx) OVER w AS ni FROM b WINDOW w AS (PARTITION BY record_id ORDER BY idx)),
z AS (SELECT record_id, idx, CASE WHEN value = 0 THEN idx WHEN value < 0 AND nv >= 0 THEN idx - value / (nv - value) * (ni - idx) END AS zone FROM x WHERE nv IS NOT NULL)
SELECT r.record_id, round(arg_min(zone, idx) FILTER (zone IS NOT NULL), 4) AS transition_zone FROM (SELECT DISTINCT record_id FROM b) r LEFT JOIN z ON r.record_id = z.record_id GROUP BY r.record_id""")
def transition_zone(spark, sf):
    b = marks(spark, sf).groupBy("record_id", (F.col("mark") % 6 + 1).alias("idx")).agg((median("amp") - 38.0).alias("value"))
    return published(I.transition_zone(b), "record_id", transition_zone="transition_zone")


@query(MARKS_SQL + """, pp AS (SELECT record_id, (us - lag(us) OVER (PARTITION BY record_id ORDER BY us, mark)) / 3e7 AS pp FROM marks WHERE kind = 'view')
SELECT record_id, count(pp) AS n_pp, round(60000 / median(pp), 4) AS atrial_rate_bpm FROM pp WHERE pp BETWEEN 250 AND 2000 GROUP BY record_id""")
def atrial_rate(spark, sf):
    w = Window.partitionBy("record_id").orderBy("us", "mark")
    pp = marks(spark, sf).where("kind = 'view'").withColumn("pp", (F.col("us") - F.lag("us").over(w)) / F.lit(3e7)).where(F.col("pp").between(250.0, 2000.0))
    return published(pp.groupBy("record_id").agg(F.count("pp").alias("n_pp"), (60000.0 / median("pp")).alias("rate")), "record_id", "n_pp", atrial_rate_bpm="rate")


@query(MARKS_SQL + """, x AS (SELECT record_id, stddev_pop(rr_prev) / (median(rr_prev) + 1e-6) / 3 AS cv, count(*) AS n, count(DISTINCT kind) FILTER (conf >= 0.97) AS p_leads, median(amp) * 6 AS pr, max(amp) - min(amp) AS spread, bool_and(kind = 'error') AS paced FROM beats GROUP BY record_id)
SELECT record_id, paced OR (n >= 6 AND cv >= 0.15 AND p_leads < 2) AS p_measurements_invalid, coalesce(n >= 6 AND cv >= 0.15 AND p_leads >= 2 AND (pr >= 240 OR spread >= 120), false) AS pr_association_invalid FROM x""")
def atrial_validity(spark, sf):
    """Whether a record's P waves, or their association with QRS complexes, can't be measured."""
    x = beats(spark, sf).groupBy("record_id").agg((F.stddev_pop("rr_prev") / (median("rr_prev") + 1e-6) / 3).alias("cv"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("conf") >= 0.97, F.col("kind"))).alias("p"), (median("amp") * 6).alias("pr"), (F.max("amp") - F.min("amp")).alias("spread"), F.bool_and(F.col("kind") == "error").alias("paced"))
    rough = (F.col("n") >= 6) & (F.col("cv") >= 0.15)
    return x.select("record_id", (F.col("paced") | (rough & (F.col("p") < 2))).alias("p_measurements_invalid"), F.coalesce(rough & (F.col("p") >= 2) & ((F.col("pr") >= 240) | (F.col("spread") >= 120)), F.lit(False)).alias("pr_association_invalid"))

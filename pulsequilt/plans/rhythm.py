"""Rhythm queries over ``events`` as beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import listed, median, rounded
from pulsequilt.operators import rhythm as R
from pulsequilt.plans.registry import query
from pulsequilt.sources.adapters import MARKS_SQL, beats, marks


def published(df: DataFrame, *keys: str, digits: int = 4, **values: str) -> DataFrame:
    """The keys as they are and each value rounded; name=column."""
    return df.select(*keys, *(rounded(F.col(c), digits).alias(n) for n, c in values.items()))


@query(MARKS_SQL + "SELECT record_id, beat_id, round(rr_prev, 4) AS rr_prev_ms, round(rr_next, 4) AS rr_next_ms FROM beats")
def rr_interval(spark, sf):
    return published(beats(spark, sf), "record_id", "beat_id", rr_prev_ms="rr_prev", rr_next_ms="rr_next")


@query(MARKS_SQL + "SELECT record_id, count(*) AS n_beats, round(median(rr_prev), 4) AS median_rr_ms, round(60000.0 / median(rr_prev), 4) AS heart_rate_bpm FROM beats GROUP BY record_id")
def heart_rate(spark, sf):
    return published(R.heart_rate(beats(spark, sf)), "record_id", "n_beats", median_rr_ms="median_rr_ms", heart_rate_bpm="heart_rate_bpm")


RR_SQL = MARKS_SQL + ", rr AS (SELECT record_id, beat_id, rr_prev AS rr, rr_prev - lag(rr_prev) OVER (PARTITION BY record_id ORDER BY beat_id) AS diff FROM beats WHERE rr_prev IS NOT NULL)\n"


@query(RR_SQL + """, s AS (SELECT record_id, count(*) AS n_rr, stddev_samp(rr) AS sd, stddev_pop(rr) / avg(rr) AS cv, sqrt(avg(diff * diff)) AS rmssd,
  avg(CASE WHEN abs(diff) > 50 THEN 1.0 WHEN diff IS NOT NULL THEN 0.0 END) AS pnn50, stddev_samp(diff) / sqrt(2.0) AS sd1, var_samp(rr) AS v FROM rr GROUP BY record_id)
SELECT record_id, n_rr, round(sd, 4) AS rr_sd_ms, round(CASE WHEN n_rr > 1 THEN cv END, 4) AS rr_cv, round(rmssd, 4) AS rmssd_ms, round(pnn50, 4) AS pnn50, round(sd1, 4) AS sd1_ms,
  round(CASE WHEN n_rr > 2 THEN sqrt(greatest(0.0, 2 * v - sd1 * sd1)) END, 4) AS sd2_ms FROM s""")
def hrv_time_domain(spark, sf):
    return published(R.time_domain(beats(spark, sf)), "record_id", "n_rr", rr_sd_ms="rr_sd_ms", rr_cv="rr_cv", rmssd_ms="rmssd_ms", pnn50="pnn50", sd1_ms="sd1_ms", sd2_ms="sd2_ms")


@query(RR_SQL + """, h AS (SELECT record_id, floor(rr / 20.0) AS bin, count(*) AS n FROM rr GROUP BY ALL), p AS (SELECT record_id, n, n / sum(n) OVER (PARTITION BY record_id) AS p FROM h)
SELECT record_id, CAST(sum(n) AS BIGINT) AS n_rr, CASE WHEN sum(n) >= 3 THEN round(-sum(p * log2(p)), 4) + 0.0 END AS rr_entropy_bits FROM p GROUP BY record_id""")
def rr_entropy(spark, sf):
    return published(R.interval_entropy(beats(spark, sf)), "record_id", "n_rr", rr_entropy_bits="rr_entropy_bits")


MEDIAN_SQL = MARKS_SQL + ", m AS (SELECT *, median(rr_prev) OVER (PARTITION BY record_id) AS median_rr FROM beats)\n"


@query(MEDIAN_SQL + """SELECT record_id, beat_id, CASE WHEN rr_prev IS NULL OR rr_prev <= 0 OR median_rr <= 0 THEN 'unknown' WHEN rr_prev / median_rr < 0.75 THEN 'short_rr' WHEN rr_prev / median_rr > 1.25 THEN 'long_rr' ELSE 'regular_rr' END AS context FROM m""")
def rr_context(spark, sf):
    return R.interval_context(beats(spark, sf)).select("record_id", "beat_id", "context")


@query(MEDIAN_SQL + """, d AS (SELECT *, abs(rr_prev - median_rr) AS dev FROM m WHERE rr_prev > 0)
SELECT record_id, round(any_value(median_rr), 4) AS median_rr_ms, round(1.4826 * median(dev) / any_value(median_rr), 4) AS robust_rr_cv, round(max(dev) / any_value(median_rr), 4) AS max_relative_rr_deviation FROM d GROUP BY record_id HAVING count(*) >= 2""")
def robust_rr_profile(spark, sf):
    return published(R.robust_profile(beats(spark, sf)), "record_id", median_rr_ms="median_rr_ms", robust_rr_cv="robust_rr_cv", max_relative_rr_deviation="max_relative_rr_deviation")


@query(MARKS_SQL + """SELECT record_id, count(*) AS n_rr, round(median(rr_prev), 4) AS baseline_rr_ms, round(max(rr_prev), 4) AS longest_pause_ms, count(*) >= 3 AND max(rr_prev) > 1.4 * median(rr_prev) AS pauses_detected
FROM beats WHERE rr_prev > 0 GROUP BY record_id""")
def pauses(spark, sf):
    return published(R.pauses(beats(spark, sf)), "record_id", "n_rr", "pauses_detected", baseline_rr_ms="baseline_rr_ms", longest_pause_ms="longest_pause_ms")


@query(MARKS_SQL + """, pr AS (SELECT record_id, beat_id, CASE WHEN kind = 'error' THEN NULL ELSE 60 + amp END AS pr FROM beats),
x AS (SELECT *, lag(pr, 2) OVER w AS b2, lag(pr) OVER w AS b1, lead(pr) OVER w AS a1, lead(pr, 2) OVER w AS a2 FROM pr WINDOW w AS (PARTITION BY record_id ORDER BY beat_id)),
y AS (SELECT *, (b2 IS NOT NULL)::INT + (b1 IS NOT NULL)::INT AS nb, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT AS na, greatest(b2, b1, a1, a2) - least(b2, b1, a1, a2) AS spread FROM x WHERE pr IS NULL)
SELECT record_id, beat_id, CASE WHEN nb = 2 AND b1 - b2 >= 10 THEN 'mobitz_i' WHEN nb + na >= 2 AND ((nb >= 1 AND na >= 1) OR nb >= 2) AND spread <= 20 THEN 'mobitz_ii' ELSE 'second_degree_av_block' END AS av_block FROM y""")
def mobitz_type(spark, sf):
    pr = beats(spark, sf).withColumn("pr", F.when(F.col("kind") != "error", 60.0 + F.col("amp")))
    around = {f"{n}{k}": f("pr", k).over(R.in_time()) for n, f in (("before", F.lag), ("after", F.lead)) for k in (1, 2)}
    return R.second_degree_type(pr.withColumns(around).where("pr is null")).select("record_id", "beat_id", "av_block")


@query(MARKS_SQL + """, p AS (SELECT record_id, beat_id, median(60 + amp) AS pr FROM beats WHERE 60 + amp > 60 AND 60 + amp < 600 GROUP BY ALL),
s AS (SELECT record_id, count(*) AS n, max(pr) - min(pr) AS span, stddev_pop(pr) AS sd FROM p GROUP BY record_id),
r AS (SELECT record_id, 60000.0 / median(rr_prev) AS hr, 60000.0 / median(rr_prev) FILTER (kind IN ('view', 'click')) AS ar FROM beats GROUP BY record_id),
x AS (SELECT r.record_id, coalesce(n >= 3 AND span > 80 AND sd > 30, false) AS apart, coalesce(ar > hr + 5, false) AS faster, hr FROM r LEFT JOIN s USING (record_id))
SELECT record_id, apart AS av_dissociation, faster AS atrial_faster_than_ventricular, coalesce(hr < 45 AND (apart OR faster), false) AS complete_av_block FROM x""")
def av_dissociation(spark, sf):
    b = beats(spark, sf)
    rates = b.groupBy("record_id").agg((60000.0 / median("rr_prev")).alias("heart_rate_bpm"), (60000.0 / median(F.when(F.col("kind").isin("view", "click"), F.col("rr_prev")))).alias("atrial_rate_bpm"))
    return R.av_flags(b.select("record_id", "beat_id", (60.0 + F.col("amp")).alias("pr_ms")), rates)


@query(MEDIAN_SQL + """SELECT record_id, beat_id, 'escape_candidate' AS type FROM m WHERE median_rr > 0 AND rr_prev > 1.4 * median_rr
UNION ALL SELECT record_id, beat_id, 'interpolated_candidate' FROM m WHERE median_rr > 0 AND abs(rr_prev + rr_next - median_rr) <= 0.15 * median_rr""")
def interpolated_beats(spark, sf):
    return R.escape_or_interpolated(beats(spark, sf))


@query(MARKS_SQL + """, b AS (SELECT record_id, kind = 'error' AS paced, amp FROM beats WHERE kind <> 'view'),
x AS (SELECT record_id, count(*) AS n, count(*) FILTER (paced) AS np, coalesce(bool_or(paced AND amp >= 120), false) AS wide FROM b GROUP BY record_id),
s AS (SELECT record_id, count(*) AS k FROM beats WHERE kind = 'view' GROUP BY record_id)
SELECT x.record_id, coalesce(k, 0) > 0 OR np > 0 AS enabled, coalesce(k, 0) AS spike_count, round(np / n, 6) AS paced_fraction, np = n AS continuous_pacing, np > 0 AND np < n AS intermittent_pacing, wide AS ventricular_pacing_present, np = n AND wide AS suppress_rhythm
FROM x LEFT JOIN s USING (record_id)""")
def pacing_context(spark, sf):
    b = beats(spark, sf)
    x = R.pacing_context(b.where("kind <> 'view'").select("record_id", (F.col("kind") == "error").alias("paced"), F.col("amp").alias("qrs_ms")), b.where("kind = 'view'").select("record_id"))
    return x.withColumn("paced_fraction", rounded(F.col("paced_fraction")))


@query(MARKS_SQL + """SELECT record_id, mark AS beat FROM marks q WHERE kind = 'purchase' AND EXISTS (SELECT 1 FROM marks s WHERE s.record_id = q.record_id AND s.kind = 'error' AND (s.us - q.us) / 3e7 BETWEEN -160 AND 20)""")
def pacing_capture(spark, sf):
    m = marks(spark, sf)
    return R.within(m.where("kind = 'purchase'"), m.where("kind = 'error'").select("record_id", F.col("us").alias("at")), -160.0, 20.0, "left_semi").select("record_id", F.col("mark").alias("beat"))


@query(MARKS_SQL + """, f AS (SELECT record_id, NOT EXISTS (SELECT 1 FROM marks q WHERE q.record_id = s.record_id AND q.kind = 'purchase' AND (q.us - s.us) / 3e7 BETWEEN 0 AND 160) AS missed FROM marks s WHERE kind = 'error')
SELECT record_id, count(*) AS spike_count, count(*) FILTER (missed) AS capture_failure_count, round(count(*) FILTER (missed) / count(*), 6) AS capture_failure_fraction,
  count(*) >= 3 AND count(*) > count(*) FILTER (missed) AND count(*) FILTER (missed) >= 2 AND count(*) FILTER (missed) / count(*) <= 0.5 AS capture_failure_suspected FROM f GROUP BY record_id""")
def pacing_failures(spark, sf):
    m = marks(spark, sf)
    x = R.pacing_failures(m.where("kind = 'error'"), m.where("kind = 'purchase'").select("record_id", F.col("us").alias("at")))
    return x.withColumn("capture_failure_fraction", rounded(F.col("capture_failure_fraction")))


@query(MARKS_SQL + """, q AS (SELECT record_id, beat_id, us AS at, lead(us) OVER (PARTITION BY record_id ORDER BY us, beat_id) AS until FROM beats WHERE kind IN ('purchase', 'signup'))
SELECT q.record_id, q.beat_id, count(a.us) AS atrial_events FROM q LEFT JOIN marks a ON a.record_id = q.record_id AND a.kind IN ('view', 'click') AND a.us >= q.at AND a.us < q.until WHERE until IS NOT NULL GROUP BY ALL""")
def atrial_per_rr(spark, sf):
    b = beats(spark, sf)
    return R.events_per_interval(b.where("kind in ('view', 'click')"), b.where("kind in ('purchase', 'signup')").select("record_id", "beat_id", F.col("us").alias("at")))


ASSOCIATED_SQL = MARKS_SQL + """, q AS (SELECT record_id, beat_id, us AS onset, us + 1800000000 AS "offset" FROM beats WHERE kind IN ('purchase', 'signup')),
t AS (SELECT record_id, us AS start, us + 600000000 AS stop FROM marks WHERE kind = 'error'),
a AS (SELECT * FROM marks WHERE kind IN ('view', 'click')),
c AS (SELECT a.record_id, a.mark, (q.onset - a.us) / 3e7 AS gap, 0 AS way, q.beat_id AS qrs_beat_id FROM a JOIN q ON a.record_id = q.record_id AND (q.onset - a.us) / 3e7 BETWEEN 60 AND 280
  UNION ALL SELECT a.record_id, a.mark, (a.us - q."offset") / 3e7, 1, q.beat_id FROM a JOIN q ON a.record_id = q.record_id AND (a.us - q."offset") / 3e7 BETWEEN 0 AND 240),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, mark ORDER BY gap, way, qrs_beat_id) AS k FROM c) WHERE k = 1),
f AS (SELECT a.record_id, a.mark, a.us, a.conf, EXISTS (SELECT 1 FROM t WHERE t.record_id = a.record_id AND a.us BETWEEN t.start AND t.stop) AS artifact, b.gap, b.way, b.qrs_beat_id FROM a LEFT JOIN b ON a.record_id = b.record_id AND a.mark = b.mark),
e AS (SELECT record_id, mark, us, conf, CASE WHEN NOT artifact THEN qrs_beat_id END AS qrs_beat_id, CASE WHEN artifact THEN 't_wave_artifact' WHEN way IS NULL THEN 'blocked' WHEN way = 0 THEN 'conducted' ELSE 'retrograde' END AS association, CASE WHEN NOT artifact AND way = 0 THEN gap END AS pr_ms FROM f)
"""


def associated(spark, sf):
    b = beats(spark, sf)
    qrs = b.where("kind in ('purchase', 'signup')").select("record_id", "beat_id", F.col("us").alias("onset"), (F.col("us") + 1_800_000_000).alias("offset"))
    t = b.where("kind = 'error'").select("record_id", F.col("us").alias("start"), (F.col("us") + 600_000_000).alias("stop"))
    return R.associate(b.where("kind in ('view', 'click')").select("record_id", "mark", "us", "conf"), qrs, t)


@query(ASSOCIATED_SQL + "SELECT record_id, mark, qrs_beat_id, association, round(pr_ms, 4) AS pr_ms FROM e")
def event_association(spark, sf):
    return published(associated(spark, sf), "record_id", "mark", "qrs_beat_id", "association", pr_ms="pr_ms")


CONDUCTED_SQL = ASSOCIATED_SQL + ", k AS (SELECT * FROM e WHERE association = 'conducted' AND conf >= 0.3 AND pr_ms BETWEEN 80 AND 320)\n"
ORGANIZED_SQL = CONDUCTED_SQL + """, o AS (SELECT record_id, max(n) AS n FROM (SELECT x.record_id, x.mark, count(DISTINCT y.qrs_beat_id) AS n FROM k x JOIN k y ON x.record_id = y.record_id AND abs(x.pr_ms - y.pr_ms) <= 30 GROUP BY ALL) GROUP BY record_id),
ratio AS (SELECT record_id, least(1.0, coalesce(o.n / z.n, 0.0)) AS organized_p_ratio FROM (SELECT record_id, count(*) AS n FROM beats GROUP BY record_id) z LEFT JOIN o USING (record_id)),
pm AS (SELECT record_id, qrs_beat_id, median(pr_ms) AS pr FROM k GROUP BY ALL), pd AS (SELECT record_id, abs(pr - median(pr) OVER (PARTITION BY record_id)) AS dev FROM pm),
scatter AS (SELECT record_id, count(*) AS n_beats, median(dev) * 1.4826 AS pr_dispersion_ms FROM pd GROUP BY record_id HAVING count(*) >= 4)
"""


@query(ORGANIZED_SQL + "SELECT record_id, round(organized_p_ratio, 6) + 0.0 AS organized_p_ratio FROM ratio")
def organized_p_ratio(spark, sf):
    return published(R.organized_ratio(associated(spark, sf), beats(spark, sf)), "record_id", digits=6, organized_p_ratio="organized_p_ratio")


@query(ORGANIZED_SQL + "SELECT record_id, n_beats, round(pr_dispersion_ms, 4) AS pr_dispersion_ms FROM scatter")
def pr_dispersion(spark, sf):
    return published(R.pr_scatter(associated(spark, sf)), "record_id", "n_beats", pr_dispersion_ms="pr_dispersion_ms")


@query(ASSOCIATED_SQL + """, pp AS (SELECT *, (us - lag(us) OVER (PARTITION BY record_id ORDER BY us, mark)) / 3e7 AS pp FROM e)
SELECT record_id, count(*) AS n_events, round(median(pp), 4) AS median_pp_ms, round(stddev_pop(pp) / avg(pp), 4) AS pp_cv, round(stddev_pop(pr_ms), 4) AS pr_sd_ms, count(*) FILTER (association = 'conducted') AS n_conducted, count(*) FILTER (association = 'blocked') AS n_blocked, count(*) FILTER (association = 'retrograde') AS n_retrograde FROM pp GROUP BY record_id""")
def contextual_atrial(spark, sf):
    e = associated(spark, sf).withColumn("pp", (F.col("us") - F.lag("us").over(Window.partitionBy("record_id").orderBy("us", "mark"))) / F.lit(3e7))
    counted = [F.count_if(F.col("association") == k).alias(f"n_{k}") for k in ("conducted", "blocked", "retrograde")]
    x = e.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_events"), median("pp").alias("m"), (F.stddev_pop("pp") / F.avg("pp")).alias("cv"), F.stddev_pop("pr_ms").alias("sd"), *counted)
    return published(x, "record_id", "n_events", "n_conducted", "n_blocked", "n_retrograde", median_pp_ms="m", pp_cv="cv", pr_sd_ms="sd")


@query(ORGANIZED_SQL + """, cv AS (SELECT record_id, CASE WHEN count(rr_prev) > 1 THEN stddev_pop(rr_prev) / (avg(rr_prev) + 1e-6) END AS rr_cv, avg(conf) AS rep, avg(CASE WHEN kind = 'click' THEN 1.0 ELSE 0.0 END) > 0.2 AS fc, median(conf) AS fconf FROM beats GROUP BY record_id),
j AS (SELECT cv.*, organized_p_ratio AS ratio, pr_dispersion_ms AS pd FROM cv JOIN ratio USING (record_id) LEFT JOIN scatter USING (record_id)),
v AS (SELECT *, CASE WHEN ratio BETWEEN 0.45 AND 0.75 AND pd IS NOT NULL THEN pd > 20 ELSE ratio <= 0.6 END AS absent, fc AND fconf >= 0.6 AS strong FROM j),
w AS (SELECT *, coalesce(rr_cv >= 0.09 AND rr_cv < 0.12 AND absent AND NOT strong, false) AS near, fc AND fconf >= 0.5 AND fconf < 0.6 AS border, coalesce(rr_cv >= 0.12 AND absent AND rep < 0.55, false) AS af FROM v)
SELECT record_id, round(rr_cv, 4) AS rr_cv, CASE WHEN near OR border THEN 'indeterminate' WHEN strong THEN 'flutter' WHEN af THEN 'af' ELSE 'none' END AS verdict, concat_ws(',', CASE WHEN border THEN 'borderline_multilead_F_wave_pattern' END, CASE WHEN near THEN 'mild_rr_irregularity_with_absent_organized_p' END) AS reasons FROM w""")
def af_classify(spark, sf):
    b, e = beats(spark, sf), associated(spark, sf)
    cv = b.groupBy("record_id").agg(F.when(F.count("rr_prev") > 1, F.stddev_pop("rr_prev") / (F.avg("rr_prev") + 1e-6)).alias("rr_cv"), F.avg("conf").alias("repetitiveness"), (F.avg(F.when(F.col("kind") == "click", 1.0).otherwise(0.0)) > 0.2).alias("flutter_consensus"), median("conf").alias("flutter_confidence"))
    x = R.fibrillation(cv.join(R.organized_ratio(e, b), "record_id").join(R.pr_scatter(e), "record_id", "left"))
    return x.select("record_id", rounded(F.col("rr_cv"), 4).alias("rr_cv"), "verdict", listed(F.col("why")).alias("reasons"))


@query(MARKS_SQL + """, g AS (SELECT *, sum(CASE WHEN (us - prev) / 3e7 > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY us, mark) AS cluster FROM (SELECT *, lag(us) OVER (PARTITION BY record_id ORDER BY us, mark) AS prev FROM marks))
SELECT record_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, count(DISTINCT kind) AS n_leads, round(avg(conf), 6) + 0.0 AS confidence, CAST(round(max(us) - min(us)) AS BIGINT) AS span_us FROM g GROUP BY ALL""")
def gap_clusters(spark, sf):
    m = marks(spark, sf)
    prev = F.lag("us").over(Window.partitionBy("record_id").orderBy("us", "mark"))
    x = R.islands(m.withColumn("prev", prev), (F.col("us") - F.col("prev")) / F.lit(3e7) > 400.0, "record_id")
    return x.groupBy("record_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("n_leads"), rounded(F.avg("conf")).alias("confidence"), (F.max("us") - F.min("us")).alias("span_us"))


RUNS_SQL = MARKS_SQL + ", rn AS (SELECT record_id, kind, max(n) AS longest_run FROM (SELECT record_id, kind, run, count(*) AS n FROM (SELECT *, beat_id - row_number() OVER (PARTITION BY record_id, kind ORDER BY beat_id) AS run FROM beats) GROUP BY ALL) GROUP BY ALL)\n"


@query(RUNS_SQL + "SELECT record_id, kind, longest_run FROM rn")
def runs(spark, sf):
    return R.longest_runs(beats(spark, sf))


@query(RUNS_SQL + """, g AS (SELECT record_id, kind, count(*) AS n_beats, avg(rr_prev) AS rr, avg(amp) + 1e-9 AS qrs FROM beats GROUP BY ALL)
SELECT g.record_id, g.kind, n_beats, round(n_beats / sum(n_beats) OVER (PARTITION BY g.record_id), 6) AS share, longest_run, round(rr, 4) AS mean_rr_ms, round(60000.0 / rr, 4) AS rate_bpm, round(qrs, 4) AS mean_qrs_ms, qrs >= 120 AS wide
FROM g JOIN rn ON g.record_id = rn.record_id AND g.kind = rn.kind""")
def group_features(spark, sf):
    b = beats(spark, sf)
    g = b.groupBy("record_id", "kind").agg(F.count(F.lit(1)).alias("n_beats"), F.avg("rr_prev").alias("rr"), (F.avg("amp") + 1e-9).alias("qrs")).join(R.longest_runs(b), ["record_id", "kind"])
    g = g.withColumn("share", F.col("n_beats") / F.sum("n_beats").over(R.by_record())).withColumn("rate", 60000.0 / F.col("rr"))
    return published(g.withColumns({"wide": F.col("qrs") >= 120, "share": rounded(F.col("share"))}), "record_id", "kind", "n_beats", "longest_run", "wide", "share", mean_rr_ms="rr", rate_bpm="rate", mean_qrs_ms="qrs")


@query(MARKS_SQL + "SELECT record_id, beat_id, kind FROM (SELECT *, count(*) OVER (PARTITION BY record_id, kind) AS n, min(beat_id) OVER (PARTITION BY record_id, kind) AS first FROM beats) QUALIFY dense_rank() OVER (PARTITION BY record_id ORDER BY n DESC, first) = 1")
def measurement_beats(spark, sf):
    """Beats of each record's dominant morphology group; of equal groups the one seen first."""
    w = Window.partitionBy("record_id", "kind")
    x = beats(spark, sf).withColumns({"n": F.count(F.lit(1)).over(w), "first": F.min("beat_id").over(w)})
    return x.withColumn("rank", F.dense_rank().over(R.by_record().orderBy(F.desc("n"), "first"))).where("rank = 1").select("record_id", "beat_id", "kind")


@query(MARKS_SQL + """, d AS (SELECT record_id, median(amp) FILTER (kind = 'view') AS pr, count(*) FILTER (kind = 'click' AND conf >= 0.5) AS deltas, median(amp) FILTER (kind = 'purchase') AS qrs, median(amp) FILTER (kind = 'signup') - 90 AS axis FROM beats GROUP BY record_id)
SELECT record_id, coalesce(pr < 120 AND deltas >= 2 AND qrs BETWEEN 20 AND 180, false) AS preexcitation, CASE WHEN axis < -30 THEN 'right_or_septal' WHEN axis > 90 THEN 'left' ELSE 'undetermined' END AS side FROM d""")
def preexcitation(spark, sf):
    """Short PR with at least two delta waves and a QRS width in range; the side by the initial axis."""
    at = lambda kind: median(F.when(F.col("kind") == kind, F.col("amp")))
    x = beats(spark, sf).groupBy("record_id").agg(at("view").alias("pr"), F.count_if((F.col("kind") == "click") & (F.col("conf") >= 0.5)).alias("deltas"), at("purchase").alias("qrs"), (at("signup") - 90.0).alias("axis"))
    return x.select("record_id", F.coalesce((F.col("pr") < 120) & (F.col("deltas") >= 2) & F.col("qrs").between(20, 180), F.lit(False)).alias("preexcitation"), F.when(F.col("axis") < -30, "right_or_septal").when(F.col("axis") > 90, "left").otherwise("undetermined").alias("side"))


@query(ASSOCIATED_SQL + """SELECT record_id, association, count(*) AS n, round(avg(conf), 6) + 0.0 AS mean_confidence FROM e GROUP BY record_id, association""")
def association_summary(spark, sf):
    """How a record's atrial events are associated."""
    return associated(spark, sf).groupBy("record_id", "association").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("conf")).alias("mean_confidence"))


@query(MARKS_SQL + """, s AS (SELECT record_id, beat_id - 1 AS idx, rr_prev AS rr, mark % 3 AS atrial, CASE WHEN kind = 'error' THEN NULL WHEN record_id % 3 = 0 THEN 150 + 12 * (beat_id % 4) ELSE 160 + CAST(floor(amp) AS BIGINT) % (12 + 12 * (record_id % 2)) END AS pr FROM beats WHERE beat_id > 0),
v AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY idx) - 1 AS idx, rr FROM s WHERE rr > 0),
b AS (SELECT record_id, count(*) AS n_rr, median(rr) AS base, max(rr) AS longest, median(rr) * 1.4 AS lim FROM v GROUP BY record_id),
c AS (SELECT record_id, count(*) AS n, count(*) FILTER (atrial > 1) AS excess, count(*) FILTER (atrial = 2) AS two, max(atrial) AS atrial_max, 90 + record_id % 60 AS qrs FROM s GROUP BY record_id),
x AS (SELECT s.*, v.rr AS rr_at, lag(pr, 2) OVER w AS b2, lag(pr) OVER w AS b1, lead(pr) OVER w AS a1, lead(pr, 2) OVER w AS a2 FROM s LEFT JOIN v USING (record_id, idx) WINDOW w AS (PARTITION BY s.record_id ORDER BY s.idx)),
y AS (SELECT x.*, (b2 IS NOT NULL)::INT + (b1 IS NOT NULL)::INT AS nb, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT AS na, greatest(b2, b1, a1, a2) - least(b2, b1, a1, a2) AS spread FROM x JOIN b USING (record_id) JOIN c USING (record_id) WHERE atrial > 1 AND rr_at > lim AND excess > 0 AND excess < n),
t AS (SELECT *, CASE WHEN nb = 2 AND b1 - b2 >= 10 THEN 'mobitz_i' WHEN nb + na >= 2 AND ((nb >= 1 AND na >= 1) OR nb >= 2) AND spread <= 20 THEN 'mobitz_ii' ELSE 'second_degree_av_block' END AS kind FROM y),
m AS (SELECT record_id, min(idx) FILTER (pr IS NULL AND kind <> 'second_degree_av_block') AS mob, min(idx) AS any_long, count(*) FILTER (pr IS NULL) AS n_drops FROM t GROUP BY record_id),
d AS (SELECT record_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS dropped, any_value(kind) FILTER (idx = mob) AS kind FROM t JOIN m USING (record_id) WHERE CASE WHEN n_drops = 0 THEN idx = any_long ELSE pr IS NULL AND (mob IS NULL OR idx <= mob) END GROUP BY record_id),
z AS (SELECT c.record_id, n_rr >= 3 AND longest > lim AS paused, longest, base, lim, CASE WHEN d.record_id IS NOT NULL THEN coalesce(kind, 'second_degree_av_block') END AS avb, coalesce(dropped, '') AS dropped, n >= 3 AND two = n AS two_to_one, qrs, atrial_max FROM c LEFT JOIN b USING (record_id) LEFT JOIN d USING (record_id))
SELECT record_id, paused AS pauses_detected, round(CASE WHEN paused THEN longest END, 1) AS pause_longest_ms, round(base, 4) AS baseline_rr_ms, round(lim, 4) AS threshold_ms, avb AS second_degree_avb, dropped, two_to_one,
  CASE avb WHEN 'mobitz_ii' THEN CASE WHEN qrs >= 120 THEN 'infranodal_suspected' ELSE 'infranodal_probable' END WHEN 'mobitz_i' THEN CASE WHEN qrs < 120 THEN 'av_nodal_probable' ELSE 'indeterminate' END ELSE CASE WHEN two_to_one THEN CASE WHEN qrs >= 120 THEN 'infranodal_suspected' ELSE 'indeterminate' END END END AS block_level_hint,
  CASE WHEN paused THEN CASE WHEN qrs >= 120 THEN 'ventricular' ELSE 'supraventricular' END END AS escape_origin, atrial_max FROM z""")
def av_block(spark, sf):
    """Pauses, dropped beats and the type of block of each record as one decision."""
    k = F.col("record_id")
    pr = F.when(F.col("kind") == "error", None).when(k % 3 == 0, 150 + 12 * (F.col("beat_id") % 4)).otherwise(160 + F.floor("amp") % (12 + 12 * (k % 2)))
    s = beats(spark, sf).where("beat_id > 0").select("record_id", (F.col("beat_id") - 1).alias("idx"), F.col("rr_prev").alias("rr"), pr.cast("double").alias("pr"), (F.col("mark") % 3).alias("atrial"))
    facts = s.select("record_id").distinct().withColumn("qrs_ms", 90.0 + k % 60)
    x = R.av_block(s, facts)
    return x.withColumns({"dropped": F.array_join(F.col("dropped").cast("array<string>"), ",")} | {c: rounded(F.col(c), 4) for c in ("baseline_rr_ms", "threshold_ms")})

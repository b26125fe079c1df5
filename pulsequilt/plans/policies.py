"""Queries of decisions, over facts made up from ``events``: a record's flags are digits of its number and shares of its marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import listed, median, rounded
from pulsequilt.operators import policies as P
from pulsequilt.plans.registry import query
from pulsequilt.sources.adapters import MARKS_SQL, marks

#: Flag k of a record is set where (record_id + k) modulo k + 3 is zero; null where the record's number ends in nine.
FLAGS = ("continuous_pacing", "wide_qrs_pacing_like_context", "probable_af", "probable_flutter", "af_afl_indeterminate", "complete_av_block", "av_dissociation", "atrial_measurements_invalid", "atrial_faster_than_ventricular", "dropped_p", "enabled", "global_paced", "capture_confirmed", "confirmed_context", "group_paced", "paced")
FACTS_SQL = MARKS_SQL + ", facts AS (SELECT record_id, " + ", ".join(f"CASE WHEN record_id % 10 <> 9 THEN (record_id + {k}) % {k + 3} = 0 END AS {name}" for k, name in enumerate(FLAGS)) + """, avg(conf) AS organized_p_ratio, median(amp) * 2 + 60 AS qrs_ms, count(*) FILTER (kind = 'view') % 4 AS n_floor, count(*) FILTER (kind = 'click') % 3 AS n_segmented, count(*) FILTER (kind = 'error') AS n_spikes, count(*) % 5 + 0.0 AS atrial_events_per_rr FROM marks GROUP BY record_id)
"""


def facts(spark, sf) -> DataFrame:
    number = lambda kind: F.count_if(F.col("kind") == kind)
    x = marks(spark, sf).groupBy("record_id").agg(F.avg("conf").alias("organized_p_ratio"), (median("amp") * 2 + 60).alias("qrs_ms"), (number("view") % 4).alias("n_floor"), (number("click") % 3).alias("n_segmented"), number("error").alias("n_spikes"), (F.count(F.lit(1)) % 5 + 0.0).alias("atrial_events_per_rr"))
    return x.withColumns({name: F.when(F.col("record_id") % 10 != 9, (F.col("record_id") + k) % (k + 3) == 0) for k, name in enumerate(FLAGS)})


_IF = "CASE WHEN {0} THEN '{1}' END"
_PR_BLOCKED = "coalesce(continuous_pacing OR wide_qrs_pacing_like_context OR probable_af OR probable_flutter OR complete_av_block OR atrial_measurements_invalid OR (av_dissociation AND (atrial_faster_than_ventricular OR complete_av_block)) OR (af_afl_indeterminate AND organized_p_ratio < 0.35), false)"


@query(FACTS_SQL + ", y AS (SELECT record_id, concat_ws(',', " + ", ".join(_IF.format(flag, name) for name, flag in P.UNAVAILABLE) + f") AS reasons, NOT {_PR_BLOCKED} AS pr_available, concat_ws(',', {_IF.format('af_afl_indeterminate', 'af_afl_indeterminate')}, {_IF.format('av_dissociation', 'av_dissociation')}) AS soft FROM facts) SELECT record_id, reasons, reasons = '' AS atrial_rhythm_available, reasons IN ('', 'wide_qrs_pacing_like_context') AS p_axis_available, pr_available, CASE WHEN pr_available THEN soft ELSE '' END AS pr_soft_reasons FROM y")
def measurement_availability(spark, sf):
    """Whether atrial rhythm, PR interval and P axis may be reported, and why not."""
    x = P.measurement_availability(facts(spark, sf))
    return x.select("record_id", listed(F.col("reasons")).alias("reasons"), "atrial_rhythm_available", "p_axis_available", "pr_available", listed(F.col("pr_soft_reasons")).alias("pr_soft_reasons"))


@query(FACTS_SQL + """, s AS (SELECT *, CASE record_id % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'unknown' ELSE 'off' END AS state FROM facts),
m AS (SELECT *, CASE WHEN NOT coalesce(enabled, false) THEN 'disabled' WHEN n_spikes = 0 THEN 'none' WHEN group_paced AND n_floor > 0 THEN 'segmentation_floor_and_global_paced_route' WHEN group_paced THEN 'global_paced_route' WHEN global_paced THEN 'intermittent_wide_qrs_paced_route' WHEN capture_confirmed AND n_floor > 0 THEN 'per_beat_segmentation_floor' ELSE 'metadata_only' END AS measurement_effect FROM s)
SELECT record_id, measurement_effect, CASE WHEN NOT coalesce(enabled, false) THEN 'disabled' WHEN n_spikes = 0 THEN 'none' WHEN n_floor > 0 AND group_paced THEN 'segmentation_floor' WHEN n_floor > 0 THEN 'per_beat_segmentation_floor' WHEN n_segmented > 0 AND group_paced THEN 'paced_segmentation' WHEN n_segmented > 0 THEN 'per_beat_segmentation' ELSE 'metadata_only' END AS segmentation_effect,
  CASE WHEN NOT coalesce(enabled, false) THEN 'off' WHEN confirmed_context OR measurement_effect IN ('segmentation_floor_and_global_paced_route', 'global_paced_route', 'intermittent_wide_qrs_paced_route', 'per_beat_segmentation_floor') THEN 'on' WHEN state IN ('on', 'unknown') THEN 'unknown' ELSE 'off' END AS measurement_state FROM m""")
def pacing_effects(spark, sf):
    """How pacing affects measurement and segmentation, and the state reported."""
    state = F.when(F.col("record_id") % 3 == 0, "on").when(F.col("record_id") % 3 == 1, "unknown").otherwise("off")
    return P.pacing_effects(facts(spark, sf).withColumn("state", state)).select("record_id", "measurement_effect", "segmentation_effect", "measurement_state")


@query(MARKS_SQL + "SELECT record_id, count(*) FILTER (conf >= 0.5) > count(*) / 2.0 AS group_paced FROM marks WHERE kind <> 'view' GROUP BY record_id")
def paced_measurement_group(spark, sf):
    """Whether most of a record's measured beats are paced."""
    return P.majority_paced(marks(spark, sf).where("kind <> 'view'").select("record_id", (F.col("conf") >= 0.5).alias("paced")))


@query(FACTS_SQL + """, a AS (SELECT record_id, count(*) AS n, median(abs(amp - 60)) AS med FROM marks WHERE kind = 'error' AND conf >= 0.6 GROUP BY record_id),
c AS (SELECT record_id, paced, coalesce(n, 0) AS n, coalesce(paced AND CASE WHEN record_id % 4 = 0 THEN record_id % 8 = 0 ELSE coalesce(n >= 2 AND med <= 55, false) END, false) AS confirmed FROM facts LEFT JOIN a USING (record_id))
SELECT record_id, confirmed, n AS n_aligned_spikes, CASE WHEN confirmed THEN 'accept' WHEN paced THEN 'reject' ELSE 'no_change' END AS action, CASE WHEN confirmed THEN 'ventricular_capture_alignment_confirmed' WHEN paced THEN 'capture_alignment_not_confirmed' ELSE 'pacing_not_detected' END AS reason FROM c""")
def capture_alignment(spark, sf):
    """Whether spikes are shown to capture the ventricle."""
    spikes = marks(spark, sf).where("kind = 'error' AND conf >= 0.6").select("record_id", (F.col("amp") - 60.0).alias("offset_ms"))
    x = facts(spark, sf).select("record_id", "paced", F.when(F.col("record_id") % 4 == 0, F.col("record_id") % 8 == 0).alias("supports_routing"))
    return P.capture_alignment(spikes, x).select("record_id", "confirmed", "n_aligned_spikes", "action", "reason")


@query(FACTS_SQL + """, g AS (SELECT record_id, mark % 5 AS grp, median(amp) * 2 + 50 AS q, mark % 5 = record_id % 7 AS dominant FROM marks GROUP BY ALL),
gw AS (SELECT record_id, coalesce(arg_min(q, grp) FILTER (dominant), median(q)) AS dominant_ms, coalesce(median(q) FILTER (q >= 150), median(q) FILTER (q >= 120)) AS wide_ms FROM g GROUP BY record_id),
l AS (SELECT record_id, kind, median(amp) * 2 + 60 AS q, max(conf) >= 0.4 AS ok FROM marks GROUP BY ALL),
lw AS (SELECT record_id, CASE WHEN count(*) FILTER (ok AND q BETWEEN 90 AND 180) >= 2 THEN median(q) FILTER (ok AND q BETWEEN 90 AND 180) END AS raw_ms FROM l GROUP BY record_id),
x AS (SELECT *, coalesce(qrs_ms >= 115, false) AND (coalesce(av_dissociation, false) OR coalesce(dropped_p, false)) AND (coalesce(atrial_measurements_invalid, false) OR atrial_events_per_rr >= 3) AS wide, coalesce(qrs_ms >= 160 AND dominant_ms <= 90 AND dropped_p, false) AS over FROM facts LEFT JOIN gw USING (record_id) LEFT JOIN lw USING (record_id)),
o AS (SELECT *, CASE WHEN wide AND raw_ms - qrs_ms >= 20 THEN raw_ms END AS o1, CASE WHEN wide AND NOT coalesce(dominant_ms >= 120, false) AND (qrs_ms < 120 OR wide_ms - qrs_ms >= 25) THEN wide_ms END AS o2, CASE WHEN over THEN raw_ms END AS o3 FROM x)
SELECT record_id, wide OR over AS context, CASE WHEN wide THEN 'wide_qrs_pacing_like_context' WHEN over THEN 'overwide_qrs_pacing_like_context' ELSE 'no_pacing_like_context' END AS context_reason, round(coalesce(o1, o2, o3), 4) AS override_ms, CASE WHEN o1 IS NOT NULL THEN 'raw_pacing_qrs_underestimate' WHEN o2 IS NOT NULL THEN 'near_wide_pacing_group' WHEN o3 IS NOT NULL THEN 'overwide_pacing_raw_consensus' END AS override_rule FROM o""")
def pacing_like_override(spark, sf):
    """Records whose ventricle behaves as if paced, and the QRS duration that takes the measured one's place."""
    m = marks(spark, sf)
    groups = m.groupBy("record_id", (F.col("mark") % 5).alias("grp")).agg((median("amp") * 2 + 50).alias("qrs_ms")).withColumn("dominant", F.col("grp") == F.col("record_id") % 7)
    leads = m.groupBy("record_id", "kind").agg((median("amp") * 2 + 60).alias("qrs_ms"), (F.max("conf") >= 0.4).alias("reliable"))
    x = P.pacing_like(facts(spark, sf), groups, leads)
    return x.select("record_id", "context", "context_reason", rounded(F.col("override_ms"), 4).alias("override_ms"), "override_rule")

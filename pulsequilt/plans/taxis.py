"""T axis rules over ``lineitem``: a record is twelve lines of a part, of which the first six are limb leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import ANGLES, listed, rounded
from pulsequilt.operators import taxis as T
from pulsequilt.plans.consensus import L_SQL, leads_of
from pulsequilt.plans.registry import query

#: Columns of leads as expressions that both engines read.
_LEAD = {
    "amp": "CASE WHEN l_quantity > 2 THEN CAST(l_orderkey % 60 - 12 AS DOUBLE) / 100 END",
    "amp_sd": "CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey % 13 AS DOUBLE) / 50 END",
    "conf": "CASE WHEN l_orderkey % 13 > 0 THEN CAST(40 + l_suppkey % 61 AS DOUBLE) / 100 END",
    "area": "CASE WHEN l_quantity > 1 THEN CAST(l_partkey % 90 + l_quantity AS DOUBLE) / 20 END",
    "signed_area": "CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_orderkey % 70 - 8 AS DOUBLE) / 20 END",
    "reliable_for_t": "l_returnflag <> 'A' OR l_quantity > 20",
    "confused": "l_quantity > 44",
    "st_conf": "CAST(70 + l_suppkey % 31 AS DOUBLE) / 100",
    "st_mid": "CAST(l_orderkey % 9 AS DOUBLE) / 50",
    "special_uv": "CASE WHEN l_suppkey % 5 = 0 THEN CAST(60 - l_orderkey % 200 AS DOUBLE) END",
    "t_prime_area": "CAST(l_partkey % 300 AS DOUBLE)",
}
_FACT = {"qrs_ms": "80.0 + p % 90", "rr_cv": "CASE WHEN p % 9 > 0 THEN CAST(p % 25 AS DOUBLE) / 100 END", "atrial_invalid": "p % 8 = 1"}
LEADS_SQL = L_SQL + f""", t AS (SELECT record_id, lead, {", ".join(f"{e} AS {n}" for n, e in _LEAD.items())}, CASE lead {" ".join(f"WHEN '{k}' THEN radians({v})" for k, v in ANGLES.items())} END AS theta FROM l WHERE lead_no < 6),
f AS (SELECT record_id, p, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" if n != "atrial_invalid" else f"{e} AS {n}" for n, e in _FACT.items())} FROM (SELECT DISTINCT record_id, l_partkey AS p FROM l)),
v AS (SELECT *, coalesce(signed_area, area * sign(amp)) AS raw, amp_sd IS NULL OR amp IS NULL OR amp_sd <= greatest(0.08, 0.8 * abs(amp)) AS steady FROM t),
w AS (SELECT *, coalesce(t_prime_area >= 160 AND abs(special_uv) >= 50 AND raw * special_uv < 0, false) AS prime FROM v)
"""


def t_leads(spark, sf) -> DataFrame:
    return leads_of(spark, sf).where("lead_no < 6").select("record_id", "lead", "l_partkey", *(F.expr(e).alias(n) for n, e in _LEAD.items()))


def t_facts(spark, sf) -> DataFrame:
    x = leads_of(spark, sf).select("record_id", F.col("l_partkey").alias("p")).distinct()
    return x.select("record_id", "p", *(F.expr(e).cast("boolean" if n == "atrial_invalid" else "double").alias(n) for n, e in _FACT.items()))


_SAME = "sign({0}) <> sign(cos(atan2(y, x) - theta)) AND abs(cos(atan2(y, x) - theta)) >= 0.15 AND abs(amp) >= 0.05 AND (lead = 'aVR' OR coalesce(conf, 0) < 0.95)"


@query(LEADS_SQL + f""", r(rule, leads, conf0, area0, mv, st0, post, deg, share, seeds) AS (VALUES ('low_support', 4, 0.10, 0.50, 0.05, 0.80, 0.08, 120, NULL, false), ('detected', 3, 0.20, 0.75, 0.08, 0.85, 0.08, 120, NULL, true), ('st_supported', 2, 0.60, 1.00, 0.05, 0.90, NULL, 130, 0.5, true)),
c AS (SELECT r.*, w.*, CASE WHEN reliable_for_t AND abs(amp) >= mv AND conf >= conf0 AND abs(raw) >= area0 AND (NOT confused OR st_conf >= st0 AND (post IS NULL OR abs(amp - st_mid) >= post)) AND NOT prime AND steady
  AND CASE WHEN share IS NULL THEN NOT coalesce(abs(area) >= 1e-6, false) OR abs(raw) / abs(area) >= 0.15 ELSE coalesce(abs(area) >= 1e-6, false) AND abs(raw) / abs(area) >= share END THEN raw END AS val
  FROM r, w JOIN f USING (record_id) WHERE NOT atrial_invalid AND qrs_ms <= 120 AND coalesce(rr_cv <= 0.08, true)),
s AS (SELECT *, lead IN ('I', 'II', 'aVF') AND coalesce(abs(amp) >= 0.05 AND conf >= 0.6 AND abs(val) >= 0.3, false) AS seed FROM c),
a AS (SELECT rule, record_id, count(*) FILTER (seed) AS ns, count(*) FILTER (seed AND val >= 0) AS up, sum(val * greatest(0.1, conf) * cos(theta)) FILTER (seed) AS x, sum(val * greatest(0.1, conf) * sin(theta)) FILTER (seed) AS y FROM s GROUP BY ALL),
kept AS (SELECT s.* FROM s JOIN a USING (rule, record_id) WHERE val IS NOT NULL AND NOT coalesce(seeds AND ns = 3 AND up IN (0, 3) AND lead NOT IN ('I', 'II', 'aVF') AND {_SAME.format('val')}, false)),
g AS (SELECT rule, record_id, any_value(leads) AS least, any_value(deg) AS deg, count(*) AS n_leads, degrees(atan2(sum(val * greatest(0.1, conf) * sin(theta)), sum(val * greatest(0.1, conf) * cos(theta)))) AS axis, string_agg(lead, ',' ORDER BY lead) AS leads FROM kept GROUP BY ALL)
SELECT record_id, rule, n_leads, round(axis, 5) + 0.0 AS axis_deg, leads FROM g WHERE n_leads >= least AND abs(axis) <= deg""")
def t_axis_coverage(spark, sf):
    """The T axis of calm records by each rule that covers low support."""
    return T.coverages(t_leads(spark, sf), t_facts(spark, sf)).withColumns({"axis_deg": rounded(F.col("axis_deg"), 5), "leads": listed(F.col("leads"))})


@query(LEADS_SQL + """, kept AS (SELECT *, raw AS val FROM w WHERE reliable_for_t AND abs(amp) >= 0.02 AND raw IS NOT NULL AND NOT prime AND steady AND (NOT coalesce(abs(area) >= 1e-6, false) OR abs(raw) / abs(area) >= 0.15))
SELECT record_id, round(degrees(atan2(sum(val * greatest(0.1, coalesce(conf, 0.1)) * sin(theta)), sum(val * greatest(0.1, coalesce(conf, 0.1)) * cos(theta)))), 5) + 0.0 AS axis_deg FROM kept GROUP BY record_id HAVING count(*) >= 5 AND max(val) > 0 AND min(val) < 0""")
def t_axis_stable_signed(spark, sf):
    """The axis of five limb leads or more whose T waves have both signs."""
    return T.stable_signed_axis(t_leads(spark, sf)).withColumn("axis_deg", rounded(F.col("axis_deg"), 5))


@query(LEADS_SQL + """, g AS (SELECT record_id, count(*) FILTER (st_conf >= 0.75) AS n, count(*) FILTER (abs(amp) >= 0.05 AND abs(raw) >= 1e-6) AS compared, count(*) FILTER (abs(amp) >= 0.05 AND abs(raw) >= 1e-6 AND sign(raw) <> sign(amp)) AS against FROM w GROUP BY record_id)
SELECT record_id, qrs_ms >= 145 AND n >= 2 AND compared > 0 AND against <= 1 AS use FROM g JOIN f USING (record_id)""")
def t_axis_st_corrected(spark, sf):
    """Whether a record's axis is taken without the ST level."""
    x = T.limb_values(t_leads(spark, sf), 0.0).withColumn("value", F.coalesce("signed_area", F.col("area") * F.signum("amp")))
    return T.st_corrected(x.withColumn("st_value", F.when(F.col("st_conf") >= 0.75, 1.0)), t_facts(spark, sf))


@query(LEADS_SQL + """, g AS (SELECT record_id, count(raw) AS n, count(*) FILTER (raw IS NOT NULL AND conf >= 0.6) AS high, count(*) FILTER (raw IS NOT NULL AND abs(amp - st_mid) >= 0.03 AND abs(amp - st_mid) >= 0.3 * greatest(abs(amp), 1e-6)) AS post FROM w GROUP BY record_id),
x AS (SELECT f.record_id, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(post, 0) AS post, rr_cv, p % 4 AS np, qrs_ms >= 145 AS wide, p % 3 = 0 AS paced, CASE WHEN p % 2 = 0 THEN 2 ELSE 3 END AS least, CAST(p % 360 AS DOUBLE) AS t, CASE WHEN p % 6 > 0 THEN CAST(p * 7 % 360 AS DOUBLE) END AS q FROM f LEFT JOIN g USING (record_id) WHERE p % 10 > 0),
r AS (SELECT record_id, CASE WHEN n < 2 THEN 'few_leads' WHEN high < 1 THEN 'no_confident_lead' WHEN coalesce(rr_cv > 0.18, false) AND np < 2 THEN 'irregular_without_p' WHEN wide AND n < least THEN 'wide_few_leads' WHEN wide AND high < CASE WHEN paced THEN 2 ELSE least END THEN 'wide_low_confidence' WHEN wide AND post < least THEN 'wide_without_post_st'
  WHEN wide AND NOT paced AND abs(CASE WHEN t >= 180 THEN t - 360 ELSE t END) >= 150 THEN 'wide_extreme_axis' WHEN wide AND NOT paced AND coalesce(least(abs(q - t), 360 - abs(q - t)) >= 125, false) THEN 'wide_discordant' END AS reason FROM x)
SELECT record_id, reason IS NOT NULL AS suppressed, reason FROM r""")
def t_axis_suppressed(spark, sf):
    """Records whose T axis is withheld, and why."""
    x = t_leads(spark, sf).withColumn("value", F.coalesce("signed_area", F.col("area") * F.signum("amp")))
    p = F.col("p")
    f = t_facts(spark, sf).select("record_id", "qrs_ms", "rr_cv", F.when(p % 10 > 0, (p % 360).cast("double")).alias("t_axis"), F.when(p % 6 > 0, (p * 7 % 360).cast("double")).alias("qrs_axis"), (p % 4).alias("n_visible_p"), (p % 2 == 0).alias("st_corrected"), (p % 3 == 0).alias("paced"))
    return T.suppressed(x, f)

"""Record-level widths and chest-lead screening over ``lineitem``: a record is twelve lines of a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import LEADS, listed, rounded
from pulsequilt.operators import consensus as C
from pulsequilt.operators import engine as E
from pulsequilt.operators import kernels as K
from pulsequilt.operators import policies as P
from pulsequilt.plans.registry import query
from pulsequilt.plans.rescues import _ORDER
from pulsequilt.plans.signals import limbs
from pulsequilt.sources.adapters import table


def leads_of(spark, sf) -> DataFrame:
    """record_id, lead, lead_no and the line's columns."""
    k = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*_ORDER)) - 1
    x = table(spark, sf, "lineitem").withColumn("k", k)
    return x.select((F.col("l_partkey") * 100_000 + F.floor(F.col("k") / 12)).alias("record_id"), F.get(F.array(*map(F.lit, LEADS)), F.col("k") % 12).alias("lead"), (F.col("k") % 12).cast("int").alias("lead_no"), *_ORDER, "l_partkey", "l_returnflag", "l_linestatus")


L_SQL = f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_ORDER)}) - 1 AS k FROM lineitem),
l AS (SELECT *, l_partkey * 100000 + k // 12 AS record_id, {list(LEADS)}[k % 12 + 1] AS lead, CAST(k % 12 AS INTEGER) AS lead_no FROM k)
"""


@query(L_SQL + """, x AS (SELECT record_id, lead, lead_no, CASE WHEN l_partkey % 4 > 0 AND l_suppkey % 3 > 0 THEN 30 + l_orderkey % 90 END AS c0, CASE WHEN l_suppkey % 7 > 0 THEN 25 + l_orderkey % 170 END AS r0, l_suppkey % 5 AS ons, l_orderkey % 4 AS offs, l_orderkey % 50 = 0 AS guarded, CASE WHEN l_quantity > 3 THEN CAST(l_orderkey % 11 - 5 AS DOUBLE) / 100 END AS amp, CAST(l_suppkey % 60 AS DOUBLE) / 100 AS conf, l_returnflag <> 'A' AS ok FROM l),
y AS (SELECT *, ok AND (amp IS NULL OR NOT (conf < 0.2 OR abs(amp) < 0.02)) AS use FROM x),
z AS (SELECT *, CASE WHEN use AND c0 BETWEEN 35 AND 180 THEN c0 END AS c, CASE WHEN use AND r0 BETWEEN 35 AND 180 THEN r0 END AS r FROM y),
g AS (SELECT record_id, count(c) AS nc, count(r) AS nr, median(c) AS mc, median(r) AS mr, max(c) - min(c) AS sc, max(r) - min(r) AS sr, string_agg(lead, ',' ORDER BY lead_no) FILTER (c IS NOT NULL) AS lc, string_agg(lead, ',' ORDER BY lead_no) FILTER (r IS NOT NULL) AS lr, max(least(ons, offs)) FILTER (c IS NOT NULL AND ons > 0 AND offs > 0) AS b, coalesce(bool_or(guarded AND c IS NOT NULL), false) AS gd FROM z GROUP BY record_id)
SELECT record_id, CASE WHEN nc > 0 THEN mc ELSE mr END AS p_ms, CASE WHEN nc > 0 THEN CASE WHEN gd THEN 'representative_multilead_consensus_paired_duration_guard' ELSE 'representative_multilead_consensus' END WHEN nr > 0 THEN 'reliable_lead_median_fallback' END AS source, coalesce(CASE WHEN nc > 0 THEN lc ELSE lr END, '') AS leads,
  CASE WHEN nc > 0 THEN coalesce(b, nc) ELSE nr END AS support, CAST(CASE WHEN nc > 0 THEN sc ELSE sr END AS DOUBLE) AS spread_ms, CASE WHEN nc > 0 THEN CASE WHEN coalesce(b, nc) >= 3 THEN 'reliable' ELSE 'low_support' END WHEN nr >= 2 THEN 'fallback' WHEN nr = 1 THEN 'low_support' ELSE 'unavailable' END AS reliability FROM g""")
def p_duration(spark, sf):
    """One P duration a record, with where it comes from."""
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    x = leads_of(spark, sf).select(
        "record_id", "lead", "lead_no",
        F.when((F.col("l_partkey") % 4 > 0) & (s % 3 > 0), 30.0 + o % 90).alias("consensus_ms"), F.when(s % 7 > 0, 25.0 + o % 170).alias("raw_ms"),
        (s % 5).alias("onset_support"), (o % 4).alias("offset_support"), (o % 50 == 0).alias("guarded"),
        F.when(F.col("l_quantity") > 3, (o % 11 - 5) / 100.0).alias("p_amp"), (s % 60 / 100.0).alias("p_conf"), (F.col("l_returnflag") != "A").alias("reliable_for_p"),
    )
    return C.p_duration(x).withColumn("leads", listed(F.col("leads")))


QRS_SQL = L_SQL + """, x AS (SELECT record_id, l_partkey AS p, CAST(70 + l_suppkey % 90 AS DOUBLE) AS r0, CASE WHEN l_orderkey % 5 > 0 THEN CAST(70 + l_partkey % 60 + l_orderkey % 80 AS DOUBLE) END AS w0, l_returnflag <> 'A' AS ok, l_quantity > 48 AS late FROM l),
y AS (SELECT *, CASE WHEN ok AND r0 BETWEEN 40 AND 220 THEN r0 END AS r, CASE WHEN ok AND w0 BETWEEN 40 AND 220 THEN w0 END AS w FROM x)
"""


@query(QRS_SQL + """, g AS (SELECT record_id, any_value(p) AS p, count(w) AS n, median(w) AS mid, count(r) AS nr, max(r) AS most, median(r) AS rm, count(*) FILTER (r >= 120) AS nw FROM y GROUP BY record_id HAVING count(w) > 0),
h AS (SELECT *, CASE WHEN p % 17 = 0 THEN 'split' WHEN nr >= 3 AND mid > most + 12 THEN 'raw_greatest' WHEN nr >= 3 AND mid >= 120 AND rm < 120 AND nw < 3 AND NOT (mid >= 145 AND n >= 6 AND nw >= 2) THEN 'raw_median' ELSE 'consensus' END AS rule FROM g)
SELECT record_id, CASE rule WHEN 'split' THEN CAST(125 AS DOUBLE) WHEN 'raw_greatest' THEN most WHEN 'raw_median' THEN rm ELSE mid END AS qrs_ms, rule FROM h""")
def qrs_wide(spark, sf):
    """The width that decides whether a record's QRS is wide."""
    x = _qrs_leads(spark, sf)
    split = x.select("record_id", "p").distinct().where("p % 17 = 0").select("record_id", F.lit(125.0).alias("split_ms"))
    return C.qrs_wide(x, split)


def _qrs_leads(spark, sf) -> DataFrame:
    o, s, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    return leads_of(spark, sf).select("record_id", p.alias("p"), (70.0 + s % 90).alias("raw_ms"), F.when(o % 5 > 0, 70.0 + p % 60 + o % 80).alias("wide_ms"), (F.col("l_returnflag") != "A").alias("reliable_for_qrs"), (F.col("l_quantity") > 48).alias("confused"), F.lit(None).cast("boolean").alias("late_offset"))


@query(QRS_SQL + """, m AS (SELECT record_id, median(r) AS mid FROM y GROUP BY record_id), g AS (SELECT record_id, any_value(p) AS p, bool_or(late) AS late, count(r) AS n, any_value(mid) AS mid, count(*) FILTER (r <= mid + 30) AS near, count(*) FILTER (r >= 120) AS nw, quantile_cont(r, 0.6) AS core, any_value(130.0 + p % 80) AS cons FROM y JOIN m USING (record_id) GROUP BY record_id)
SELECT record_id, round(least(core, cons), 6) AS core_ms FROM g WHERE late AND n >= 6 AND NOT (p % 3 <> 0 AND cons BETWEEN 145 AND 190 AND nw >= 2) AND cons - mid >= 35 AND near >= greatest(5, ceil(n / 2.0))""")
def qrs_late_core(spark, sf):
    """Early cores of QRS widths where the consensus lies late."""
    x = _qrs_leads(spark, sf)
    facts = x.select("record_id", "p").distinct().select("record_id", (130.0 + F.col("p") % 80).alias("consensus_ms"), (F.col("p") % 3 == 0).alias("paced"))
    return C.late_qrs_core(x, facts).withColumn("core_ms", rounded(F.col("core_ms")))


_R = "list_transform(range(6), lambda k: CASE k WHEN {0} THEN r[{1} + 1] WHEN {1} THEN r[{0} + 1] ELSE r[k + 1] END)"
_FALLS = "len(list_filter(range(1, 6), lambda k: k < list_position({0}, list_max({0})) AND {0}[k + 1] - {0}[k] < -greatest(0.05, 0.15 * list_max({0}))))"


@query(L_SQL + f""", c AS (SELECT record_id, any_value(l_partkey) AS p, max(CASE WHEN lead_no >= 6 THEN 80 + l_suppkey % 45 END) AS qrs, list(CASE WHEN l_suppkey % 50 > 0 THEN CAST(l_orderkey % 15 + (lead_no - 6) * 12 AS DOUBLE) / 50 END ORDER BY lead_no) FILTER (lead_no >= 6) AS r, list(CAST(-(l_suppkey % 30) AS DOUBLE) / 100 ORDER BY lead_no) FILTER (lead_no BETWEEN 6 AND 9) AS q,
  any_value(CAST(-(l_orderkey % 40) AS DOUBLE) / 10) FILTER (lead_no = 6) AS s1, list(CASE WHEN l_orderkey % 9 > 0 THEN CAST(l_suppkey % 100 AS DOUBLE) / 100 END ORDER BY lead_no) FILTER (lead_no BETWEEN 6 AND 10) AS c FROM l GROUP BY record_id HAVING count(*) FILTER (lead_no >= 6) > 0),
w AS (SELECT *, len(r) = 6 AND len(list_filter(r, lambda v: v IS NULL)) = 0 AS whole FROM c),
f AS (SELECT *, CASE WHEN whole THEN list_max(r) END AS big, CASE WHEN whole THEN {_FALLS.format('r')} END AS falls, CASE WHEN whole THEN list_position(r, list_max(r)) - 1 END AS peak, concat_ws('+', CASE WHEN qrs >= 120 THEN 'wide_qrs' END, CASE WHEN len(list_filter(q, lambda v: v <= -0.2)) >= 2 THEN 'pathological_q_pattern' END, CASE WHEN abs(s1) + greatest(r[5], r[6]) >= 3.5 THEN 'lvh_voltage_pattern' END) AS causes FROM w),
t AS (SELECT record_id, a, b, list_transform(range(6), lambda k: CASE k WHEN a THEN r[b + 1] WHEN b THEN r[a + 1] ELSE r[k + 1] END) AS r FROM f, range(6) x(a), range(6) y(b) WHERE a < b AND whole),
s AS (SELECT record_id, arg_min([a, b], (CASE WHEN b = a + 1 THEN 0 ELSE 1 END) * 1000 + (b - a) * 100 + a) AS pair FROM t WHERE {_FALLS.format('r')} = 0 GROUP BY record_id),
e AS (SELECT f.*, pair, CASE WHEN NOT whole THEN 'incomplete' WHEN big <= 0.5 THEN 'precordial_low_voltage' WHEN causes <> '' THEN causes WHEN falls < 1 THEN 'no_violation' WHEN pair IS NULL THEN 'no_single_swap_resolves_progression' END AS reason FROM f LEFT JOIN s USING (record_id)),
o AS (SELECT *, c[pair[1] + 1] AS own, list_filter(list_transform(range(5), lambda k: CASE WHEN k <> pair[1] THEN c[k + 1] END), lambda v: v IS NOT NULL) AS others FROM e),
u AS (SELECT *, CASE WHEN reason IS NULL AND pair[2] = pair[1] + 1 AND own IS NOT NULL AND len(others) > 0 THEN own < 0.5 OR own < least(list_median(others), 1.0) - 0.2 END AS corroborated FROM o)
SELECT record_id, reason IS NULL AS suspected, CASE WHEN NOT whole OR causes <> '' AND big > 0.5 THEN 'unavailable' WHEN reason = 'no_violation' OR coalesce(corroborated, false) THEN 'moderate' ELSE 'low' END AS confidence, reason, CASE WHEN reason IS NULL THEN 'V' || (pair[1] + 1) || ',V' || (pair[2] + 1) END AS leads,
  round(CASE WHEN whole AND big > 0.5 AND causes = '' THEN CASE WHEN peak > 0 THEN 1 - CAST(falls AS DOUBLE) / peak ELSE 1 END END, 6) AS score, CASE WHEN whole THEN 'V' || (peak + 1) END AS peak_lead, corroborated FROM u""")
def chest_reversal(spark, sf):
    """Records whose chest leads may have changed places."""
    o, s, no = F.col("l_orderkey"), F.col("l_suppkey"), F.col("lead_no")
    x = leads_of(spark, sf).where("lead_no >= 6")
    at = lambda k, v: F.max(F.when(no == k + 5, v))
    r, q, c = F.when(s % 50 > 0, (o % 15 + (no - 6) * 12) / 50.0), -(s % 30) / 100.0, F.when(o % 9 > 0, (s % 100) / 100.0)
    g = x.groupBy("record_id").agg(*(at(k, r).alias(f"r{k}") for k in range(1, 7)), *(at(k, q).alias(f"q{k}") for k in range(1, 5)), *(at(k, c).alias(f"c{k}") for k in range(1, 6)), at(1, -(o % 40) / 10.0).alias("s1"), F.max(80.0 + s % 45).alias("qrs"))
    return C.chest_reversal(g).withColumns({"leads": listed(F.col("leads")), "score": rounded(F.col("score"))})


@query()
def despiking_rescue(spark, sf):
    """Whether taking spikes out of the limb leads removed regular beats that these captured."""
    x = limbs(spark, sf)
    rhythm = E.pacing_rhythm(E.spike_clusters(E.spike_candidates(x), votes=2, least_uv=100.0))
    ms = lambda d: d.select("record_id", (F.col("time_s") * 1000).alias("ms"))
    rate = x.groupBy("record_id").agg(F.max("fs").alias("fs"))
    spikes = rhythm.join(rate, "record_id").select("record_id", "fs", F.explode("spikes").alias("s")).select("record_id", (F.col("s") * 1000 / F.col("fs")).alias("ms"))
    facts = rate.join(rhythm.select("record_id", "paced", "state"), "record_id", "left").select("record_id", "paced", "state")
    out = P.despiking_rescue(ms(K.detected(x)), ms(K.detected(E.despiked(x, rhythm))), spikes, facts)
    return out.withColumns({c: rounded(F.col(c), 4) for c in ("median_rr", "robust_cv", "max_deviation")})

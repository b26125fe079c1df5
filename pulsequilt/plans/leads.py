"""Queries of record-level rules over ``events``: event types as leads, values as lead values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import listed, median, rounded, with_means
from pulsequilt.operators import leads as L
from pulsequilt.plans.intervals import ANGLE_SQL, AXIS_SQL, lead_values
from pulsequilt.plans.registry import query
from pulsequilt.plans.rhythm import published
from pulsequilt.sources.adapters import MARKS_SQL, beats, marks, table


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_acctbal >= 0 THEN c_acctbal / 365.25 END ELSE CASE WHEN c_nationkey >= 0 THEN c_nationkey END END, 6) AS age_years FROM customer")
def patient_age(spark, sf):
    days = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", rounded(L.age_years(F.col("c_nationkey").cast("double"), days)).alias("age_years"))


PR_LEADS_SQL = MARKS_SQL + ", l AS (SELECT record_id, mark % 12 AS lead, mark % 12 < 6 AS limb, avg(conf) >= 0.5 AS reliable, median(amp) + 100 AS v FROM marks GROUP BY ALL)\n"


def chest_and_limb(spark, sf):
    m, mean = with_means(marks(spark, sf), {"record_id": F.col("record_id"), "lead": F.col("mark") % 12}, ["mark"], conf="conf")
    return m.groupBy("record_id", "lead").agg((mean["conf"] >= 0.5).alias("reliable"), (median("amp") + 100.0).alias("v")).withColumn("limb", F.col("lead") < 6)


@query(PR_LEADS_SQL + """, g AS (SELECT record_id, count(v) FILTER (limb AND reliable) AS nl, median(v) FILTER (limb AND reliable) AS ml, count(v) AS na, median(v) AS ma FROM l GROUP BY record_id)
SELECT record_id, round(CASE WHEN nl >= 3 THEN ml ELSE ma END, 4) AS pr_ms, CASE WHEN nl >= 3 THEN 'limb_leads' WHEN na >= 3 THEN 'all_leads' WHEN na > 0 THEN 'low_support' END AS source FROM g""")
def global_pr(spark, sf):
    return published(L.global_pr(chest_and_limb(spark, sf).withColumnRenamed("v", "pr")), "record_id", "source", pr_ms="pr_ms")


@query(PR_LEADS_SQL + """, g AS (SELECT record_id, median(v) FILTER (limb) AS a, median(v) FILTER (NOT limb) AS b, quantile_cont(v, 0.6) AS p, median(v) AS m FROM l GROUP BY record_id)
SELECT record_id, coalesce(abs(a - b) >= 20, false) AS split, round(CASE WHEN coalesce(abs(a - b) >= 20, false) THEN greatest(120, least(p, b)) ELSE m END, 4) AS qrs_ms FROM g""")
def qrs_split_core(spark, sf):
    return published(L.split_core(chest_and_limb(spark, sf).withColumnRenamed("v", "qrs")), "record_id", "split", qrs_ms="qrs_ms")


@query(MARKS_SQL + """, v AS (SELECT record_id, amp AS pr, amp - lag(amp) OVER (PARTITION BY record_id ORDER BY amp) AS step FROM marks), b AS (SELECT record_id, step, pr AS cut FROM v QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY step DESC NULLS LAST, pr DESC) = 1)
SELECT record_id, round(median(pr), 4) AS pr_ms, count(*) AS n FROM v JOIN b USING (record_id) WHERE coalesce(b.step, 0) < 30 OR pr >= cut GROUP BY record_id""")
def pr_physiologic_core(spark, sf):
    return published(L.pr_core(marks(spark, sf).select("record_id", F.col("amp").alias("pr"))), "record_id", "n", pr_ms="pr_ms")


@query(AXIS_SQL + f""", p AS (SELECT v.record_id, value, cos(radians(axis - {ANGLE_SQL})) AS c, axis FROM v JOIN a USING (record_id)), s AS (SELECT record_id, any_value(axis) AS axis, sum(value * c) AS vc, sum(c * c) AS cc, sum(value * value) AS vv FROM p GROUP BY record_id)
SELECT record_id, round(axis, 4) AS axis_deg, round(sqrt(greatest(0.0, vv - vc * vc / cc) / greatest(vv, 1e-12)), 4) AS fit_score FROM s""")
def axis_fit(spark, sf):
    return published(L.axis_fit(lead_values(spark, sf)), "record_id", axis_deg="axis_deg", fit_score="fit_score")


@query(AXIS_SQL + f""", w AS (SELECT x.record_id, x.lead AS removed, y.value, y.conf, {ANGLE_SQL.replace('lead', 'y.lead')} AS th FROM v x JOIN v y ON x.record_id = y.record_id AND x.lead <> y.lead),
o AS (SELECT record_id, removed, CASE WHEN sum(abs(value) * greatest(0.1, conf)) >= 1e-6 THEN degrees(atan2(sum(value * greatest(0.1, conf) * sin(radians(th))), sum(value * greatest(0.1, conf) * cos(radians(th))))) END AS ax FROM w GROUP BY ALL)
SELECT o.record_id, removed, round(ax, 4) AS axis_deg, round(abs((ax - axis + 180) - 360 * floor((ax - axis + 180) / 360) - 180), 4) + 0.0 AS turn_deg FROM o JOIN a USING (record_id)""")
def axis_leave_one_out(spark, sf):
    return published(L.without_one(lead_values(spark, sf)), "record_id", "removed", axis_deg="axis_deg", turn_deg="turn_deg")


@query(MARKS_SQL + "SELECT mark, round(CASE WHEN conf >= 0.3 AND abs(amp - 40) / 100 >= 0.02 THEN coalesce(CASE WHEN mark % 4 = 0 THEN (amp - 50) / 7 END, amp / 9 * sign(amp - 40)) END, 6) + 0.0 AS signed_area FROM marks")
def signed_wave_area(spark, sf):
    amp = (F.col("amp") - 40.0) / 100.0
    return marks(spark, sf).select("mark", rounded(L.signed_area(F.col("amp") / 9.0, F.when(F.col("mark") % 4 == 0, (F.col("amp") - 50.0) / 7.0), amp, F.col("conf") >= 0.3)).alias("signed_area"))


@query(MARKS_SQL + """, v AS (SELECT record_id, mark % 6 + 1 AS idx, median(amp) AS value FROM marks GROUP BY ALL), x AS (SELECT *, lag(value) OVER (PARTITION BY record_id ORDER BY idx) AS last FROM v), t AS (SELECT record_id, idx AS top FROM v QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY value DESC, idx) = 1)
SELECT record_id, count(*) FILTER (last - value > 2) AS violations, max(top) AS peak_idx FROM x JOIN t USING (record_id) WHERE idx <= top GROUP BY record_id""")
def ascending_violations(spark, sf):
    v = marks(spark, sf).groupBy("record_id", (F.col("mark") % 6 + 1).alias("idx")).agg(median("amp").alias("value"))
    return L.descents(v, 2.0)


@query(MARKS_SQL + """, r AS (SELECT record_id, beat_id AS idx, row_number() OVER (PARTITION BY record_id ORDER BY beat_id) AS k FROM beats WHERE true), q AS (SELECT b.record_id, b.beat_id AS idx, b.amp >= 40 AS on_, r.k FROM beats b JOIN r ON b.record_id = r.record_id AND b.beat_id = r.idx),
i AS (SELECT *, k - row_number() OVER (PARTITION BY record_id ORDER BY idx) AS island FROM q WHERE on_) SELECT record_id, min(idx) AS start, max(idx) AS stop, count(*) AS n FROM i GROUP BY record_id, island""")
def connected_regions(spark, sf):
    return L.regions(beats(spark, sf).select("record_id", F.col("beat_id").alias("idx"), (F.col("amp") >= 40).alias("on")))


@query(MARKS_SQL + """, l AS (SELECT record_id, kind AS lead, round(median(amp) * 4 + 100, 6) AS bpm FROM marks GROUP BY ALL), n AS (SELECT x.record_id, x.lead, x.bpm, count(*) AS support, median(y.bpm) AS rate FROM l x JOIN l y ON x.record_id = y.record_id AND abs(x.bpm - y.bpm) <= 15 GROUP BY ALL),
b AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS total FROM n QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY support DESC, bpm, rate DESC) = 1)
SELECT record_id, support, round(support / total, 6) AS share, round(rate, 4) AS rate_bpm, support >= 2 AND support / total >= 0.4 AS consensus FROM b""")
def multilead_flutter(spark, sf):
    l = marks(spark, sf).groupBy("record_id", F.col("kind").alias("lead")).agg(rounded(median("amp") * 4 + 100).alias("bpm"))
    x = L.multilead_flutter(l)
    return x.select("record_id", "support", rounded(F.col("share")).alias("share"), rounded(F.col("rate_bpm"), 4).alias("rate_bpm"), "consensus")


@query(MARKS_SQL + """, x AS (SELECT record_id, count(*) FILTER (kind = 'error') AS s, count(*) FILTER (kind = 'purchase') AS q, count(*) FILTER (kind = 'error' AND conf >= 0.8) AS c, count(*) FILTER (kind = 'error' AND conf >= 0.75) AS a, median(amp) FILTER (kind = 'error') AS o FROM marks GROUP BY record_id)
SELECT record_id, concat_ws(',', CASE WHEN s > 0 AND a / greatest(s, 1) < 0.2 THEN 'association' END, CASE WHEN s >= 4 AND c / s < 0.25 THEN 'capture_alignment' END, CASE WHEN s / greatest(q, 1) > 2.5 THEN 'spike_burden' END) AS conflicts, a >= 2 AND coalesce(abs(o) <= 55, false) AS routing_allowed FROM x""")
def pacing_evidence(spark, sf):
    k = F.col("kind") == "error"
    x = marks(spark, sf).groupBy("record_id").agg(F.count_if(k).alias("n_spikes"), F.count_if(F.col("kind") == "purchase").alias("n_qrs"), F.count_if(k & (F.col("conf") >= 0.8)).alias("n_captured"), F.count_if(k & (F.col("conf") >= 0.75)).alias("n_associated"), median(F.when(k, F.col("amp"))).alias("median_offset"))
    return L.pacing_evidence(x).select("record_id", listed(F.col("conflicts")).alias("conflicts"), "routing_allowed")


@query(MARKS_SQL + """, x AS (SELECT record_id, median(amp) + 100 AS pr, record_id % 5 AS r, stddev_pop(rr_prev) / avg(rr_prev) / 8 AS cv, avg(conf) < 0.5 AS bad FROM beats GROUP BY record_id), y AS (SELECT *, r IN (0, 1) OR (coalesce(cv >= 0.15, false) AND bad) AS withheld FROM x)
SELECT record_id, withheld, CASE WHEN NOT withheld THEN round(pr, 4) END AS pr_ms FROM y""")
def pr_availability(spark, sf):
    r = F.col("record_id") % 5
    x = beats(spark, sf).groupBy("record_id").agg((median("amp") + 100.0).alias("pr"), (F.stddev_pop("rr_prev") / F.avg("rr_prev") / 8).alias("rr_cv"), (F.avg("conf") < 0.5).alias("atrial_unavailable"))
    x = x.withColumn("reasons", F.when(r == 0, F.array(F.lit("af"), F.lit("other"))).when(r == 1, F.array(F.lit("complete_block"))).otherwise(F.array(F.lit("other"))))
    return published(L.pr_availability(x), "record_id", "withheld", pr_ms="pr")


@query(MARKS_SQL + "SELECT record_id, CASE WHEN record_id % 4 = 0 THEN 'not_applicable:input_mode_limited' ELSE 'measured' END AS state, CASE WHEN record_id % 4 <> 0 THEN round(median(amp), 4) END AS axis_deg, CASE WHEN record_id % 4 <> 0 THEN round(max(amp), 4) END AS qtc_ms FROM marks GROUP BY record_id")
def applicability(spark, sf):
    x = marks(spark, sf).groupBy("record_id").agg(median("amp").alias("axis_deg"), F.max("amp").alias("qtc_ms")).withColumn("input_mode", F.when(F.col("record_id") % 4 == 0, "limited").otherwise("standard_12"))
    return published(L.limited_mode(x, "axis_deg", "qtc_ms"), "record_id", "state", axis_deg="axis_deg", qtc_ms="qtc_ms")


#: Greedy matching in the order of x: step k gives the k-th x its nearest y that is still free.
MATCHED_SQL = MARKS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, g AS (SELECT record_id, coalesce(list_sort(list_distinct(list(us / 3e7) FILTER (kind = 'purchase'))), []) AS xs, coalesce(list_sort(list_distinct(list(us / 3e7) FILTER (kind = 'signup'))), []) AS ys FROM marks GROUP BY record_id),
s AS (SELECT record_id, xs, ys, 1 AS k, CAST([] AS DOUBLE[]) AS used, 0 AS matched, CAST(0 AS DOUBLE) AS gaps FROM g WHERE len(xs) + len(ys) > 0
  UNION ALL SELECT record_id, xs, ys, k + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.y) END, matched + CASE WHEN best IS NULL THEN 0 ELSE 1 END, gaps + coalesce(best.g, 0) FROM (
    SELECT *, list_sort(list_transform(list_filter(ys, lambda y: abs(y - xs[k]) <= 500 AND NOT list_contains(used, y)), lambda y: {'g': abs(y - xs[k]), 'y': y}))[1] AS best FROM s WHERE k <= len(xs))),
m AS (SELECT record_id, len(xs) AS n_a, len(ys) AS n_b, matched, gaps, matched / greatest(len(xs), 1) AS p, matched / greatest(len(ys), 1) AS r FROM s WHERE k = len(xs) + 1)
"""


def peak_pairs(spark, sf):
    m = marks(spark, sf)
    at = lambda kind, name: m.where(F.col("kind") == kind).select("record_id", (F.col("us") / F.lit(3e7)).alias(name)).distinct()
    return at("purchase", "x"), at("signup", "y"), 500.0


@query(MATCHED_SQL + "SELECT record_id, matched, round(gaps / matched, 2) + 0.0 AS mean_gap_ms FROM m WHERE matched > 0")
def detector_agreement(spark, sf):
    """Greedy one-to-one matches in peak order."""
    return L.one_to_one(*peak_pairs(spark, sf)).groupBy("record_id").agg(F.count(F.lit(1)).alias("matched"), rounded(F.avg("gap"), 2).alias("mean_gap_ms"))


@query(MATCHED_SQL + 'SELECT record_id, n_a, n_b, matched, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m')
def detector_agreement_f1(spark, sf):
    """The same matches as precision, recall and F1."""
    x = L.agreement(*peak_pairs(spark, sf))
    return x.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1")})


@query("""WITH RECURSIVE d AS (SELECT event_id AS key, CAST('{"a/b~' || event_type || '":[' || user_id || ',{"v":null}],"empty":{},"none":[],"props":' || props || '}' AS JSON) AS doc FROM events),
w AS (SELECT key, '' AS pointer, doc AS v FROM d UNION ALL SELECT key, pointer || '/' || replace(replace(m.k, '~', '~0'), '/', '~1'), json_extract(v, m.path)
FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'k': k, 'path': '$."' || k || '"'}) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {'k': CAST(i AS VARCHAR), 'path': '$[' || i || ']'}) ELSE [] END) AS m FROM w))
SELECT key, pointer, CAST(v AS VARCHAR) AS value FROM w WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') OR CAST(v AS VARCHAR) IN ('{}', '[]')""")
def iter_leaves(spark, sf):
    """Leaves of documents with nested, empty and escaped members."""
    doc = F.concat(F.lit('{"a/b~'), "event_type", F.lit('":['), F.col("user_id").cast("string"), F.lit(',{"v":null}],"empty":{},"none":[],"props":'), "props", F.lit("}"))
    return L.leaves(table(spark, sf, "events").select(F.col("event_id").alias("key"), doc.alias("doc")))


@query("""WITH e AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0), o AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT coalesce(e.o_orderkey, o.o_orderkey) AS key, e.o_orderkey IS NULL OR o.o_orderkey IS NULL AS missing, coalesce(e.o_orderkey, o.o_orderkey) % 17 = 0 AS other,
  coalesce(e.o_orderkey, o.o_orderkey) % 5 > 2 AS hr, coalesce(e.o_orderkey, o.o_orderkey) % 7 = 0 AS st, coalesce(e.o_orderkey, o.o_orderkey) % 19 = 0 AS q FROM e FULL JOIN o ON e.o_orderkey = o.o_orderkey),
n AS (SELECT *, CASE WHEN missing OR other THEN 0 ELSE hr::INT + st::INT END AS changed, CASE WHEN missing OR other OR NOT q THEN 0 ELSE 2 END AS removed, CASE WHEN missing OR other OR NOT q THEN 0 ELSE 1 END AS added FROM c)
SELECT key, CASE WHEN missing THEN 'missing' WHEN other THEN 'integrity_error' WHEN changed + removed + added > 0 THEN 'diff' ELSE 'pass' END AS status, CASE WHEN NOT missing AND other THEN 'adapter,fs' ELSE '' END AS mismatches, CAST(changed AS BIGINT) AS changed, CAST(removed AS BIGINT) AS removed, CAST(added AS BIGINT) AS added FROM n""")
def compare_case(spark, sf):
    """Documents of orders in two runs: rates may differ by 2, some inputs, members and cases differ."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    hr = F.floor("o_totalprice").cast("long")

    def case(rows: DataFrame, adapter: Column, fs: Column, rate: Column, status: Column, rest: Column) -> DataFrame:
        doc = F.concat(F.lit('{"hr":'), rate.cast("string"), F.lit(',"status":"'), status, F.lit('",'), rest, F.lit("}"))
        return rows.select(k.alias("key"), adapter.alias("adapter"), fs.alias("fs"), F.lit(None).cast("string").alias("window"), doc.alias("doc"))

    expected = case(o.where("o_orderkey % 13 <> 0"), F.lit("a"), F.lit(500), hr, F.col("o_orderstatus"), F.lit('"q":[1,{"x/y":[]}]'))
    rest = F.when(k % 19 == 0, '"q":[]').otherwise('"q":[1,{"x/y":[]}]')
    other = k % 17 == 0
    observed = case(o.where("o_orderkey % 11 <> 0"), F.when(other, "b").otherwise("a"), F.when(other, 250).otherwise(500), hr + k % 5, F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), rest)
    tolerances = spark.createDataFrame([("^/hr$", 2.0), ("^/h", 3.0)], "pattern string, at_most double")
    x = L.compare_cases(expected, observed, tolerances, ("adapter", "fs", "window"))
    return x.withColumn("mismatches", listed(F.col("mismatches")))


@query(MARKS_SQL + ", p AS (SELECT record_id, beat_id, median(amp) + 60 AS seg FROM beats GROUP BY ALL) SELECT record_id, round(median(seg) FILTER (seg BETWEEN 0 AND 200), 4) AS pr_segment_ms, count(*) FILTER (seg BETWEEN 0 AND 200) AS n FROM p GROUP BY record_id")
def pr_segment(spark, sf):
    """Median of P offset to QRS onset in 0 to 200 ms."""
    x = beats(spark, sf).withColumn("seg", F.col("amp") + 60.0)
    inside = F.when(F.col("seg").between(0, 200), F.col("seg"))
    return x.groupBy("record_id").agg(rounded(median(inside), 4).alias("pr_segment_ms"), F.count(inside).alias("n"))


@query(MARKS_SQL + """, v AS (SELECT record_id, beat_id // 3 AS beat, CASE WHEN record_id % 2 = 0 THEN 130 + amp % 20 + CASE WHEN (beat_id // 3) % 3 = 0 THEN 50 ELSE 0 END ELSE 110 + amp % 130 END AS pr, conf, kind = 'error' AS bad FROM beats),
b AS (SELECT record_id, beat, median(pr) AS pr FROM v WHERE pr BETWEEN 120 AND 220 AND conf >= 0.5 AND NOT bad GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS k, pr - lag(pr) OVER w AS gap FROM b WINDOW w AS (PARTITION BY record_id ORDER BY pr, beat)),
g AS (SELECT record_id, count(*) AS n, max(gap) AS widest, median(gap) AS usual FROM s GROUP BY record_id), c AS (SELECT record_id, min(k) - 1 AS lower FROM s JOIN g USING (record_id) WHERE gap = widest GROUP BY record_id),
d AS (SELECT g.record_id, n, lower, coalesce(n >= 5 AND widest >= 18 AND widest >= 2 * usual AND lower >= 3 AND n - lower >= 2, false) AS split FROM g LEFT JOIN c USING (record_id) WHERE n >= 2)
SELECT record_id, any_value(n) AS n_beats, any_value(split) AS split, round(CASE WHEN any_value(n) < 5 THEN median(pr) WHEN any_value(split) THEN quantile_cont(pr, 0.75) FILTER (k <= lower) ELSE quantile_cont(pr, 0.78) END, 6) AS pr_ms FROM s JOIN d USING (record_id) GROUP BY record_id""")
def pr_beat_core(spark, sf):
    """The core of a record's PR intervals by its beats."""
    beat = F.floor(F.col("beat_id") / 3).cast("long")
    two = 130 + F.col("amp") % 20 + F.when(beat % 3 == 0, 50).otherwise(0)
    v = beats(spark, sf).select("record_id", beat.alias("beat_id"), F.when(F.col("record_id") % 2 == 0, two).otherwise(110 + F.col("amp") % 130).alias("pr"), "conf", (F.col("kind") == "error").alias("unreliable"))
    return L.pr_beat_core(v).withColumn("pr_ms", rounded(F.col("pr_ms"), 6))

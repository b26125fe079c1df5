"""Fusion queries over ``lineitem``: orders as beats, line items as leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import median, rounded
from pulsequilt.operators import fusion as X
from pulsequilt.plans.registry import query
from pulsequilt.sources.adapters import table


def cells(spark, sf) -> DataFrame:
    """record_id (supplier), beat_id (order), lead, onset, offset, paced, conf, sigma, lead_group: one row a line item."""
    item = table(spark, sf, "lineitem")
    return item.select(F.col("l_suppkey").alias("record_id"), F.col("l_orderkey").alias("beat_id"), F.col("l_linenumber").alias("lead"), (200.0 - F.col("l_quantity")).alias("onset"), (230.0 + F.col("l_quantity")).alias("offset"), (F.col("l_returnflag") == "R").alias("paced"), (1.0 - F.col("l_tax") * 10.0).alias("conf"), (F.col("l_discount") * 200.0).alias("sigma"), F.col("l_linestatus").alias("lead_group"))


CELLS_SQL = """WITH c AS (SELECT l_suppkey AS record_id, l_orderkey AS beat_id, l_linenumber AS lead, 200 - l_quantity AS onset, 230 + l_quantity AS "offset", l_returnflag = 'R' AS paced, 1 - l_tax * 10 AS conf, l_discount * 200 AS sigma, l_linestatus AS lead_group FROM lineitem)
"""
PCT = "CASE WHEN count({0}) >= 4 THEN quantile_cont({0}, {1}) ELSE median({0}) END"


@query(CELLS_SQL + f""", g AS (SELECT record_id, lead AS beat_id, count(*) AS n, bool_or(paced) AND min(onset) < 155 AS p, {PCT.format('onset', 0.1)} AS o, median("offset") AS m, {PCT.format('"offset"', 0.75)} AS l, {PCT.format('"offset"', 0.9)} AS w FROM c GROUP BY ALL)
SELECT record_id, beat_id, n AS n_leads, CAST(trunc(o) AS BIGINT) AS qrs_on, CAST(trunc(CASE WHEN p OR n < 6 THEN m ELSE l END) AS BIGINT) AS qrs_off, CAST(trunc(CASE WHEN p THEN l ELSE w END) AS BIGINT) AS qrs_off_wide FROM g""")
def consensus_percentile(spark, sf):
    c = cells(spark, sf).withColumn("beat_id", F.col("lead"))
    low = c.groupBy("record_id", "beat_id").agg((F.bool_or("paced") & (F.min("onset") < 155)).alias("p"))
    return X.beat_consensus(c.join(low, ["record_id", "beat_id"]), F.col("p"))


@query(CELLS_SQL + """, g AS (SELECT record_id, lead AS beat_id, list_sort(list(onset) FILTER (conf >= 0.5)) AS e, median(onset) AS m FROM c GROUP BY ALL)
SELECT record_id, beat_id, CAST(CASE WHEN len(e) >= 4 THEN e[2] ELSE round_even(m, 0) END AS BIGINT) AS boundary, CASE WHEN len(e) >= 4 THEN 'confidence_gated_second_earliest' ELSE 'cluster_median' END AS method FROM g""")
def order_stat(spark, sf):
    x = cells(spark, sf).select("record_id", F.col("lead").alias("beat_id"), F.col("onset").alias("value"), (F.col("conf") >= 0.5).alias("eligible"))
    return X.gated_order_stat(x, "onset")


@query(CELLS_SQL + """, r AS (SELECT record_id, lead_group, greatest(0, conf) / greatest(sigma, 4) AS raw FROM c), t AS (SELECT *, sum(raw) OVER (PARTITION BY record_id, lead_group) AS total FROM r)
SELECT record_id, lead_group, count(*) AS n, round(sum(CASE WHEN total > 1 THEN raw / total ELSE raw END), 6) + 0.0 AS weight, round(max(CASE WHEN total > 1 THEN raw / total ELSE raw END), 6) + 0.0 AS heaviest FROM t GROUP BY ALL""")
def group_capped_weights(spark, sf):
    x = cells(spark, sf).select("record_id", "lead_group", "sigma", F.greatest(F.lit(0.0), F.col("conf")).alias("confidence"))
    return X.capped_weights(x, "record_id").groupBy("record_id", "lead_group").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("weight")).alias("weight"), rounded(F.max("weight")).alias("heaviest"))


@query("""WITH k AS (SELECT l_orderkey AS record_id, 0 AS beat_id, l_linenumber AS lead, l_quantity AS peak, max(l_extendedprice) AS weight FROM lineitem GROUP BY ALL),
n AS (SELECT c.record_id, c.centre, k.lead, k.peak, k.weight FROM (SELECT DISTINCT record_id, peak AS centre FROM k) c JOIN k ON k.record_id = c.record_id AND abs(k.peak - c.centre) <= 6),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY record_id, centre, lead ORDER BY weight DESC, peak) = 1),
g AS (SELECT record_id, centre, sum(weight) AS w, sum(weight * peak) AS wp, count(*) AS n_leads FROM b GROUP BY ALL)
SELECT record_id, round(wp / w, 4) AS anchor, n_leads FROM g QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round(w * CASE WHEN n_leads > 1 THEN n_leads ELSE 0.5 END, 9) DESC, centre) = 1""")
def peak_anchor(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.lit(0).alias("beat_id"), F.col("l_linenumber").alias("lead"), F.col("l_quantity").alias("peak"), F.col("l_extendedprice").alias("weight"))
    return X.peak_anchor(x, 6.0).select("record_id", rounded(F.col("anchor"), 4).alias("anchor"), "n_leads")


@query(CELLS_SQL + """, l AS (SELECT record_id, lead, median("offset" - onset) AS raw, max("offset" - onset) + 20 AS cons FROM c GROUP BY ALL), m AS (SELECT *, max(raw) OVER (PARTITION BY record_id) AS top, count(raw) OVER (PARTITION BY record_id) AS n FROM l)
SELECT record_id, lead, round(CASE WHEN n >= 3 AND cons > top + 12 THEN top ELSE cons END, 4) AS qrs_consensus_ms FROM m""")
def capped_consensus(spark, sf):
    x = cells(spark, sf).groupBy("record_id", "lead").agg(median(F.col("offset") - F.col("onset")).alias("raw"), (F.max(F.col("offset") - F.col("onset")) + 20.0).alias("consensus"))
    return X.cap_to_raw(x).select("record_id", "lead", rounded(F.col("capped"), 4).alias("qrs_consensus_ms"))


@query("""WITH m AS (SELECT l_orderkey AS record_id, l_quantity * 2 AS value, l_linestatus AS g FROM lineitem), d AS (SELECT *, abs(value - median(value) OVER (PARTITION BY record_id)) AS dev FROM m)
SELECT record_id, count(*) AS support, round(median(value), 4) AS t_offset, round(median(dev) * 1.4826, 4) AS mad, count(*) >= 4 AND median(dev) * 1.4826 <= 20 AND count(DISTINCT g) >= 2 AS reliable FROM d GROUP BY record_id""")
def t_fusion_quality(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.lit(0).alias("beat_id"), (F.col("l_quantity") * 2.0).alias("value"), F.col("l_linestatus").alias("lead_group"))
    return X.t_fusion_summary(x).select("record_id", "support", rounded(F.col("fused"), 4).alias("t_offset"), rounded(F.col("mad"), 4).alias("mad"), "reliable")

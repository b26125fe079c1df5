"""Merging queries over ``events``, and the mains frequency of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsequilt.functions.expressions import listed, rounded
from pulsequilt.operators import kernels as K
from pulsequilt.operators import merging as M
from pulsequilt.plans.registry import query
from pulsequilt.plans.signals import RATE, SIGNALS_SQL, limbs
from pulsequilt.sources.adapters import MARKS_SQL, marks

RADIUS, REACH = 4.0, 900


@query(MARKS_SQL.replace("WITH marks", "WITH RECURSIVE marks", 1) + f""", v AS (SELECT record_id, amp AS value, conf + 0.01 AS weight, row_number() OVER (PARTITION BY record_id ORDER BY amp, conf) AS i FROM marks),
w AS (SELECT record_id, i, value, weight, CAST(0 AS BIGINT) AS cluster, [value] AS vs, [weight] AS ws FROM v WHERE i = 1
UNION ALL SELECT record_id, i, value, weight, CASE WHEN joins THEN cluster ELSE cluster + 1 END, CASE WHEN joins THEN list_append(vs, value) ELSE [value] END, CASE WHEN joins THEN list_append(ws, weight) ELSE [weight] END FROM (
SELECT *, value - center <= {RADIUS} AND greatest(list_max(vs) - list_min(vs), value - center) <= 2 * {RADIUS} AS joins FROM (
SELECT v.record_id, v.i, v.value, v.weight, w.cluster, w.vs, w.ws, w.vs[list_min(list_filter(range(1, len(w.vs) + 1), lambda k: list_sum(w.ws[1:k]) >= list_sum(w.ws) / 2 OR k = len(w.vs)))] AS center FROM w JOIN v ON v.record_id = w.record_id AND v.i = w.i + 1)))
SELECT record_id, cluster, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high FROM w GROUP BY record_id, cluster""")
def compact_clusters(spark, sf):
    """Compact clusters of each record's amplitudes around their weighted median."""
    x = M.compact_clusters(marks(spark, sf).select("record_id", F.col("amp").alias("value"), (F.col("conf") + 0.01).alias("weight")), RADIUS)
    return x.groupBy("record_id", "cluster").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("value"), 4).alias("low"), rounded(F.max("value"), 4).alias("high"))


@query()
def merged_atrial_events(spark, sf):
    """Events of a record at one place, merged: views belong to complexes, the others are blocked."""
    m = marks(spark, sf)
    sample = (F.col("us") / 30_000_000).cast("long")
    e = m.select("record_id", sample.alias("sample"), sample.cast("double").alias("time_ms"), F.col("conf").alias("confidence"), F.when(F.col("kind") == "view", "conducted").otherwise("blocked").alias("association"), F.array("kind").alias("leads"))
    return M.merged_events(e, REACH).withColumn("leads", listed(F.col("leads")))


@query(SIGNALS_SQL + f""", n AS (SELECT record_id, count(*) AS n FROM s GROUP BY record_id), b AS (SELECT record_id, n, unnest(range(CAST(ceil(49 * n / {RATE}) AS BIGINT), CAST(floor(61 * n / {RATE}) AS BIGINT) + 1)) AS k FROM n),
d AS (SELECT l.record_id, lead, k, k * {RATE} / n AS hz, sum(x * cos(2 * pi() * k * i / n)) AS re, sum(x * sin(2 * pi() * k * i / n)) AS im FROM l JOIN b USING (record_id) WHERE x IS NOT NULL GROUP BY ALL),
p AS (SELECT record_id, lead, sum(re * re + im * im) FILTER (abs(hz - 50) <= 1) AS p50, sum(re * re + im * im) FILTER (abs(hz - 60) <= 1) AS p60 FROM d GROUP BY ALL)
SELECT record_id, CASE WHEN median(p60) > median(p50) THEN 60 ELSE 50 END AS mains_hz FROM p GROUP BY record_id""")
def mains_frequency(spark, sf):
    """Whether 50 or 60 Hz has more power in a recording."""
    return K.mains_frequency(limbs(spark, sf))

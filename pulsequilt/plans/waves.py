"""Waveform queries over ``embeddings`` as beat windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsequilt.functions.expressions import rounded
from pulsequilt.operators import waves as V
from pulsequilt.plans.registry import query
from pulsequilt.plans.rhythm import published
from pulsequilt.sources.adapters import WAVES_SQL, waveforms

UNIT_SQL = WAVES_SQL + """, c AS (SELECT beat_id, group_id, samples, list_transform(samples, lambda x: x - list_sum(samples) / 64) AS c FROM waves),
u AS (SELECT beat_id, group_id, samples, c, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS u FROM c)
"""
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"


@query(UNIT_SQL + "SELECT beat_id, i AS sample, round(c[i + 1] / sqrt(list_sum(list_transform(c, lambda y: y * y)) / 64), 6) + 0.0 AS z FROM c, range(64) r(i)")
def zscore(spark, sf):
    return waveforms(spark, sf).select("beat_id", F.posexplode(V.zscore(F.col("samples"))).alias("sample", "z")).select("beat_id", F.col("sample").cast("long").alias("sample"), rounded(F.col("z")).alias("z"))


@query(WAVES_SQL + "SELECT beat_id, round(list_sum(samples) - (samples[1] + samples[64]) / 2, 6) + 0.0 AS signed_area, round(list_sum(list_transform(samples, lambda x: abs(x))) - (abs(samples[1]) + abs(samples[64])) / 2, 6) + 0.0 AS absolute_area FROM waves")
def trapezoid(spark, sf):
    s = F.col("samples")
    return waveforms(spark, sf).select("beat_id", rounded(V.trapezoid(s)).alias("signed_area"), rounded(V.trapezoid(F.transform(s, lambda x: F.abs(x)))).alias("absolute_area"))


@query(UNIT_SQL + f", t AS (SELECT group_id AS g, arg_min(u, beat_id) AS t FROM u GROUP BY group_id) SELECT beat_id, group_id, round({DOT.format('u', 't')}, 6) + 0.0 AS r FROM u JOIN t ON g = group_id")
def template_corr(spark, sf):
    """Correlation with the group's first window."""
    x = V.with_units(waveforms(spark, sf))
    t = x.groupBy("group_id").agg(F.min_by("u", "beat_id").alias("t"))
    return x.join(t, "group_id").select("beat_id", "group_id", rounded(V.dot(F.col("u"), F.col("t"))).alias("r"))


@query(UNIT_SQL + f""", p AS (SELECT a.group_id, a.beat_id, avg({DOT.format('a.u', 'b.u')}) AS m, count(*) + 1 AS n FROM u a JOIN u b ON a.group_id = b.group_id AND a.beat_id <> b.beat_id GROUP BY ALL)
SELECT group_id, beat_id, n AS n_members, round(m, 6) + 0.0 AS mean_r FROM p QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(m, 9) DESC, beat_id) = 1""")
def medoid(spark, sf):
    return published(V.medoids(waveforms(spark, sf)), "group_id", "beat_id", "n_members", digits=6, mean_r="mean_r")


@query(WAVES_SQL + 'SELECT group_id, i AS "offset", round(median(samples[i + 1]), 6) + 0.0 AS value, count(*) AS n FROM waves, range(64) r(i) GROUP BY ALL')
def median_beat(spark, sf):
    return V.median_beats(waveforms(spark, sf)).select("group_id", F.col("offset").cast("long").alias("offset"), rounded(F.col("value")).alias("value"), "n")


@query(UNIT_SQL + f", n AS (SELECT group_id, beat_id, u, lead(beat_id) OVER w AS next_id, lead(u) OVER w AS v FROM u WINDOW w AS (PARTITION BY group_id ORDER BY beat_id)) SELECT group_id, beat_id, next_id, round({DOT.format('u', 'v')}, 6) + 0.0 AS r FROM n WHERE next_id IS NOT NULL")
def adjacent_corr(spark, sf):
    return published(V.adjacent(waveforms(spark, sf)), "group_id", "beat_id", "next_id", digits=6, r="r")


@query(WAVES_SQL + """, m AS (SELECT beat_id, group_id, list_median(samples) AS mid, samples FROM waves), d AS (SELECT beat_id, group_id, i, samples[i + 1] - mid AS dev FROM m, range(64) r(i))
SELECT beat_id, group_id, i AS peak, round(dev, 6) + 0.0 AS deviation FROM d QUALIFY row_number() OVER (PARTITION BY beat_id ORDER BY round(abs(dev), 9) DESC, i) = 1""")
def find_peak(spark, sf):
    x = V.extremum(waveforms(spark, sf))
    return x.select("beat_id", "group_id", F.col("peak").cast("long").alias("peak"), rounded(F.col("deviation")).alias("deviation"))


@query(WAVES_SQL + """, p AS (SELECT beat_id, i, samples[i + 1] AS v, samples[i] AS a, samples[i + 2] AS b FROM waves, range(1, 63) r(i)), t AS (SELECT * FROM p WHERE (v > a AND v >= b) OR (v < a AND v <= b)),
k AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY abs(v) DESC, i) - 1 AS rank FROM t) SELECT beat_id, rank, i AS sample, round(v, 6) + 0.0 AS amp FROM k WHERE rank < 3""")
def candidate_triplets(spark, sf):
    x = V.turning_points(waveforms(spark, sf))
    return x.select("beat_id", F.col("rank").cast("long").alias("rank"), F.col("sample").cast("long").alias("sample"), rounded(F.col("amp")).alias("amp"))

"""Signal queries: the vectors of ``embeddings``, put end to end, are the leads of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import centred, dot, rounded, spread, total
from pulsequilt.operators import kernels as K
from pulsequilt.operators import quality as Q
from pulsequilt.plans.registry import query
from pulsequilt.sources import signals as S
from pulsequilt.sources.adapters import table, waveforms


#: Vectors of 64 samples in a recording (half of them a lead, in turns), and its rate.
RECORD_VECTORS, RATE = 80, 250.0


def recordings(spark, sf) -> DataFrame:
    """record_id, lead (I, II), fs, samples: 40 vectors a lead in order of vec_id, ten seconds; recordings grow in number with the table. One shuffle by record, by number: what follows by record stays where it lies."""
    v = F.col("vec_id")
    e = table(spark, sf, "embeddings").select(F.floor(v / RECORD_VECTORS).cast("long").alias("record_id"), F.when(v % 2 == 0, "I").otherwise("II").alias("lead"), "vec_id", F.col("embedding").alias("x"))
    joined = spread(e, "record_id").groupBy("record_id", "lead").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("parts"))
    return joined.select("record_id", "lead", F.lit(RATE).alias("fs"), F.flatten(F.col("parts").getField("x")).cast("array<double>").alias("samples"))


def limbs(spark, sf) -> DataFrame:
    return S.limb_leads(S.pairs_of(recordings(spark, sf)))


SIGNALS_SQL = f"""WITH e AS (SELECT vec_id // {RECORD_VECTORS} AS record_id, vec_id % 2 AS two, embedding, row_number() OVER (PARTITION BY vec_id // {RECORD_VECTORS}, vec_id % 2 ORDER BY vec_id) - 1 AS k FROM embeddings),
t AS (SELECT record_id, two, k * 64 + j - 1 AS i, CAST(embedding[j] AS DOUBLE) AS x FROM e, range(1, 65) r(j)),
s AS (SELECT record_id, i, max(x) FILTER (two = 0) AS one, max(x) FILTER (two = 1) AS two FROM t GROUP BY ALL),
l AS (SELECT record_id, i, unnest(['I', 'II', 'III', 'aVR', 'aVL', 'aVF']) AS lead, unnest([one, two, two - one, -(one + two) / 2, one - two / 2, two - one / 2]) AS x FROM s)
"""


@query(SIGNALS_SQL + "SELECT record_id, lead, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high, round(sqrt(avg(x * x)), 6) AS rms FROM l GROUP BY ALL")
def limb_derive(spark, sf):
    s = F.col("samples")
    return limbs(spark, sf).select("record_id", "lead", rounded(F.array_min(s)).alias("low"), rounded(F.array_max(s)).alias("high"), rounded(F.sqrt(dot(s, s) / F.size(s))).alias("rms"))


@query(SIGNALS_SQL + ", p AS (SELECT record_id, lead, max(x) - min(x) AS ptp FROM l GROUP BY ALL) SELECT record_id, count(*) AS n_leads, round((max(ptp) - min(ptp)) / max(ptp), 6) AS peak_to_peak_spread, (max(ptp) - min(ptp)) / max(ptp) < 0.01 AS per_lead_normalized FROM p WHERE ptp > 0.05 GROUP BY record_id")
def calibration_check(spark, sf):
    p = limbs(spark, sf).select("record_id", (F.array_max("samples") - F.array_min("samples")).alias("ptp")).where("ptp > 0.05")
    spread = (F.max("ptp") - F.min("ptp")) / F.max("ptp")
    return p.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_leads"), rounded(spread).alias("peak_to_peak_spread"), (spread < 0.01).alias("per_lead_normalized"))


@query(SIGNALS_SQL + """, w AS (SELECT record_id, i, one AS a, two AS b, two - one AS c, -(one + two) / 2 AS r, one - two / 2 AS l, two - one / 2 AS f FROM s),
k AS (SELECT record_id, corr(a, -b) AS ab, corr(r, l) AS rl, corr(r, f) AS rf, corr(c, -a) AS ca, corr(l, f) AS lf, max(a) - min(a) AS pa, max(b) - min(b) AS pb, max(c) - min(c) AS pc FROM w GROUP BY record_id)
SELECT record_id, ab > 0.75 AND rl > 0.55 AS probable_ra_la, ab > 0.75 AND rf > 0.55 AS probable_ra_ll, ca > 0.65 AND lf > 0.55 AS probable_la_ll, greatest(pa, pb, pc) > 0.15 AND pb < 0.08 AND pc < 0.08 AS probable_ra_rl, round(ab, 6) + 0.0 AS corr_i_ii, round(rl, 6) + 0.0 AS corr_avr_avl FROM k""")
def limb_reversal(spark, sf):
    """Electrode swaps by correlations of limb leads and their ranges."""
    m = limbs(spark, sf).withColumn("c", centred(F.col("samples"))).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("lead", "c"))).alias("m"))
    r = lambda a, b: dot(F.col("m")[a], F.col("m")[b]) / F.sqrt(dot(F.col("m")[a], F.col("m")[a]) * dot(F.col("m")[b], F.col("m")[b]))
    span = lambda a: F.array_max(F.col("m")[a]) - F.array_min(F.col("m")[a])
    x = m.select("record_id", (-r("I", "II")).alias("ab"), r("aVR", "aVL").alias("rl"), r("aVR", "aVF").alias("rf"), (-r("III", "I")).alias("ca"), r("aVL", "aVF").alias("lf"), span("I").alias("pa"), span("II").alias("pb"), span("III").alias("pc"))
    c = F.col
    return x.select("record_id", ((c("ab") > 0.75) & (c("rl") > 0.55)).alias("probable_ra_la"), ((c("ab") > 0.75) & (c("rf") > 0.55)).alias("probable_ra_ll"), ((c("ca") > 0.65) & (c("lf") > 0.55)).alias("probable_la_ll"), ((F.greatest("pa", "pb", "pc") > 0.15) & (c("pb") < 0.08) & (c("pc") < 0.08)).alias("probable_ra_rl"), rounded(c("ab")).alias("corr_i_ii"), rounded(c("rl")).alias("corr_avr_avl"))


@query(SIGNALS_SQL + ", v AS (SELECT record_id, count(*) AS n FROM s GROUP BY record_id) SELECT record_id, lead, CASE WHEN record_id % 5 = 0 THEN 'sampling_rate_too_low' WHEN record_id % 7 = 0 THEN 'too_short' END AS error_code FROM v, (VALUES ('I'), ('II')) l(lead)")
def validate_prepare(spark, sf):
    """The first rule that a signal breaks: some of the recordings get a low rate or lose most samples."""
    x = recordings(spark, sf).withColumn("fs", F.when(F.col("record_id") % 5 == 0, 50.0).otherwise(F.col("fs"))).withColumn("samples", F.when(F.col("record_id") % 7 == 0, F.slice("samples", 1, 200)).otherwise(F.col("samples")))
    return S.checked(x).select("record_id", "lead", "error_code")


@query(SIGNALS_SQL + ", q AS (SELECT record_id, floor(i / 250.0) AS second, max(one) - min(one) AS span FROM s GROUP BY ALL) SELECT record_id, round(avg(CASE WHEN span < 0.75 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS flatline_fraction FROM q GROUP BY record_id")
def flatline_fraction(spark, sf):
    """The share of seconds of lead I whose range is small."""
    x = recordings(spark, sf).where("lead = 'I'").select("record_id", F.posexplode("samples")).groupBy("record_id", F.floor(F.col("pos") / 250.0).alias("second")).agg((F.max("col") - F.min("col")).alias("span"))
    return x.groupBy("record_id").agg(rounded(F.avg(F.when(F.col("span") < 0.75, 1.0).otherwise(0.0))).alias("flatline_fraction"))


@query()
def filters(spark, sf):
    """Band-passed and notched leads: their range and energy."""
    s = F.col("samples")
    return K.filtered(limbs(spark, sf)).select("record_id", "lead", rounded(F.array_max(s) - F.array_min(s), 4).alias("span"), rounded(total(s, lambda v: v * v), 4).alias("energy"))


@query()
def qrs_detect(spark, sf):
    return K.detected(limbs(spark, sf))


@query()
def delineation(spark, sf):
    return K.delineated(limbs(spark, sf))


@query()
def quality_full(spark, sf):
    return K.signal_quality(limbs(spark, sf)).withColumn("flags", F.array_join("flags", ","))


#: Beats of a record of clustering: records grow in number with the table, not in size.
RECORD_BEATS = 4096


@query()
def beat_clusters(spark, sf):
    return K.clustered(waveforms(spark, sf).select(F.floor(F.col("beat_id") / RECORD_BEATS).cast("long").alias("record_id"), "beat_id", "samples"))


@query()
def t_fusion(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_quantity") + 200).cast("long").alias("value"), (1.0 - F.col("l_discount") * 5).alias("weight"))
    return K.fused_t_ends(m, 500.0)


@query(SIGNALS_SQL + """, y AS (SELECT record_id, lead, i, x FROM l WHERE x IS NOT NULL), d AS (SELECT *, abs(x - lag(x) OVER w) <= 1e-8 AS still, max(x) OVER s - min(x) OVER s < 0.05 AS flat, x - avg(x) OVER (PARTITION BY record_id, lead) AS c FROM y
WINDOW w AS (PARTITION BY record_id, lead ORDER BY i), s AS (PARTITION BY record_id, lead ORDER BY i ROWS BETWEEN 125 PRECEDING AND 124 FOLLOWING))
SELECT record_id, lead, round(avg(CAST(still AS INTEGER)), 6) + 0.0 AS clipping, round(sqrt(avg(c * c)), 6) AS flat_std, round(avg(CAST(flat AS INTEGER)), 6) + 0.0 AS flat_fraction, round(avg(CASE WHEN abs(x) >= 0.95 * 0.4 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS saturation_fraction, round(avg(c * c * c * c) / (avg(c * c) * avg(c * c)), 5) AS k_sqi FROM d GROUP BY record_id, lead""")
def lead_scores(spark, sf):
    """Scores of limb leads that need no spectrum; the full scale is 0.4 mV."""
    x = K.lead_scores(limbs(spark, sf), full_scale_mv=0.4)
    return x.select("record_id", "lead", *(rounded(F.col(c), 5 if c == "k_sqi" else 6).alias(c) for c in ("clipping", "flat_std", "flat_fraction", "saturation_fraction", "k_sqi")))


@query()
def lead_quality(spark, sf):
    """All scores of limb leads, with flags, reliability of each wave and grade."""
    return Q.lead_grades(K.lead_scores(limbs(spark, sf))).withColumns({"flags": F.array_join("flags", ",")} | {c: rounded(F.col(c), 5) for c in ("baseline_wander", "muscle_noise", "powerline", "p_sqi", "k_sqi", "b_sqi", "flat_std", "flat_fraction", "clipping")}).drop("saturation_fraction")

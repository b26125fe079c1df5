"""Queries of the signal analysis beyond delineation: state space, sequences, pacing, residuals, families, repolarization, delays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import listed, rounded
from pulsequilt.operators import engine as E
from pulsequilt.operators import kernels as K
from pulsequilt.plans.registry import query
from pulsequilt.plans.signals import RATE, SIGNALS_SQL, limbs, recordings
from pulsequilt.sources.adapters import MARKS_SQL, beats, marks, table, waveforms

LIMIT, VARIANCE = 0.2, 1e-3
_V, _DT = f"CAST({VARIANCE} AS DOUBLE)", f"(1 / CAST({RATE} AS DOUBLE))"


@query(SIGNALS_SQL.replace("WITH e", "WITH RECURSIVE e", 1) + f""", y AS (SELECT record_id, i, one AS v FROM s WHERE one IS NOT NULL),
k AS (SELECT DISTINCT record_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS s, {_V} * 4 AS c00, CAST(0 AS DOUBLE) AS c01, CAST(0 AS DOUBLE) AS c10, {_V} AS c11 FROM y
UNION ALL SELECT record_id, i, l + g0 * e, s + g1 * e, (1 - g0) * c00, (1 - g0) * c01, c10 - g1 * c00, c11 - g1 * c01 FROM (
SELECT *, CASE WHEN seen THEN c00 / greatest(c00 + {_V}, 1e-12) ELSE 0 END AS g0, CASE WHEN seen THEN c10 / greatest(c00 + {_V}, 1e-12) ELSE 0 END AS g1, CASE WHEN seen THEN greatest(-3 * sqrt(greatest(c00 + {_V}, 1e-12)), least(3 * sqrt(greatest(c00 + {_V}, 1e-12)), v - l)) ELSE 0 END AS e FROM (
SELECT y.record_id, y.i, v, abs(v) <= {LIMIT} AS seen, l + {_DT} * s AS l, s, c00 + {_DT} * (c10 + c01) + {_DT} * {_DT} * c11 + {_V} * 0.002 AS c00, c01 + {_DT} * c11 AS c01, c10 + {_DT} * c11 AS c10, c11 + {_V} * 0.2 AS c11 FROM k JOIN y ON k.record_id = y.record_id AND y.i = k.i + 1)))
SELECT record_id, count(*) AS n, round(arg_max(l, i), 5) + 0.0 AS last_level, round(min(l), 5) + 0.0 AS low, round(max(l), 5) + 0.0 AS high, round(avg(l), 5) + 0.0 AS mean, round(avg(sqrt(greatest(c00, 0))), 6) + 0.0 AS mean_sigma FROM k WHERE i >= 0 GROUP BY record_id""")
def level_tracks(spark, sf):
    """The level-and-slope recursion over lead I of every recording."""
    x = E.level_tracks(recordings(spark, sf).where("lead = 'I'"), LIMIT, VARIANCE)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)
    return x.select("record_id", F.size("levels").cast("long").alias("n"), rounded(F.element_at("levels", -1), 5).alias("last_level"), rounded(F.array_min("levels"), 5).alias("low"), rounded(F.array_max("levels"), 5).alias("high"), rounded(mean(F.col("levels")), 5).alias("mean"), rounded(mean(F.transform("variances", lambda v: F.sqrt(v)))).alias("mean_sigma"))


@query()
def baseline_removed(spark, sf):
    """What the state-space baseline takes from each limb lead outside detected beats."""
    x = limbs(spark, sf)
    after = E.without_baseline(x, K.detected(x)).select("record_id", "lead", F.col("samples").alias("after"))
    taken = F.zip_with("samples", "after", lambda a, b: a - b)
    return x.join(after, ["record_id", "lead"]).select("record_id", "lead", rounded(F.array_max(taken) - F.array_min(taken), 4).alias("span"))


STATES = 3


def boundary_states(spark, sf) -> DataFrame:
    """Three candidate pairs a beat: a record's events are its beats; widths, bounds and costs follow from amplitude and confidence. Beats of low confidence have none."""
    b = beats(spark, sf).select("record_id", "beat_id", "amp", "conf", "kind")
    k = F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("k")
    x = b.select("*", k).withColumns({"anchor": F.col("beat_id") * 400.0, "rr": F.when(F.col("kind") == "error", 520.0).otherwise(400.0 + F.floor(F.col("amp") % 30)), "qrs_width": F.when(F.col("kind") == "signup", 70.0).otherwise(45.0)})
    seen = F.col("conf") >= 0.1
    on, off = F.col("anchor") + 100 + F.floor(F.col("amp") * (F.col("k") + 1)) % 41, F.col("anchor") + 200 + F.floor(F.col("amp") * (F.col("k") + 2)) % 61
    cost = (F.floor(F.col("amp") * 100) * (F.col("k") + 3)) % 997 / 997.0 + F.col("k") * 0.001
    return x.select("record_id", F.lit("II").alias("lead"), "beat_id", "anchor", "rr", "qrs_width", *(F.when(seen, v).alias(n) for n, v in (("state", F.col("k")), ("onset", on), ("offset", off), ("cost", cost))))


_MOVE = lambda d: f"least(abs({d} - 0.12 * (n.rr - w.rr)) / 20, 2)"


@query(MARKS_SQL.replace("WITH marks", "WITH RECURSIVE marks", 1) + f""", x AS (SELECT record_id, beat_id, conf >= 0.1 AS seen, k, CASE WHEN kind = 'error' THEN 520.0 ELSE 400.0 + floor(amp % 30) END AS rr, CASE WHEN kind = 'signup' THEN 70.0 ELSE 45.0 END AS width,
  100 + floor(amp * (k + 1)) % 41 AS on_, 200 + floor(amp * (k + 2)) % 61 AS off_, (floor(amp * 100) * (k + 3)) % 997 / 997.0 + k * 0.001 AS cost FROM beats, range({STATES}) r(k)),
n AS (SELECT record_id, beat_id, any_value(seen) AS seen, any_value(rr) AS rr, any_value(width) AS width, list(CAST(on_ AS DOUBLE) ORDER BY k) AS ons, list(CAST(off_ AS DOUBLE) ORDER BY k) AS offs, list(CAST(cost AS DOUBLE) ORDER BY k) AS costs FROM x GROUP BY ALL),
w AS (SELECT record_id, beat_id, seen, rr, width, ons, offs, costs FROM n WHERE beat_id = 0
UNION ALL SELECT n.record_id, n.beat_id, n.seen, n.rr, n.width, n.ons, n.offs, CASE WHEN NOT w.seen OR NOT n.seen THEN n.costs
  WHEN abs(n.width - w.width) > 15 OR greatest(n.rr, w.rr) > 1.2 * least(n.rr, w.rr) THEN list_transform(n.costs, lambda c: c + list_min(w.costs))
  ELSE list_transform(range(1, {STATES + 1}), lambda j: n.costs[j] + list_min(list_transform(range(1, {STATES + 1}), lambda q: w.costs[q] + 0.35 * ({_MOVE('(n.ons[j] - w.ons[q])')} + {_MOVE('(n.offs[j] - w.offs[q])')})))) END
FROM w JOIN n ON n.record_id = w.record_id AND n.beat_id = w.beat_id + 1),
e AS (SELECT *, lead(seen) OVER (PARTITION BY record_id ORDER BY beat_id) AS next_seen FROM w)
SELECT record_id, count(*) FILTER (seen) AS n_chosen, round(sum(list_min(costs)) FILTER (seen AND NOT coalesce(next_seen, false)), 6) + 0.0 AS cost FROM e GROUP BY record_id HAVING count(*) FILTER (seen) > 0""")
def boundary_sequences(spark, sf):
    """The cheapest sequence of boundary pairs of each record: beats it covers, and the cost of all its chains."""
    got = E.boundary_sequences(boundary_states(spark, sf), 500.0)
    return got.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_chosen"), rounded(F.sum(F.when(F.col("last"), F.col("chain_cost")))).alias("cost"))


@query()
def adaptive_qrs(spark, sf):
    return E.adaptive_detected(limbs(spark, sf)).withColumns({c: rounded(F.col(c), 4) for c in ("confidence", "strength")})


KINDS = "['view', 'click', 'error', 'signup', 'purchase']"
SPIKES_SQL = MARKS_SQL + f""", q AS (SELECT record_id, CAST(list_position({KINDS}, kind) AS VARCHAR) AS lead, (us // 20000000) % 5000 AS sample, amp / 20 AS score, 2.0 + mark % 3 AS width_ms, amp * 5 AS uv FROM marks),
g AS (SELECT *, CASE WHEN sample - lag(sample) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM q WHERE uv >= 250 WINDOW w AS (PARTITION BY record_id ORDER BY sample, lead)),
c AS (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY sample, lead ROWS UNBOUNDED PRECEDING) AS cluster FROM g),
m AS (SELECT record_id, cluster, CAST(floor((min(sample) + max(sample)) / 2) AS BIGINT) AS sample, count(DISTINCT lead) AS lead_votes, round(sum(least(score, 12.0)), 6) AS weighted_score, median(width_ms) AS median_width_ms FROM c GROUP BY ALL),
clusters AS (SELECT * FROM m WHERE lead_votes >= 3 OR (lead_votes >= 2 AND weighted_score >= 12))
"""


def spike_clusters_of(spark, sf) -> DataFrame:
    """Clusters of spike candidates: events as narrow deflections of five leads at 10 kHz."""
    lead = F.array_position(F.array(*(F.lit(k) for k in ("view", "click", "error", "signup", "purchase"))), F.col("kind")).cast("string")
    c = marks(spark, sf).select("record_id", lead.alias("lead"), F.lit(10_000.0).alias("fs"), (F.floor(F.col("us") / 20_000_000) % 5000).alias("sample"), (F.col("amp") / 20).alias("score"), (2.0 + F.col("mark") % 3).alias("width_ms"), (F.col("amp") * 5).alias("prominence_uv"))
    return E.spike_clusters(c, votes=3)


@query(SPIKES_SQL + "SELECT record_id, sample, lead_votes, weighted_score, median_width_ms FROM clusters")
def spike_clusters(spark, sf):
    return spike_clusters_of(spark, sf).withColumn("weighted_score", rounded(F.col("weighted_score")))


@query(SPIKES_SQL + """, i AS (SELECT *, sample - lag(sample) OVER (PARTITION BY record_id ORDER BY sample) AS interval FROM clusters), u AS (SELECT record_id, median(interval) AS usual, count(*) AS n, max(lead_votes) AS lead_votes FROM i GROUP BY record_id),
k AS (SELECT i.record_id, i.sample, u.lead_votes, i.sample - lag(i.sample) OVER (PARTITION BY i.record_id ORDER BY i.sample) AS d FROM i JOIN u USING (record_id) WHERE n < 3 OR interval IS NULL OR interval >= usual / 2),
a AS (SELECT record_id, median(d) AS m FROM k GROUP BY record_id), r AS (SELECT record_id, count(*) AS n, any_value(lead_votes) AS lead_votes, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY sample) AS spikes, CASE WHEN count(*) >= 3 AND any_value(m) > 0 THEN 1.4826 * median(abs(d - m)) / any_value(m) END AS cv FROM k JOIN a USING (record_id) GROUP BY record_id)
SELECT record_id, spikes, lead_votes, round(cv, 6) + 0.0 AS robust_cv, coalesce(cv < 0.15, false) AS paced, CASE WHEN cv < 0.15 THEN 'on' ELSE 'unknown' END AS state FROM r""")
def pacing_rhythm(spark, sf):
    """Spikes of each record without those too near another, and whether their intervals are regular."""
    x = E.pacing_rhythm(spike_clusters_of(spark, sf))
    return x.withColumns({"spikes": listed(F.col("spikes").cast("array<string>")), "robust_cv": rounded(F.col("robust_cv"))})


@query()
def pacing_spikes(spark, sf):
    """Spikes of the limb leads, and how much of each lead their removal changes."""
    x = limbs(spark, sf)
    rhythm = E.pacing_rhythm(E.spike_clusters(E.spike_candidates(x), votes=2, least_uv=100.0))
    after = E.despiked(x, rhythm).select("record_id", "lead", F.col("samples").alias("after"))
    changed = F.size(F.filter(F.zip_with("samples", "after", lambda a, b: a != b), lambda d: d))
    return x.join(after, ["record_id", "lead"]).join(rhythm, "record_id", "left").select("record_id", "lead", changed.alias("changed"), F.coalesce(F.size("spikes"), F.lit(0)).alias("n_spikes"), "state")


@query()
def flutter_spectra(spark, sf):
    """Residuals without QRST complexes: rate and shape of their spectra, and the record's facts."""
    x = limbs(spark, sf)
    facts = E.flutter_facts(E.residual_spectra(x, K.detected(x)))
    return facts.withColumns({"flutter_bpm": rounded(F.col("flutter_bpm"), 2), "mean_entropy": rounded(F.col("mean_entropy"), 5)})


def family_windows(spark, sf) -> DataFrame:
    """Windows of 64 samples in records of a thousand; every ninth is paced, intervals follow from the number."""
    b = F.col("beat_id")
    return waveforms(spark, sf).select(F.floor(b / 1000).cast("long").alias("record_id"), "beat_id", "samples", F.when(b % 13 != 0, 600.0 + b * 37 % 500).alias("rr_prev"), (b % 9 == 0).alias("paced"))


@query()
def morphology_families(spark, sf):
    """Families of windows within pacing state and RR context, with the representative of each."""
    w = family_windows(spark, sf)
    members = w.join(E.families(w, threshold=0.3), ["record_id", "beat_id"])
    return E.representatives(members).select("record_id", "family", "n", "n_used", rounded(F.array_max("samples") - F.array_min("samples"), 4).alias("span"))


@query()
def wavelet_t(spark, sf):
    return E.wavelet_t_bounds(limbs(spark, sf))


@query()
def lead_delays(spark, sf):
    """Delays between limb leads, and the leads' spans once correctable ones are undone."""
    x = limbs(spark, sf)
    delays = E.lead_delays(x)
    after = E.without_delays(x, delays).select("record_id", "lead", rounded(F.array_max("samples") - F.array_min("samples"), 4).alias("span"))
    return delays.join(after, ["record_id", "lead"]).withColumns({c: rounded(F.col(c), 4) for c in ("delay", "spread_ms", "raw_corr", "corr")})


@query()
def p_wave_assessments(spark, sf):
    """P waves of the limb leads' beats, beat by beat."""
    return E.p_wave_assessments(limbs(spark, sf)).drop("per_lead").withColumns({c: rounded(F.col(c), 4) for c in ("onset_sigma_ms", "offset_sigma_ms")})


@query()
def p_wave_summary(spark, sf):
    return E.p_wave_summary(E.p_wave_assessments(limbs(spark, sf))).withColumn("present_share", rounded(F.col("present_share"), 5))


@query()
def wave_measures(spark, sf):
    """QRS deflections, ST levels and pattern, and U waves of the limb leads' beats."""
    x = E.wave_measures(limbs(spark, sf)).withColumns({"notched": F.col("n_notches") > 1, "reliable": F.lit(True)})
    x = E.st_patterns(x)
    return x.select(*(rounded(F.col(n), 5).alias(n) if kind == "double" else F.col(n) for n, kind in x.dtypes))


_ST_SQL = {"slope": "CASE WHEN l_suppkey % 11 > 0 THEN CAST(l_partkey % 41 - 20 AS DOUBLE) / 10000 END", "j": "CAST(l_suppkey % 50 - 10 AS DOUBLE) / 100", "s40": "CASE WHEN l_orderkey % 13 > 0 THEN CAST(l_orderkey % 50 - 10 AS DOUBLE) / 100 END", "s80": "CAST(l_partkey % 50 - 10 AS DOUBLE) / 100", "noise": "CAST(l_suppkey % 5 AS DOUBLE) / 100"}


@query(f"""WITH s AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ST_SQL.items())}, l_quantity > 30 AS notched, l_tax < 0.08 AS reliable FROM lineitem),
t AS (SELECT *, CASE WHEN slope IS NULL THEN 'unknown' WHEN slope > 0.0005 THEN 'upsloping' WHEN slope < -0.0005 THEN 'downsloping' ELSE 'horizontal' END AS st_trend, s80 - 2 * s40 + j AS bend, greatest(0.02, 3 * noise) AS lim FROM s),
u AS (SELECT *, CASE WHEN bend IS NULL THEN 'unknown' WHEN bend > lim THEN 'concave-up' WHEN bend < -lim THEN 'concave-down' ELSE 'straight' END AS st_shape FROM t)
SELECT st_trend, st_shape, CASE WHEN NOT reliable OR st_trend = 'unknown' THEN 'unknown' WHEN st_trend = 'downsloping' THEN 'downsloping' WHEN j >= 0.1 AND (notched OR st_shape = 'concave-up') THEN 'j_point_elevation' WHEN st_trend = 'upsloping' THEN 'slow_upsloping' ELSE 'horizontal' END AS st_pattern, count(*) AS n FROM u GROUP BY ALL""")
def st_patterns(spark, sf):
    """ST segments by trend, shape and named pattern."""
    names = {"slope": "st_slope", "j": "j_mv", "s40": "st40_mv", "s80": "st80_mv", "noise": "noise_mv"}
    x = table(spark, sf, "lineitem").select(*(F.expr(e).alias(names[n]) for n, e in _ST_SQL.items()), (F.col("l_quantity") > 30).alias("notched"), (F.col("l_tax") < 0.08).alias("reliable"))
    return E.st_patterns(x).groupBy("st_trend", "st_shape", "st_pattern").agg(F.count(F.lit(1)).alias("n"))


@query()
def beat_groups(spark, sf):
    """Groups of the limb leads' beats: narrow and wide apart, every seventh beat taken as paced."""
    x = limbs(spark, sf)
    paced = K.detected(x).where("beat_id % 7 = 3").select("record_id", "beat_id")
    return E.beat_groups(x, paced).withColumn("width_ms", rounded(F.col("width_ms"), 4))

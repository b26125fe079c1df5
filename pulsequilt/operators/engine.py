"""The analysis of sampled signals beyond plain delineation, as Spark operators.

Kernels run in Arrow batches, on rows that hold a lead or a record's leads; what
they give (candidates, votes, shares) is long rows that DataFrame code joins,
groups and decides on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions import atrial as A
from pulsequilt.functions import beats as B
from pulsequilt.functions import dsp
from pulsequilt.functions import segments as G
from pulsequilt.functions import series as X
from pulsequilt.functions.expressions import let, median, middle, spread
from pulsequilt.operators.kernels import per_record, records

# ---------------------------------------------------------------- state space


def level_tracks(signals: DataFrame, limit: float, variance: float) -> DataFrame:
    """record_id, lead, levels, variances (arrays) of signals: the level-and-slope recursion with samples beyond ``limit`` masked out. All leads of an Arrow batch take each step together; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("samples")
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            offsets, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():  # leads of one length together
                at = np.flatnonzero(sizes == n)
                y = np.stack([flat[offsets[k] : offsets[k] + n] for k in at])
                level, var = X.levels(y, np.abs(y) <= limit, float(batch.column("fs")[int(at[0])].as_py()), np.zeros(len(y)), np.full(len(y), variance))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n, pa.int32()), pa.array(v.ravel()))  # noqa: B023, E731
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("record_id"), part.column("lead"), lists(level), lists(var)], names=["record_id", "lead", "levels", "variances"])

    return signals.select("record_id", "lead", "fs", "samples").mapInArrow(run, "record_id long, lead string, levels array<double>, variances array<double>")


def without_baseline(signals: DataFrame, beats: DataFrame, before_ms: float = 60.0, after_ms: float = 450.0) -> DataFrame:
    """signals with the state-space level taken off: the level is learnt outside the beats (record_id, r_sample), from before_ms ahead of R to after_ms behind it."""
    marks = beats.groupBy("record_id").agg(F.array_sort(F.collect_list(F.col("r_sample").cast("long"))).alias("r"))
    rows = records(signals).join(marks, "record_id", "left")
    rows = rows.withColumn("samples", F.concat("samples", F.array(F.coalesce(F.transform("r", lambda v: v.cast("double")), F.array().cast("array<double>"))))).drop("r")

    def kernel(record_id, fs, leads, x, r_at):
        seen = np.ones(x.shape[1], bool)
        for r in r_at:
            seen[max(0, int(r) - round(before_ms * fs / 1000)) : int(r) + round(after_ms * fs / 1000)] = False
        y = x - X.baseline(x, np.broadcast_to(seen, x.shape), fs)
        return [{"record_id": record_id, "lead": lead, "fs": fs, "samples": row.tolist()} for lead, row in zip(leads, y, strict=True)]

    return with_marks(rows, kernel, "record_id long, lead string, fs double, samples array<double>")


def with_marks(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """per_record for rows whose last array of samples are a record's marks: kernel(record_id, fs, leads, matrix, marks)."""
    target = rows.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("samples"))
            flat, inner, outer = column.values.values.to_numpy(zero_copy_only=False), column.values.offsets.to_numpy(), column.offsets.to_numpy()
            for k, (record_id, fs, leads) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record_id", "fs", "leads")), strict=True)):
                parts = [flat[inner[j] : inner[j + 1]] for j in range(outer[k], outer[k + 1])]
                made = kernel(record_id, fs, leads, np.array(parts[:-1], float), parts[-1])
                if made:
                    yield pa.RecordBatch.from_pylist(made, arrow)

    return rows.mapInArrow(run, target)


# ---------------------------------------------------------------- sequences of boundaries


#: What is told of a beat, and of each of its states.
_BEAT, _STATE = ["record_id", "lead", "beat_id", "anchor", "rr", "qrs_width"], ["state", "onset", "offset", "cost"]


def _beats_at_once(states: DataFrame) -> DataFrame:
    """Rows of states that follow one another and tell the same of their beat, as one row with lists. Nothing is shuffled; a beat whose states lie apart has several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in _BEAT]  # nulls have a code, too
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            starts = np.flatnonzero(new)
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(starts)) for c in _BEAT), *(pa.ListArray.from_arrays(offsets, batch.column(c)) for c in _STATE)], names=[*_BEAT, *_STATE])

    return states.mapInArrow(run, "record_id long, lead string, beat_id long, anchor double, rr double, qrs_width double, state array<long>, onset array<double>, offset array<double>, cost array<double>")


def boundary_sequences(states: DataFrame, fs: float) -> DataFrame:
    """record_id, lead, beat_id, state, chain_cost, last (no chosen beat has the next beat_id) of the cheapest sequence of boundary pairs; states: record_id, lead, beat_id, anchor, rr, qrs_width, state, onset, offset, cost (samples).

    Exact over all sequences. Moves of both bounds against the beats cost up to a cap;
    a change of QRS width or RR, or a gap, breaks the coupling; a beat whose states are all
    null breaks the chain. One shuffle by record and lead, of a beat's states together and
    their bounds from its anchor; a task holds the candidates of one beat and the back
    pointers since the last break.
    """
    rows = states.select(F.col("record_id").cast("long").alias("record_id"), F.col("lead").cast("string").alias("lead"), F.col("beat_id").cast("long").alias("beat_id"), *(F.col(n).cast("double").alias(n) for n in _BEAT[3:]), F.col("state").cast("long").alias("state"), *(F.col(n).cast("double").alias(n) for n in _STATE[1:]))
    rows = rows.withColumns({n: F.col(n) - F.coalesce("anchor", F.lit(0.0)) for n in ("onset", "offset")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, group, beat, held, waiting = X.Chain(fs), None, None, [], None
        picked: dict[int, list[int]] = {}

        def told(done: list) -> list[tuple]:
            return [(*group, b, picked.pop(b)[k], c) for b, k, c in done]

        def ended() -> list[tuple]:
            """The beat in hand goes to the chain: its states in order, nulls first, with what the first one tells of it."""
            if beat is None:
                return []
            (anchor, rr, width), found, *bounds = held[0]
            if len(held) > 1 or any(None in x for x in (found, *bounds)) or found != sorted(found):
                rows = sorted(((*s, facts) for facts, *lists in held for s in zip(*lists, strict=True)), key=lambda s: (s[0] is not None, s[0] or 0))
                anchor, rr, width = rows[0][4]
                found, *bounds = [[s[i] for s in rows if None not in s[:4]] for i in range(4)]
            if found and anchor is None:
                raise TypeError(f"no anchor of beat {beat} of record {group[0]}")
            picked[beat] = found
            out = told(chain.add(beat, anchor, rr or 0.0, width, *(np.array(x, float) for x in bounds)))
            if not found:
                picked.pop(beat, None)
            return out

        def batch_of(rows: list[tuple], more: bool) -> list[pa.RecordBatch]:
            """All rows but the last one, which waits as long as there may be more: the next one tells whether it is last."""
            nonlocal waiting
            rows = [waiting, *rows] if waiting else rows
            if not rows:
                return []
            made = [(*x, y is None or y[:2] != x[:2] or y[2] != x[2] + 1) for x, y in zip(rows, [*rows[1:], None], strict=True)]
            waiting = rows[-1] if more else None
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            made = made[:-1] if more else made
            return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["record_id", "lead", "beat_id", "state", "chain_cost", "last"])] if made else []

        for batch in batches:
            out = []
            offsets = batch.column("state").offsets.to_numpy()
            ends = (offsets - offsets[0]).tolist()
            flat = [batch.column(c).flatten().to_pylist() for c in _STATE]
            for k, (record_id, lead, b, *facts) in enumerate(zip(*(batch.column(c).to_pylist() for c in _BEAT), strict=True)):
                if (record_id, lead) != group or b != beat:
                    out += ended()
                    held = []
                    if (record_id, lead) != group:
                        out += told(chain.close()) if group else []
                        group = record_id, lead
                    beat = b
                held.append((facts, *(x[ends[k] : ends[k + 1]] for x in flat)))
            yield from batch_of(out, True)
        out = ended()
        if group:
            out += told(chain.close())
        yield from batch_of(out, False)

    return spread(_beats_at_once(rows), "record_id", "lead").sortWithinPartitions("record_id", "lead", "beat_id").mapInArrow(run, "record_id long, lead string, beat_id long, state long, chain_cost double, last boolean")


# ---------------------------------------------------------------- detection


def adaptive_detected(signals: DataFrame) -> DataFrame:
    """record_id, beat_id, r_sample, confidence, strength: channels vote, faint additions to plain detection's beats go."""

    def kernel(record_id, fs, leads, x):
        found = B.adaptive_peaks(x, fs)
        keep = B.without_weak(np.array([p for p, _, _ in found], int), dsp.qrs_peaks(x, fs), x, fs)
        return [{"record_id": record_id, "beat_id": k, "r_sample": p, "confidence": float(c), "strength": float(s)} for k, (p, c, s) in enumerate(f for f, ok in zip(found, keep, strict=True) if ok)]

    return per_record(records(signals), kernel, "record_id long, beat_id long, r_sample long, confidence double, strength double")


# ---------------------------------------------------------------- pacing spikes

#: Votes of leads, microvolts, ms that part clusters, clip of a score and least sum of scores with a vote less, spread of intervals of a paced rhythm.
VOTES, PROMINENCE_UV, MERGE_MS, SCORE_CLIP, SCORE_SUM, PACED_CV = 4, 250.0, 5.0, 12.0, 12.0, 0.15


def spike_candidates(signals: DataFrame) -> DataFrame:
    """record_id, lead, fs, sample, score, width_ms, prominence_uv: narrow deflections of each lead. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "lead", "fs", "sample", "score", "width_ms", "prominence_uv"]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = batch.column(3)
            offsets, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
            made = []
            for k, (r, lead, fs) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                made += [(r, lead, fs, *c) for c in B.spike_candidates(flat[offsets[k] : offsets[k + 1]].astype(float), fs)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return signals.select(F.col("record_id").cast("long").alias("record_id"), "lead", F.col("fs").cast("double").alias("fs"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, "record_id long, lead string, fs double, sample long, score double, width_ms double, prominence_uv double")


def spike_clusters(candidates: DataFrame, votes: int = VOTES, least_uv: float = PROMINENCE_UV) -> DataFrame:
    """record_id, sample, lead_votes, weighted_score, median_width_ms: candidates no further than 5 ms apart, in a chain, that enough leads tell; a vote less will do with high scores. One shuffle by record."""
    w = Window.partitionBy("record_id").orderBy("sample", "lead")
    gap = F.greatest(F.lit(1), F.floor(F.lit(MERGE_MS / 1000) * F.col("fs")))
    x = spread(candidates.where(F.col("prominence_uv") >= least_uv), "record_id")
    x = x.withColumn("new", F.coalesce((F.col("sample") - F.lag("sample").over(w) > gap).cast("int"), F.lit(1))).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = x.groupBy("record_id", "cluster").agg(
        F.floor((F.min("sample") + F.max("sample")) / 2).alias("sample"),
        F.size(F.collect_set("lead")).cast("long").alias("lead_votes"),  # counted in place: a distinct count would sort four times more
        F.sum(F.least("score", F.lit(SCORE_CLIP))).alias("weighted_score"),
        median("width_ms").alias("median_width_ms"),
    )
    weak = (F.col("lead_votes") >= max(2, votes - 1)) & (F.col("weighted_score") >= SCORE_SUM)
    return c.where((F.col("lead_votes") >= votes) | weak).drop("cluster")


def pacing_rhythm(clusters: DataFrame) -> DataFrame:
    """record_id, spikes (samples in order), lead_votes, robust_cv, paced, state of records with spikes.

    With three or more, a spike nearer than half the median interval behind another goes.
    Paced are records with three or more spikes at regular intervals (state on); else unknown.
    One shuffle by record at most, and no join: a record's spikes are held together, as they are told.
    """
    gaps = lambda xs: F.transform(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), lambda v, k: v - F.get(xs, k))
    x = clusters.groupBy("record_id").agg(F.array_sort(F.collect_list("sample")).alias("all"), F.max("lead_votes").alias("lead_votes"))
    x = x.withColumn("usual", middle(gaps(F.col("all"))))
    far = let(F.col("all"), lambda xs: F.filter(xs, lambda v, k: (k == 0) | (v - F.get(xs, k - 1) >= F.col("usual") / 2)))
    x = x.withColumn("spikes", F.when(F.size("all") < 3, F.col("all")).otherwise(far)).withColumn("gaps", gaps(F.col("spikes")))
    x = x.withColumn("m", middle(F.col("gaps"))).withColumn("mad", middle(F.transform("gaps", lambda d: F.abs(d - F.col("m")))))
    cv = F.when(F.col("m") > 0, 1.4826 * F.col("mad") / F.col("m"))
    x = x.withColumn("robust_cv", F.when(F.size("spikes") >= 3, cv))
    paced = F.coalesce(F.col("robust_cv") < PACED_CV, F.lit(False))
    return x.select("record_id", "spikes", "lead_votes", "robust_cv", paced.alias("paced"), F.when(paced, "on").otherwise("unknown").alias("state"))


def despiked(signals: DataFrame, rhythm: DataFrame) -> DataFrame:
    """signals with straight lines in place of the spikes of pacing_rhythm, on the arrays themselves; records without spikes stay. A spike list is a record's."""
    half = F.greatest(F.lit(1), F.round(F.col("fs") * B.HALF_OUT / 1000).cast("int"))
    x = signals.join(rhythm.select("record_id", "spikes"), "record_id", "left").withColumn("half", half)
    n = F.size("samples")

    def cleaned(samples: Column, s: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), s - F.col("half")).cast("int"), F.least(n - 1, s + F.col("half")).cast("int")
        left, right = F.get(samples, lo - 1), F.get(samples, hi + 1)
        a, b = F.coalesce(left, right, F.lit(0.0)), F.coalesce(right, left, F.lit(0.0))
        line = F.transform(F.sequence(F.lit(0), hi - lo), lambda k: a + (b - a) * k / F.greatest(hi - lo, F.lit(1)))
        return F.when(lo <= hi, F.concat(F.slice(samples, 1, lo), line, F.slice(samples, hi + 2, n))).otherwise(samples)

    spikes = F.coalesce("spikes", F.array().cast("array<long>"))
    return x.withColumn("samples", F.aggregate(spikes, F.col("samples"), cleaned)).drop("spikes", "half")


# ---------------------------------------------------------------- atrial residual


def residual_spectra(signals: DataFrame, beats: DataFrame) -> DataFrame:
    """record_id, lead, left (share of beats' power that is left), bpm, peak_ratio, narrowness, organized, entropy, periodicity of what stays without QRST complexes; beats: record_id, r_sample."""
    marks = beats.groupBy("record_id").agg(F.array_sort(F.collect_list(F.col("r_sample").cast("double"))).alias("r"))
    rows = records(signals).join(marks, "record_id", "left")
    rows = rows.withColumn("samples", F.concat("samples", F.array(F.coalesce("r", F.array().cast("array<double>"))))).drop("r")

    def kernel(record_id, fs, leads, x, r_at):
        rest, left = X.without_beats(x, r_at.astype(int), fs)
        return [{"record_id": record_id, "lead": lead, "left": None if np.isnan(left) else left, **X.flutter(row, fs)} for lead, row in zip(leads, rest, strict=True)]

    return with_marks(rows, kernel, "record_id long, lead string, left double, bpm double, peak_ratio double, narrowness double, organized double, entropy double, periodicity double")


#: What a lead's spectrum must show of organized flutter waves, and leads that must agree within so many beats a minute.
NARROWNESS, PEAK_RATIO, AGREE_LEADS, AGREE_BPM = 0.52, 6.0, 2, 20.0


def flutter_facts(spectra: DataFrame) -> DataFrame:
    """record_id, n_leads, n_supporting, flutter_bpm, flutter, mean_entropy: leads whose peak is narrow and prominent, and whether enough of them agree with their median rate."""
    good = (F.col("narrowness") >= NARROWNESS) & (F.col("peak_ratio") >= PEAK_RATIO)
    rate = spectra.groupBy("record_id").agg(median(F.when(good, F.col("bpm"))).alias("flutter_bpm"))
    near = good & (F.abs(F.col("bpm") - F.col("flutter_bpm")) <= AGREE_BPM)
    x = spectra.join(rate, "record_id").groupBy("record_id", "flutter_bpm").agg(F.count(F.lit(1)).alias("n_leads"), F.count_if(near).alias("n_supporting"), F.avg("entropy").alias("mean_entropy"))
    return x.withColumn("flutter", F.col("n_supporting") >= AGREE_LEADS)


def p_wave_assessments(signals: DataFrame) -> DataFrame:
    """A row a beat: record_id, beat_id, state, reason, onset, peak, offset (samples), onset_sigma_ms, offset_sigma_ms, t_rank, support (leads that tell) and per_lead (array of lead, onset, peak, offset)."""

    def kernel(record_id, fs, leads, x):
        r_at, out = dsp.qrs_peaks(x, fs), []
        for k, w in enumerate(A.p_waves(x, fs, r_at)):
            per_lead = [{"lead": leads[i], "onset": a, "peak": p, "offset": b} for i, a, p, b in w.pop("leads")]
            out.append({"record_id": record_id, "beat_id": k, **w, "support": len(per_lead), "per_lead": per_lead})
        return out

    return per_record(records(signals), kernel, "record_id long, beat_id long, state string, reason string, onset long, peak long, offset long, onset_sigma_ms double, offset_sigma_ms double, t_rank long, support long, per_lead array<struct<lead:string,onset:long,peak:long,offset:long>>")


def p_wave_summary(assessments: DataFrame) -> DataFrame:
    """record_id, n_beats, n_present, present_share, p_samples (median duration of accepted P waves) and rise_iqr (spread of the time from onset to peak, small where the waves have one shape)."""
    ok = F.col("state") == "P_PRESENT"
    rise = F.when(ok, F.col("peak") - F.col("onset"))
    x = assessments.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"), F.count_if(ok).alias("n_present"), median(F.when(ok, F.col("offset") - F.col("onset"))).alias("p_samples"), (F.percentile(rise, F.lit(0.75)) - F.percentile(rise, F.lit(0.25))).alias("rise_iqr"))
    return x.withColumn("present_share", F.col("n_present") / F.col("n_beats"))


# ---------------------------------------------------------------- QRS, ST and U

_DEFLECTIONS = ("q_mv", "r_mv", "s_mv", "r_prime_mv", "s_prime_mv", "q_ms", "r_ms", "s_ms", "r_prime_ms", "s_prime_ms", "area_mv_ms")
_ST = ("j_mv", "st20_mv", "st40_mv", "st60_mv", "st80_mv", "st_mean_mv", "st_slope")


def wave_measures(signals: DataFrame) -> DataFrame:
    """A row a beat and lead: deflections of QRS, ST levels and slope, the U wave (or why there is none), and the noise before QRS; levels are against the median of 20 ms before QRS."""

    def kernel(record_id, fs, leads, x):
        r_at, out = dsp.qrs_peaks(x, fs), []
        for lead, row in zip(leads, x, strict=True):
            marks = dsp.delineate(row, fs, r_at)
            for k, m in enumerate(marks):
                on, off = m["qrs_on"], m["qrs_off"]
                before = row[max(0, on - round(0.02 * fs)) : on + 1]
                level = float(np.median(before))
                cap = marks[k + 1]["qrs_on"] - round(0.12 * fs) if k + 1 < len(marks) else None
                u = G.u_wave(row, m["t_off"], level, fs, cap) if m["t_off"] is not None else {"u_peak": None, "u_mv": None, "u_on": None, "u_off": None, "u_reject": "no_t_offset"}
                out.append({"record_id": record_id, "beat_id": k, "lead": lead, **G.qrs_deflections(row, on, off, m["r_peak"], level, fs), **G.st_levels(row, off, level, fs), **u, "noise_mv": float(X.spread(np.diff(before))) if before.size > 2 else 0.0})
        return out

    numbers = ", ".join(f"{n} double" for n in (*_DEFLECTIONS, *_ST))
    return per_record(records(signals), kernel, f"record_id long, beat_id long, lead string, {numbers}, n_turns long, n_notches long, u_peak long, u_mv double, u_on long, u_off long, u_reject string, noise_mv double")


#: mV a ms that make a trend, mV of curvature and sigmas of noise that make a shape, mV of a high J point.
TREND, CURVATURE_MV, CURVATURE_SIGMAS, HIGH_J = 0.0005, 0.020, 3.0, 0.10


def st_patterns(rows: DataFrame) -> DataFrame:
    """rows with st_trend, st_shape and st_pattern from st_slope, j_mv, st40_mv, st80_mv, noise_mv, notched and reliable (a missing one counts as true); numbers that are not finite count as missing."""
    c = lambda n: F.when(F.abs(n) < float("inf"), F.col(n))
    trend = F.when(c("st_slope").isNull(), "unknown").when(c("st_slope") > TREND, "upsloping").when(c("st_slope") < -TREND, "downsloping").otherwise("horizontal")
    bend, limit = c("st80_mv") - 2.0 * c("st40_mv") + c("j_mv"), F.greatest(F.lit(CURVATURE_MV), CURVATURE_SIGMAS * F.coalesce(c("noise_mv"), F.lit(0.0)))
    shape = F.when(bend.isNull(), "unknown").when(bend > limit, "concave-up").when(bend < -limit, "concave-down").otherwise("straight")
    x = rows.withColumns({"st_trend": trend, "st_shape": shape})
    early = F.coalesce(c("j_mv") >= HIGH_J, F.lit(False)) & (F.coalesce("notched", F.lit(False)) | (F.col("st_shape") == "concave-up"))
    pattern = F.when(~F.coalesce("reliable", F.lit(True)) | (F.col("st_trend") == "unknown"), "unknown").when(F.col("st_trend") == "downsloping", "downsloping").when(early, "j_point_elevation").when(F.col("st_trend") == "upsloping", "slow_upsloping").otherwise("horizontal")
    return x.withColumn("st_pattern", pattern)


# ---------------------------------------------------------------- families and representatives


def beat_groups(signals: DataFrame, paced: DataFrame | None = None, outliers: bool = False) -> DataFrame:
    """record_id, beat_id, r_sample, width_ms, wide, paced, group_id (from 1, by falling size): narrow and wide beats grouped by shape apart, paced ones (record_id, beat_id) in a group of their own.

    Ties in size go to narrow before wide groups, and then to the one that began first; paced ones come last.
    """

    def kernel(record_id, fs, leads, x):
        r_at = dsp.qrs_peaks(x, fs)
        return [{"record_id": record_id, "beat_id": k, "r_sample": int(r), "width_ms": w, "wide": wide, "cluster": g} for k, (r, (w, wide, g)) in enumerate(zip(r_at.tolist(), B.group_beats(x, leads, r_at, fs, outliers), strict=True))]

    rows = per_record(records(signals), kernel, "record_id long, beat_id long, r_sample long, width_ms double, wide boolean, cluster long")
    if paced is None:
        rows = rows.withColumn("paced", F.lit(False))
    else:
        rows = rows.join(paced.select("record_id", "beat_id", F.lit(True).alias("paced")).distinct(), ["record_id", "beat_id"], "left").fillna(False, ["paced"])
    key = F.when(F.col("paced"), F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("k"))).otherwise(F.struct(F.col("wide").cast("int").alias("kind"), F.col("cluster").alias("k")))
    sized = rows.withColumn("key", key).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("record_id", "key")))
    group = F.dense_rank().over(Window.partitionBy("record_id").orderBy(F.desc("n"), "key"))
    return sized.select("record_id", "beat_id", "r_sample", "width_ms", "wide", "paced", group.cast("long").alias("group_id"))


def families(windows: DataFrame, reach: int = 5, threshold: float = 0.88) -> DataFrame:
    """record_id, beat_id, family (from 1), rr_context of windows (record_id, beat_id, samples, rr_prev, paced) that join families in beat order.

    RR contexts are against the record's median of positive intervals. Windows stream
    through a task sorted by record; it holds one record's running means.
    """
    usual = windows.groupBy("record_id").agg(median(F.when((F.col("rr_prev") > 0) & (F.col("rr_prev") < float("inf")), F.col("rr_prev"))).alias("usual"))
    rows = windows.join(usual, "record_id", "left").select(F.col("record_id").cast("long").alias("record_id"), F.col("beat_id").cast("long").alias("beat_id"), F.col("samples").cast("array<double>").alias("samples"), F.col("rr_prev").cast("double").alias("rr_prev"), F.coalesce("paced", F.lit(False)).alias("paced"), "usual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, held = None, None
        for batch in batches:
            ids, contexts = [], []
            for r, w, rr, paced, usual in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if held is None or r != record:
                    record, held = r, B.Families(threshold, reach)
                contexts.append(B.rr_context(rr, usual))
                ids.append(held.join(np.array([w], float), paced, contexts[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(contexts, pa.string())], names=["record_id", "beat_id", "family", "rr_context"])

    return spread(rows, "record_id").sortWithinPartitions("record_id", "beat_id").mapInArrow(run, "record_id long, beat_id long, family long, rr_context string")


def representatives(windows: DataFrame, reach: int = 8, least: float = 0.70) -> DataFrame:
    """record_id, family, n, n_used, samples: the median window of each family (record_id, family, beat_id, samples) after alignment to its first; a family's windows are a record's."""
    rows = windows.groupBy("record_id", "family").agg(F.array_sort(F.collect_list(F.struct("beat_id", "samples"))).alias("x")).select("record_id", "family", F.transform("x", lambda w: w["samples"].cast("array<double>")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, used, made = [], [], []
            for windows in batch.column(2).to_pylist():
                m, k = B.representative(np.array(windows, float)[:, None, :], reach, least)
                n.append(len(windows))
                used.append(k)
                made.append(m[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(used, pa.int64()), pa.array(made, pa.list_(pa.float64()))], names=["record_id", "family", "n", "n_used", "samples"])

    return rows.mapInArrow(run, "record_id long, family long, n long, n_used long, samples array<double>")


# ---------------------------------------------------------------- repolarization and delays


def wavelet_t_bounds(signals: DataFrame, low_mv: float = 0.10) -> DataFrame:
    """record_id, beat_id, lead, t_peak, t_on, t_off (wavelet detail), t_on_ramp (change point) of each beat that detection finds; null where nothing stands out."""

    def kernel(record_id, fs, leads, x):
        r_at, out = dsp.qrs_peaks(x, fs), []
        for lead, row in zip(leads, x, strict=True):
            size, y = np.abs(X.detail(row, fs)), dsp.lowpass(row, fs, min(40.0, 0.45 * fs))
            for k, r in enumerate(r_at.tolist()):
                rr = int(r_at[k + 1] - r) if k + 1 < r_at.size else int(np.median(np.diff(r_at))) if r_at.size > 1 else round(0.8 * fs)
                lo, hi = r + round(0.12 * fs), min(x.shape[1] - 1, r + rr - max(round(0.15 * fs), round(0.28 * rr)))
                if hi - lo < 0.06 * fs:
                    continue
                seg = y[lo:hi] - np.median(y[lo:hi])
                peak = lo + int(np.abs(seg).argmax())
                b = X.wavelet_bounds(size, fs, peak, lo, hi, low=bool(abs(seg[peak - lo]) < low_mv))
                ramp = X.change_point(y[lo : peak + 1], fs)
                out.append({"record_id": record_id, "beat_id": k, "lead": lead, "t_peak": peak, "t_on": b and b[0], "t_off": b and b[1], "t_on_ramp": None if ramp is None else lo + ramp})
        return out

    return per_record(records(signals), kernel, "record_id long, beat_id long, lead string, t_peak long, t_on long, t_off long, t_on_ramp long")


def lead_delays(signals: DataFrame) -> DataFrame:
    """record_id, lead, beats, delay (samples behind the record's median envelope), spread_ms, raw_corr, corr, correctable of every lead."""

    def kernel(record_id, fs, leads, x):
        env = np.stack([B.envelope(row, fs) for row in x])
        env = env / np.maximum(env.max(axis=1, keepdims=True), 1e-12)
        reference, r_at = np.median(env, axis=0), dsp.qrs_peaks(x, fs)
        return [{"record_id": record_id, "lead": lead, **B.lead_delay(e, reference, r_at, fs)} for lead, e in zip(leads, env, strict=True)]

    return per_record(records(signals), kernel, "record_id long, lead string, beats long, delay double, spread_ms double, raw_corr double, corr double, correctable boolean")


def without_delays(signals: DataFrame, delays: DataFrame) -> DataFrame:
    """signals moved back by their correctable delays, by linear interpolation on the arrays; ends repeat. delays has a row a record and lead."""
    x = signals.join(delays.where("correctable").select("record_id", "lead", F.col("delay").alias("by")), ["record_id", "lead"], "left")
    n = F.size("samples")

    def value(k: Column) -> Column:
        at = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), k + F.col("by")))
        i = F.floor(at).cast("int")
        a, b = F.get("samples", i), F.get("samples", F.least(i + 1, n - 1))
        return a + (b - a) * (at - i)

    return x.withColumn("samples", F.when(F.col("by").isNull(), F.col("samples")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), value))).drop("by")

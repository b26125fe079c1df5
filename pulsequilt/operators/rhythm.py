"""Rhythm: interval statistics, pauses, conduction, pacing and atrial events over beats.

Tables hold record_id, beat_id and intervals in ms; every operator groups or
windows by record only, so one shuffle by record serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import median, reasons

# Fixed values of the rhythm rules.
WIDE_QRS_MS = 120.0
PAUSE_RATIO, MOBITZ_INCREMENT_MS, MOBITZ_SPREAD_MS = 1.4, 10.0, 20.0
CAPTURE_MS, PR_CONDUCTED_MS, RETROGRADE_MS = 160.0, (60.0, 280.0), (0.0, 240.0)
ORGANIZED_PR_MS, ORGANIZED_RADIUS_MS, ATRIAL_CONFIDENCE = (80.0, 320.0), 30.0, 0.30
AF_CV, AF_NEAR_CV, P_GATE, P_BAND, PR_SCATTER_MS, FLUTTER_CONFIDENCE = 0.12, 0.09, 0.60, (0.45, 0.75), 20.0, 0.60


def by_record() -> WindowSpec:
    return Window.partitionBy("record_id")


def in_time() -> WindowSpec:
    return by_record().orderBy("beat_id")


def intervals(beats: DataFrame) -> DataFrame:
    """Beats that have an interval before them (rr), with the difference to the interval before that one."""
    return beats.where("rr_prev is not null").withColumn("rr", F.col("rr_prev")).withColumn("diff", F.col("rr") - F.lag("rr").over(in_time()))


def heart_rate(beats: DataFrame) -> DataFrame:
    return beats.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"), median("rr_prev").alias("median_rr_ms")).withColumn("heart_rate_bpm", 60000.0 / F.col("median_rr_ms"))


def time_domain(beats: DataFrame) -> DataFrame:
    """Sample sd, population cv, RMSSD, share of differences over 50 ms, and the Poincaré axes; null where a record has too few intervals."""
    x = intervals(beats).groupBy("record_id").agg(
        F.count("rr").alias("n_rr"), F.stddev_samp("rr").alias("rr_sd_ms"), (F.stddev_pop("rr") / F.avg("rr")).alias("cv"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmssd_ms"),
        F.avg(F.when(F.abs("diff") > 50.0, 1.0).otherwise(F.when(F.col("diff").isNotNull(), 0.0))).alias("pnn50"), (F.stddev_samp("diff") / F.sqrt(F.lit(2.0))).alias("sd1_ms"), F.var_samp("rr").alias("var"),
    )
    sd2 = F.when(F.col("n_rr") > 2, F.sqrt(F.greatest(F.lit(0.0), 2.0 * F.col("var") - F.col("sd1_ms") * F.col("sd1_ms"))))
    return x.select("record_id", "n_rr", "rr_sd_ms", F.when(F.col("n_rr") > 1, F.col("cv")).alias("rr_cv"), "rmssd_ms", "pnn50", "sd1_ms", sd2.alias("sd2_ms"))


def interval_entropy(beats: DataFrame, width: float = 20.0) -> DataFrame:
    """Entropy in bits of the histogram of intervals; records with under three have none."""
    counts = intervals(beats).groupBy("record_id", F.floor(F.col("rr") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(by_record())
    return counts.withColumn("p", p).groupBy("record_id").agg(F.sum("n").alias("n_rr"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy")).select("record_id", "n_rr", F.when(F.col("n_rr") >= 3, F.col("entropy")).alias("rr_entropy_bits"))


def with_median(beats: DataFrame) -> DataFrame:
    return beats.withColumn("median_rr", median("rr_prev").over(by_record()))


def interval_context(beats: DataFrame) -> DataFrame:
    """short_rr, regular_rr or long_rr: the interval before a beat against the record's median."""
    ratio = F.col("rr_prev") / F.col("median_rr")
    return with_median(beats).withColumn("context", F.when(F.col("rr_prev").isNull() | (F.col("rr_prev") <= 0) | (F.col("median_rr") <= 0), "unknown").when(ratio < 0.75, "short_rr").when(ratio > 1.25, "long_rr").otherwise("regular_rr"))


def robust_profile(beats: DataFrame) -> DataFrame:
    """Median, scaled MAD over median, and greatest relative deviation of the intervals; records with two at least."""
    dev = F.abs(F.col("rr") - F.col("median_rr"))
    x = with_median(intervals(beats)).where("rr > 0").withColumn("dev", dev)
    return x.groupBy("record_id").agg(F.count("rr").alias("n_rr"), F.first("median_rr").alias("median_rr_ms"), median("dev").alias("mad"), F.max("dev").alias("far")).where("n_rr >= 2").select("record_id", "median_rr_ms", (1.4826 * F.col("mad") / F.col("median_rr_ms")).alias("robust_rr_cv"), (F.col("far") / F.col("median_rr_ms")).alias("max_relative_rr_deviation"))


def pauses(beats: DataFrame) -> DataFrame:
    """Whether a record (of three intervals at least) has one over 1.4 medians."""
    x = beats.where("rr_prev > 0").groupBy("record_id").agg(F.count("rr_prev").alias("n_rr"), median("rr_prev").alias("baseline_rr_ms"), F.max("rr_prev").alias("longest_pause_ms"))
    return x.withColumn("pauses_detected", (F.col("n_rr") >= 3) & (F.col("longest_pause_ms") > F.col("baseline_rr_ms") * PAUSE_RATIO))


def second_degree_type(drops: DataFrame) -> DataFrame:
    """mobitz_i, mobitz_ii or second_degree_av_block of dropped beats by the PR intervals around them: before2, before1, after1, after2 (null where there is none)."""
    step = F.col("before1") - F.col("before2")
    around = F.array_compact(F.array("before2", "before1", "after1", "after2"))
    spread = F.array_max(around) - F.array_min(around)
    n_before = F.size(F.array_compact(F.array("before2", "before1")))
    n_after = F.size(F.array_compact(F.array("after1", "after2")))
    constant = ((n_before + n_after) >= 2) & (((n_before >= 1) & (n_after >= 1)) | (n_before >= 2)) & (spread <= MOBITZ_SPREAD_MS)
    return drops.withColumn("av_block", F.when((n_before >= 2) & (step >= MOBITZ_INCREMENT_MS), "mobitz_i").when(constant, "mobitz_ii").otherwise("second_degree_av_block"))


def av_flags(pr: DataFrame, rates: DataFrame) -> DataFrame:
    """Dissociation and complete block from PR per beat and lead (record_id, beat_id, pr_ms) and rates (record_id, heart_rate_bpm, atrial_rate_bpm)."""
    per_beat = pr.where((F.col("pr_ms") > 60) & (F.col("pr_ms") < 600)).groupBy("record_id", "beat_id").agg(median("pr_ms").alias("pr"))
    x = per_beat.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), (F.max("pr") - F.min("pr")).alias("range"), F.stddev_pop("pr").alias("sd"))
    x = rates.join(x, "record_id", "left")
    apart = F.coalesce((F.col("n") >= 3) & (F.col("range") > 80.0) & (F.col("sd") > 30.0), F.lit(False))
    faster = F.coalesce(F.col("atrial_rate_bpm") > F.col("heart_rate_bpm") + 5.0, F.lit(False))
    return x.select("record_id", apart.alias("av_dissociation"), faster.alias("atrial_faster_than_ventricular"), F.coalesce((F.col("heart_rate_bpm") < 45.0) & (apart | faster), F.lit(False)).alias("complete_av_block"))


def escape_or_interpolated(beats: DataFrame) -> DataFrame:
    """A row for each beat that looks like an escape (long interval before) or interpolated (both intervals fit into one)."""
    bg = F.col("median_rr")
    kinds = F.array_compact(F.array(F.when(F.col("rr_prev") > PAUSE_RATIO * bg, "escape_candidate"), F.when(F.abs(F.col("rr_prev") + F.col("rr_next") - bg) <= 0.15 * bg, "interpolated_candidate")))
    return with_median(beats).where(bg > 0).select("record_id", "beat_id", F.explode(kinds).alias("type"))


def pacing_context(beats: DataFrame, spikes: DataFrame) -> DataFrame:
    """Share of paced beats and what it means for a record; beats (record_id, paced, qrs_ms), spikes (record_id)."""
    x = beats.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("paced").alias("n_paced"), F.coalesce(F.bool_or(F.col("paced") & (F.coalesce("qrs_ms", F.lit(0.0)) >= 120.0)), F.lit(False)).alias("wide"))
    s = spikes.groupBy("record_id").agg(F.count(F.lit(1)).alias("spike_count"))
    x = x.join(s, "record_id", "left").withColumn("spike_count", F.coalesce("spike_count", F.lit(0)))
    every = F.col("n_paced") == F.col("n")
    return x.select("record_id", ((F.col("spike_count") > 0) | (F.col("n_paced") > 0)).alias("enabled"), "spike_count", (F.col("n_paced") / F.col("n")).alias("paced_fraction"), every.alias("continuous_pacing"), ((F.col("n_paced") > 0) & ~every).alias("intermittent_pacing"), F.col("wide").alias("ventricular_pacing_present"), (every & F.col("wide")).alias("suppress_rhythm"))


#: Microseconds of a millisecond of record time.
PER_MS = 30_000_000


def _bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width))


def within(left: DataFrame, right: DataFrame, low: float, high: float, how: str) -> DataFrame:
    """Rows of left (record_id, us) with (left_semi) or without (left_anti) a row of right (record_id, at) low to high ms after them. Joined by record and stretch of time, so a long record is no single task's work."""
    width = int(PER_MS * max(high - low, 1.0))
    early, late = F.col("at") - F.lit(int(PER_MS * high)), F.col("at") - F.lit(int(PER_MS * low))
    r = right.select(F.col("record_id").alias("_record"), "at", F.explode(F.sequence(_bucket(early, width), _bucket(late, width))).alias("_bucket"))
    dt = (F.col("at") - F.col("us")) / F.lit(3e7)
    return left.join(r, (F.col("record_id") == F.col("_record")) & (_bucket(F.col("us"), width) == F.col("_bucket")) & dt.between(low, high), how)


def pacing_failures(spikes: DataFrame, qrs: DataFrame) -> DataFrame:
    """Spikes without a QRS complex in the capture window after them, and whether that makes failure likely, by record."""
    missed = within(spikes, qrs, 0.0, CAPTURE_MS, "left_anti").groupBy("record_id").agg(F.count(F.lit(1)).alias("missed"))
    x = spikes.groupBy("record_id").agg(F.count(F.lit(1)).alias("spike_count")).join(missed, "record_id", "left").withColumn("capture_failure_count", F.coalesce("missed", F.lit(0)))
    share = F.col("capture_failure_count") / F.col("spike_count")
    likely = (F.col("spike_count") >= 3) & (F.col("spike_count") > F.col("capture_failure_count")) & (F.col("capture_failure_count") >= 2) & (share <= 0.5)
    return x.select("record_id", "spike_count", "capture_failure_count", share.alias("capture_failure_fraction"), likely.alias("capture_failure_suspected"))


def events_per_interval(atrial: DataFrame, qrs: DataFrame) -> DataFrame:
    """Atrial events (record_id, us) in each half-open interval from a QRS complex (record_id, at, beat_id) to the next. Order alone decides: each event belongs to the last complex at or before it."""
    both = qrs.select("record_id", F.col("at").alias("us"), F.lit(0).alias("atrial"), "beat_id").unionByName(atrial.select("record_id", "us", F.lit(1).alias("atrial"), F.lit(None).cast("long").alias("beat_id")))
    owner = F.last("beat_id", ignorenulls=True).over(by_record().orderBy("us", "atrial", "beat_id"))
    final = F.max(F.when(F.col("atrial") == 0, F.struct("us", "beat_id"))).over(by_record())["beat_id"]
    x = both.select("record_id", owner.alias("owner"), final.alias("final"), "atrial").where("owner <> final")
    return x.groupBy("record_id", F.col("owner").alias("beat_id")).agg(F.sum("atrial").alias("atrial_events"))


def associate(atrial: DataFrame, qrs: DataFrame, t_waves: DataFrame | None = None) -> DataFrame:
    """Each atrial event (record_id, mark, us, conf) with the nearest QRS complex it can belong to.

    Events within a T wave (record_id, start, stop) are artifacts; others are
    conducted (60 to 280 ms before an onset) or retrograde (up to 240 ms after
    an offset), whichever is nearer, then conducted first, then the earlier
    beat; else blocked. qrs: record_id, beat_id, onset, offset.
    """
    width = 600 * PER_MS
    # every stretch of time from which an event can reach the complex, however wide it is
    first, last = F.col("onset") - PR_CONDUCTED_MS[1] * PER_MS, F.greatest("onset", "offset") + RETROGRADE_MS[1] * PER_MS
    near = F.explode(F.sequence(_bucket(first, width), _bucket(last, width))).alias("_bucket")
    q = qrs.select(F.col("record_id").alias("_record"), F.col("beat_id").alias("qrs_beat_id"), "onset", "offset", near)
    before, after = (F.col("onset") - F.col("us")) / F.lit(3e7), (F.col("us") - F.col("offset")) / F.lit(3e7)
    ways = F.array_compact(F.array(
        F.when(before.between(*PR_CONDUCTED_MS), F.struct(before.alias("gap"), F.lit(0).alias("way"), "qrs_beat_id")),
        F.when(after.between(*RETROGRADE_MS), F.struct(after.alias("gap"), F.lit(1).alias("way"), "qrs_beat_id")),
    ))
    reach = (F.col("record_id") == F.col("_record")) & (_bucket(F.col("us"), width) == F.col("_bucket"))
    best = atrial.join(q, reach).select("record_id", "mark", F.array_min(ways).alias("x")).groupBy("record_id", "mark").agg(F.min("x").alias("best"))
    out = atrial.join(best, ["record_id", "mark"], "left")
    kind = F.when(F.col("best").isNull(), "blocked").when(F.col("best.way") == 0, "conducted").otherwise("retrograde")
    out = out.select("record_id", "mark", "us", "conf", F.col("best.qrs_beat_id").alias("qrs_beat_id"), kind.alias("association"), F.when(F.col("best.way") == 0, F.col("best.gap")).alias("pr_ms"))
    if t_waves is None:
        return out
    t = t_waves.select(F.col("record_id").alias("_record"), "start", "stop", F.explode(F.sequence(_bucket(F.col("start"), width), _bucket(F.col("stop"), width))).alias("_bucket"))
    inside = (F.col("record_id") == F.col("_record")) & (_bucket(F.col("us"), width) == F.col("_bucket")) & F.col("us").between(F.col("start"), F.col("stop"))
    artifact = atrial.join(t, inside, "left_semi").select("record_id", "mark", F.lit(True).alias("artifact"))
    out = out.join(artifact, ["record_id", "mark"], "left")
    clear = lambda c: F.when(F.col("artifact").isNull(), F.col(c)).alias(c)
    return out.select("record_id", "mark", "us", "conf", clear("qrs_beat_id"), F.coalesce(F.when(F.col("artifact"), "t_wave_artifact"), "association").alias("association"), clear("pr_ms"))


def conducted(events: DataFrame) -> DataFrame:
    return events.where((F.col("association") == "conducted") & (F.col("conf") >= ATRIAL_CONFIDENCE) & F.col("pr_ms").between(*ORGANIZED_PR_MS))


def organized_ratio(events: DataFrame, beats: DataFrame) -> DataFrame:
    """The largest share of a record's beats whose conducted events have PR intervals within 30 ms of one of them.

    A sweep over PR: each beat is open from 30 ms before to 30 ms after its
    events (stretches that meet are one), and the running number of open beats
    is read at each event. Linear in the events, whatever a record's length.
    """
    radius = int(ORGANIZED_RADIUS_MS * PER_MS)
    c = conducted(events).select("record_id", "qrs_beat_id", F.round(F.col("pr_ms") * PER_MS).cast("long").alias("pr"))
    in_beat = Window.partitionBy("record_id", "qrs_beat_id").orderBy("pr")
    gap = lambda x: F.coalesce(x > 2 * radius, F.lit(True))
    x = c.withColumns({"opens": gap(F.col("pr") - F.lag("pr").over(in_beat)), "shuts": gap(F.lead("pr").over(in_beat) - F.col("pr"))})
    point = lambda at, kind, step: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(step).alias("step"))
    points = x.select("record_id", F.explode(F.array_compact(F.array(F.when(F.col("opens"), point(F.col("pr") - radius, 0, 1)), point(F.col("pr"), 1, 0), F.when(F.col("shuts"), point(F.col("pr") + radius, 2, -1))))).alias("p")).select("record_id", "p.*")
    opened = points.withColumn("n", F.sum("step").over(by_record().orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    most = opened.where("kind = 1").groupBy("record_id").agg(F.max("n").alias("n"))
    total = beats.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"))
    return total.join(most, "record_id", "left").select("record_id", F.least(F.lit(1.0), F.coalesce(F.col("n") / F.col("n_beats"), F.lit(0.0))).alias("organized_p_ratio"))


def pr_scatter(events: DataFrame) -> DataFrame:
    """Scaled MAD of the beats' median PR; records with four such beats at least."""
    per_beat = conducted(events).groupBy("record_id", "qrs_beat_id").agg(median("pr_ms").alias("pr"))
    x = per_beat.withColumn("dev", F.abs(F.col("pr") - median("pr").over(by_record())))
    return x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"), (median("dev") * 1.4826).alias("pr_dispersion_ms")).where("n_beats >= 4")


def fibrillation(x: DataFrame) -> DataFrame:
    """af, flutter, indeterminate or none of one row a record: rr_cv, organized_p_ratio, pr_dispersion_ms, repetitiveness, flutter_consensus, flutter_confidence."""
    cv, ratio = F.col("rr_cv"), F.col("organized_p_ratio")
    decided = ratio.between(*P_BAND) & F.col("pr_dispersion_ms").isNotNull()
    absent = F.when(decided, F.col("pr_dispersion_ms") > PR_SCATTER_MS).otherwise(ratio <= P_GATE)
    flutter = F.coalesce(F.col("flutter_consensus") & (F.col("flutter_confidence") >= FLUTTER_CONFIDENCE), F.lit(False))
    why = reasons((F.coalesce((cv >= AF_NEAR_CV) & (cv < AF_CV) & absent & ~flutter, F.lit(False)), "mild_rr_irregularity_with_absent_organized_p"), (F.coalesce(F.col("flutter_consensus") & (F.col("flutter_confidence") >= 0.5) & (F.col("flutter_confidence") < FLUTTER_CONFIDENCE), F.lit(False)), "borderline_multilead_F_wave_pattern"))
    af = F.coalesce((cv >= AF_CV) & absent & (F.col("repetitiveness") < 0.55), F.lit(False))
    verdict = F.when(F.size("why") > 0, "indeterminate").when(F.col("strong_flutter"), "flutter").when(F.col("classic_af"), "af").otherwise("none")
    return x.withColumns({"absent_p": absent, "strong_flutter": flutter, "classic_af": af, "why": why}).withColumn("verdict", verdict)


def islands(rows: DataFrame, gap: Column, *by: str) -> DataFrame:
    """rows with cluster: numbered from zero along ``us`` and anew after each gap for which the condition holds."""
    w = Window.partitionBy(*by).orderBy("us", "mark")
    return rows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def longest_runs(beats: DataFrame, by: str = "kind") -> DataFrame:
    """The longest run of consecutive beats of each value of ``by`` in a record."""
    same = Window.partitionBy("record_id", by).orderBy("beat_id")
    runs = beats.withColumn("_run", F.col("beat_id") - F.row_number().over(same)).groupBy("record_id", by, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("record_id", by).agg(F.max("n").alias("longest_run"))


def av_block(series: DataFrame, facts: DataFrame) -> DataFrame:
    """Pauses and second-degree block of records as one decision; series: record_id, idx (from 0, no gaps), rr, pr, atrial (atrial events in the interval); facts: record_id, qrs_ms.

    A dropped P wave is an interval without PR, with several atrial events and over 1.4 median
    intervals long, where other intervals have one event or none. The first drop that tells
    Mobitz I or II decides; drops before it tell the general block, as does a long interval
    with several events but with a PR. Intervals that are not positive are left out before
    they are counted, so the k-th event count stands beside the k-th interval that is left.
    """
    w = by_record().orderBy("idx")
    rr = series.where((F.col("rr") > 0) & (F.col("rr") < float("inf"))).select("record_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("rr").alias("rr_at"))
    base = rr.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_rr"), median("rr_at").alias("baseline_rr_ms"), F.max("rr_at").alias("longest")).withColumn("threshold_ms", F.col("baseline_rr_ms") * PAUSE_RATIO)
    around = {f"{n}{k}": f("pr", k).over(w) for n, f in (("before", F.lag), ("after", F.lead)) for k in (1, 2)}
    x = series.select("record_id", F.col("idx").cast("long").alias("idx"), F.when(F.abs("pr") < float("inf"), F.col("pr")).alias("pr"), F.coalesce("atrial", F.lit(0)).alias("atrial"))
    x = second_degree_type(x.withColumns(around)).join(rr, ["record_id", "idx"], "left")
    counts = x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("atrial") > 1).alias("n_excess"), F.count_if(F.col("atrial") == 2).alias("n_two"), F.max("atrial").alias("atrial_max"))
    facts = counts.join(base, "record_id", "left").join(facts.select("record_id", F.when(F.abs("qrs_ms") < float("inf"), F.col("qrs_ms")).alias("qrs_ms")), "record_id", "left")
    local = (F.col("n_excess") > 0) & (F.col("n_excess") < F.col("n"))
    long = x.join(facts.where(local).select("record_id", "threshold_ms"), "record_id").where((F.col("atrial") > 1) & (F.col("rr_at") > F.col("threshold_ms")))
    first = long.groupBy("record_id").agg(
        F.min(F.when(F.col("pr").isNull() & F.col("av_block").startswith("mobitz"), F.struct("idx", "av_block"))).alias("mobitz"),
        F.array_sort(F.collect_list(F.when(F.col("pr").isNull(), F.col("idx")))).alias("drops"),
        F.min("idx").alias("any_long"),
    )
    x = facts.join(first, "record_id", "left")
    told = F.filter("drops", lambda i: F.col("mobitz").isNull() | (i <= F.col("mobitz.idx")))
    dropped = F.when(F.size(told) > 0, told).when(F.col("any_long").isNotNull(), F.array("any_long")).otherwise(F.array().cast("array<long>"))
    block = F.when(F.col("mobitz").isNotNull(), F.col("mobitz.av_block")).when(F.col("any_long").isNotNull(), "second_degree_av_block")
    paused = F.coalesce((F.col("n_rr") >= 3) & (F.col("longest") > F.col("threshold_ms")), F.lit(False))
    wide = F.coalesce(F.col("qrs_ms") >= WIDE_QRS_MS, F.lit(False))
    two = (F.col("n") >= 3) & (F.col("n_two") == F.col("n"))
    hint = (
        F.when(block == "mobitz_ii", F.when(wide, "infranodal_suspected").otherwise("infranodal_probable"))
        .when(block == "mobitz_i", F.when(F.col("qrs_ms") < WIDE_QRS_MS, "av_nodal_probable").otherwise("indeterminate"))
        .when(two, F.when(wide, "infranodal_suspected").otherwise("indeterminate"))
    )
    return x.select("record_id", paused.alias("pauses_detected"), F.when(paused, F.round("longest", 1)).alias("pause_longest_ms"), "baseline_rr_ms", "threshold_ms", block.alias("second_degree_avb"), dropped.alias("dropped"), two.alias("two_to_one"), hint.alias("block_level_hint"), F.when(paused, F.when(wide, "ventricular").otherwise("supraventricular")).alias("escape_origin"), "atrial_max")

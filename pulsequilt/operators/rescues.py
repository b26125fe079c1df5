"""Leads that QT may be taken from, and the rules that replace a QT consensus by a cluster of raw values.

``leads``: record_id, lead, lead_no, qt, qt_consensus, qt_sd, conf, t_amp (mV),
reliable_qt, reliable_global, reliable_t, confused. ``facts``: record_id, qrs_ms,
consensus_ms, rr_cv. Values out of range count as missing, a missing confidence
as zero, a missing flag as false.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import let, median, spread
from pulsequilt.operators.rhythm import by_record

#: Fixed values, in ms, mV and shares.
QT_RANGE, WIDE_QRS, WIDE_JT, IRREGULAR_CV = (240.0, 700.0), 120.0, (160.0, 550.0), 0.12
VISIBLE_T, QT_SD, QT_CONF, OUTLIER_MS, RESCUE_SD, RESCUE_CONF = 0.05, 25.0, 0.20, 80.0, 30.0, 0.10
WIDE_RAW_SPREAD, WIDE_RAW_DELTA = 40.0, 15.0
CONSENSUS_SPREAD, MOST_RELIABLE = 6.0, 6
TAIL_DELTA, TAIL_PAIR_MS, TAIL_SMALL_MS, TAIL_PRECORDIAL_MS, TAIL_PRECORDIAL_MV = 45.0, 480.0, 500.0, 450.0, 0.04
BEAT_RANGE, LEAST_BEATS = (240.0, 420.0), 4


def _valid(c: str) -> Column:
    return F.when(F.col(c).between(*QT_RANGE), F.col(c))


def _sure(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def is_wide() -> Column:
    return _sure(F.col("qrs_ms") >= WIDE_QRS)


def fits_width(qt: Column) -> Column:
    """Whether a QT leaves a plausible JT where QRS is wide; a missing one does not."""
    return qt.isNotNull() & (~is_wide() | _sure((qt - F.col("qrs_ms")).between(*WIDE_JT)))


def prepared(leads: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """leads beside their record's facts (without these, leads hold them), with raw (QT that fits), qt_value (consensus, else raw), and plain flags."""
    x = (leads if facts is None else leads.join(facts, "record_id", "left")).withColumns({"qt": _valid("qt"), "qt_consensus": _valid("qt_consensus"), "conf": F.coalesce("conf", F.lit(0.0)), "t": F.abs("t_amp")} | {f: _sure(f) for f in ("reliable_qt", "reliable_global", "reliable_t", "confused")})
    return x.withColumns({"qt_value": F.coalesce("qt_consensus", "qt"), "raw": F.when(fits_width(F.col("qt")), F.col("qt"))})


def _evidence() -> tuple[Column, Column]:
    """Of a lead by itself: its QT value if it is strict, its spread if it may serve where none is; else null."""
    seen = _sure(F.col("t") >= VISIBLE_T) & F.col("qt_value").isNotNull()
    strict = seen & F.col("reliable_qt") & _sure(F.col("qt_sd") <= QT_SD) & (F.col("conf") >= QT_CONF)
    weak = seen & _sure(F.col("qt_sd") <= RESCUE_SD) & (F.col("conf") >= RESCUE_CONF)
    return F.when(strict, F.col("qt_value")), F.when(weak, F.col("qt_sd"))


def with_reliable(x: DataFrame) -> DataFrame:
    """prepared() with ``good``: whether QT may be taken from a lead.

    Strict: reliable for QT, a visible T wave, small spread, enough confidence, a valid value; of three or
    more those within 80 ms of their median, if these are two at least. A record without any has its lead of
    least spread (ties by lead order) under weaker limits.
    """
    value, sd = _evidence()
    w = by_record()
    x = spread(x.withColumns({"strict_value": value, "weak_sd": sd}), "record_id")
    strict, weak = F.col("strict_value").isNotNull(), F.col("weak_sd").isNotNull()
    # the window with an order comes first: its sort serves the others
    x = x.withColumn("first", F.row_number().over(w.orderBy(F.col("weak_sd").asc_nulls_last(), "lead_no")))
    x = x.withColumns({"n_strict": F.count("strict_value").over(w), "center": F.percentile("strict_value", F.lit(0.5)).over(w)})
    x = x.withColumn("near", strict & (F.abs(F.col("strict_value") - F.col("center")) <= OUTLIER_MS))
    x = x.withColumn("n_near", F.count_if("near").over(w))
    kept = F.when(F.col("n_strict") == 0, weak & (F.col("first") == 1)).when((F.col("n_strict") >= 3) & (F.col("n_near") >= 2), F.col("near")).otherwise(strict)
    return x.withColumn("good", kept).drop("strict_value", "weak_sd", "n_strict", "center", "near", "first", "n_near")


def reliable_leads(x: DataFrame) -> DataFrame:
    """The rows of prepared() that QT may be taken from."""
    return with_reliable(x).where("good").drop("good")


@dataclass(frozen=True)
class Cluster:
    """A rule: the densest stretch of raw values, width ms long, of enough leads, that lies late (or early, by a negative delta) against the consensus.

    Denser stretches come first, then greater medians (unless ``by_span``), then smaller spans; at last the lower one.
    """

    name: str
    width: float
    support: int
    delta: float | None
    share: float = 0.0
    by_span: bool = False


LATE = Cluster("late_cluster", 35.0, 4, 20.0, 0.5)
TAIL = Cluster("tail_confirmed", 35.0, 2, None)
LOW_SUPPORT = Cluster("low_support_late", 35.0, 4, 35.0)
LATE_CORE = Cluster("late_core", 45.0, 3, 35.0)
WIDE_LONG = Cluster("wide_long_core", 45.0, 4, -25.0)
RELIABLE = Cluster("reliable_cluster", 25.0, 2, -10.0, 0.6)
PACED = Cluster("paced_low_support", 90.0, 3, None, by_span=True)


def _narrow_regular() -> Column:
    return F.col("consensus_ms").isNotNull() & ~is_wide() & ~_sure(F.col("rr_cv") >= IRREGULAR_CV)


def _speaks() -> dict[str, Column]:
    """By rule, whether a lead may speak for it as far as the lead itself tells (for late_cluster it must be good, too)."""
    visible, known, conf = _sure(F.col("t") >= VISIBLE_T), F.col("consensus_ms").isNotNull(), F.col("conf")
    speaks = {
        LATE: _narrow_regular() & ~F.col("confused") & visible & (conf >= 0.45),
        TAIL: _narrow_regular() & F.col("reliable_t") & _sure(F.col("t") >= 0.02) & (conf >= 0.25) & _sure(F.col("raw") - F.col("consensus_ms") >= 40.0),
        LOW_SUPPORT: _narrow_regular() & F.col("reliable_global") & F.col("reliable_qt") & ~F.col("confused") & visible & (conf >= 0.10),
        LATE_CORE: _narrow_regular() & F.col("reliable_global") & _sure(F.col("t") >= 0.015) & (conf >= 0.20),
        WIDE_LONG: known & is_wide() & (F.col("consensus_ms") >= 500.0) & F.col("reliable_qt") & ~F.col("confused") & _sure(F.col("t") >= 0.03) & (conf >= 0.25),
        PACED: is_wide() & F.col("reliable_qt") & F.col("reliable_global") & _sure(F.col("t") >= 0.03) & (conf >= 0.0),
    }
    return {r.name: F.col("raw").isNotNull() & when for r, when in speaks.items()}


def _rules() -> Column:
    """The rules that a lead speaks for, each with its limits."""
    known, wide, good = F.col("consensus_ms").isNotNull(), F.col("wide"), F.col("good") & F.col("raw").isNotNull()
    least = F.when(wide, 2).otherwise(3)
    agreed = known & F.col("n_good").between(least, MOST_RELIABLE) & (F.col("n_consensus") >= least) & (F.col("apart") <= CONSENSUS_SPREAD)
    speaks = [(LATE, good & F.col(LATE.name)), *((r, F.col(r.name)) for r in (TAIL, LOW_SUPPORT, LATE_CORE, WIDE_LONG, PACED)), (RELIABLE, good & _sure(agreed))]
    limits = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.width).alias("width"), (least if r is RELIABLE else F.lit(r.support)).alias("least"), F.lit(r.share).alias("share"), F.lit(r.delta).cast("double").alias("delta"), F.lit(r.by_span).alias("by_span"))
    raw = F.struct(F.lit("wide_raw").alias("rule"), F.lit(0.0).alias("width"), F.lit(2).alias("least"), F.lit(0.0).alias("share"), F.lit(None).cast("double").alias("delta"), F.lit(False).alias("by_span"))
    return F.array_compact(F.array(*(F.when(when, limits(r)) for r, when in speaks), F.when(good & known & wide, raw)))


def _middle(values: Column) -> Column:
    """The median of a sorted array of leads' raw values."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int"))["raw"] + F.get(values, F.floor(n / 2).cast("int"))["raw"]) / 2


def qt_rescues(leads: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """record_id, rule, qt_ms, n_leads, leads (in standard order): what each rule would put in the consensus's place.

    What a lead tells by itself is worked out where it lies. Leads are then dealt by record once,
    with what is told of them instead of what tells it, and with little but their record where they
    can neither be reliable nor speak for a rule. Windows find the reliable ones, each lead goes to
    the rules that it speaks for, and the (at most some sixteen) leads of a record and rule are held
    together to find the stretch. Two rules have more to say: wide_raw takes all its leads if
    they lie within 40 ms and 15 ms late; tail_confirmed must not be too late where it has few
    leads, nor too small in the chest.
    """
    w = by_record()
    value, sd = _evidence()
    evident, speaks = value.isNotNull() | sd.isNotNull(), _speaks()
    faint = F.coalesce(F.col("t") < TAIL_PRECORDIAL_MV, F.lit(True))
    x = prepared(leads, facts).withColumns(speaks | {"wide": is_wide(), "faint": faint, "agreeing": F.when(evident, F.col("qt_consensus"))})
    # as nulls: a filter would repeat all of these conditions in code too long to be compiled
    heard = evident | reduce(or_, map(F.col, speaks))
    x = with_reliable(x.withColumns({c: F.when(heard, F.col(c)) for c in ("lead", "lead_no", "raw", "consensus_ms")}))
    good = F.col("good")
    x = x.withColumns({"n_good": F.count_if(good).over(w), "n_consensus": F.count(F.when(good, F.col("agreeing"))).over(w), "apart": F.max(F.when(good, F.col("agreeing"))).over(w) - F.min(F.when(good, F.col("agreeing"))).over(w)})
    told = x.select("record_id", "consensus_ms", "lead", "lead_no", "raw", "faint", F.explode(_rules()).alias("r"))
    g = told.groupBy("record_id", "r.rule").agg(F.first("r").alias("r"), F.first("consensus_ms").alias("consensus_ms"), F.array_sort(F.collect_list(F.struct("raw", "lead_no", "lead", "faint"))).alias("all"))
    within = lambda start: F.filter("all", lambda v: v["raw"].between(start, start + F.col("r.width")))
    total = F.size("all")
    enough = F.greatest(F.col("r.least").cast("double"), F.ceil(F.col("r.share") * total).cast("double"))

    def measured(v: Column) -> Column:
        def of(m: Column) -> Column:
            mid, n = _middle(m), F.size(m)
            away = mid - F.col("consensus_ms")
            far = F.when(F.col("r.delta").isNull(), True).when(F.col("r.delta") > 0, away >= F.col("r.delta")).otherwise(-away >= -F.col("r.delta"))
            span = F.element_at(m, -1)["raw"] - v["raw"]
            return F.when((n >= enough) & far, F.struct(n.alias("n"), F.when(F.col("r.by_span"), 0.0).otherwise(mid).alias("mid"), (-span).alias("tight"), (-v["raw"]).alias("low")))

        return let(within(v["raw"]), of)

    best = F.array_max(F.array_compact(F.transform("all", measured)))
    spread = F.element_at("all", -1)["raw"] - F.element_at("all", 1)["raw"]
    late = _middle(F.col("all")) - F.col("consensus_ms")
    everyone = (total >= 2) & (spread <= WIDE_RAW_SPREAD) & (late >= WIDE_RAW_DELTA)
    best = F.when(total >= F.col("r.least"), best)
    x = g.withColumn("members", F.when(F.col("rule") == "wide_raw", F.when(everyone, F.col("all"))).otherwise(let(best, lambda b: F.when(b.isNotNull(), within(-b["low"])))))
    x = x.where("members is not null").withColumns({"qt_ms": _middle(F.col("members")), "n_leads": F.size("members").cast("long")})
    small, mid = F.col("n_leads") < 4, F.col("qt_ms")
    weak = small & (mid >= TAIL_PRECORDIAL_MS) & F.forall("members", lambda v: v["lead"].startswith("V")) & F.exists("members", lambda v: v["faint"])
    early = F.element_at("members", -1)["raw"] - F.col("consensus_ms") < TAIL_DELTA
    wrong = (F.col("rule") == TAIL.name) & (early | small & (mid > TAIL_SMALL_MS) | (F.col("n_leads") == TAIL.support) & (mid > TAIL_PAIR_MS) | weak)
    named = F.transform(F.array_sort(F.transform("members", lambda v: F.struct(v["lead_no"], v["lead"]))), lambda v: v["lead"])
    return x.where(~wrong).select("record_id", "rule", "qt_ms", "n_leads", named.alias("leads"))


def irregular_raw_core(beat_qt: DataFrame, facts: DataFrame) -> DataFrame:
    """record_id, n_beats, core_qt_ms of irregular records: the median of beats' median QT (record_id, beat_id, qt) in 240 to 420 ms, of four beats at least."""
    irregular = facts.where(F.col("rr_cv") >= IRREGULAR_CV).select("record_id")
    b = beat_qt.where(F.col("qt").between(*QT_RANGE)).join(irregular, "record_id", "left_semi").groupBy("record_id", "beat_id").agg(median("qt").alias("qt")).where(F.col("qt").between(*BEAT_RANGE))
    return b.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"), median("qt").alias("core_qt_ms")).where(F.col("n_beats") >= LEAST_BEATS)

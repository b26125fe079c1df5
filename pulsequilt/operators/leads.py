"""Record-level values from lead values: fallbacks, outlier rules, evidence and availability policies."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import ANGLES, circular_delta, median, reasons
from pulsequilt.operators.intervals import frontal_axis
from pulsequilt.operators.rhythm import by_record


def age_years(years: Column, days: Column) -> Column:
    """Age in years: from days if they are given (an invalid value gives none, not the years), else years."""
    return F.when(days.isNotNull(), F.when(days >= 0, days / 365.25)).otherwise(F.when(years >= 0, years))


def global_pr(leads: DataFrame) -> DataFrame:
    """Median PR of reliable limb leads where there are three, else of all leads with three, else any. leads: record_id, limb, reliable, pr."""
    limb = F.when(F.col("limb") & F.col("reliable"), F.col("pr"))
    x = leads.groupBy("record_id").agg(F.count(limb).alias("n_limb"), median(limb).alias("limb_pr"), F.count("pr").alias("n_all"), median("pr").alias("all_pr"))
    source = F.when(F.col("n_limb") >= 3, "limb_leads").when(F.col("n_all") >= 3, "all_leads").when(F.col("n_all") > 0, "low_support")
    return x.select("record_id", F.when(F.col("n_limb") >= 3, F.col("limb_pr")).otherwise(F.col("all_pr")).alias("pr_ms"), source.alias("source"))


def split_core(leads: DataFrame) -> DataFrame:
    """Width where limb and precordial leads disagree: max(120, min(P60 of all, precordial median)). leads: record_id, limb, qrs."""
    part = lambda limb: median(F.when(F.col("limb") == limb, F.col("qrs")))
    x = leads.groupBy("record_id").agg(part(True).alias("limb_mid"), part(False).alias("chest_mid"), F.percentile("qrs", F.lit(0.6)).alias("p60"), median("qrs").alias("mid"))
    split = F.coalesce(F.abs(F.col("limb_mid") - F.col("chest_mid")) >= 20, F.lit(False))
    return x.select("record_id", split.alias("split"), F.when(split, F.greatest(F.lit(120.0), F.least("p60", "chest_mid"))).otherwise(F.col("mid")).alias("qrs_ms"))


def pr_core(values: DataFrame, gap: float = 30.0) -> DataFrame:
    """The upper side of the widest gap (of at least ``gap``) in a record's PR values, as its median; all values where there is none."""
    w = by_record().orderBy("pr")
    x = values.withColumn("step", F.col("pr") - F.lag("pr").over(w))
    widest = x.groupBy("record_id").agg(F.max(F.struct("step", "pr")).alias("b"))
    y = values.join(widest, "record_id").where((F.coalesce(F.col("b.step"), F.lit(0.0)) < gap) | (F.col("pr") >= F.col("b.pr")))
    return y.groupBy("record_id").agg(median("pr").alias("pr_ms"), F.count(F.lit(1)).alias("n"))


def axis_fit(values: DataFrame) -> DataFrame:
    """Residual of limb values against the projection of their own axis, relative to their size (0 fits)."""
    angle = F.create_map(*(F.lit(v) for kv in ANGLES.items() for v in kv))[F.col("lead")]
    x = values.join(frontal_axis(values).select("record_id", "axis_deg"), "record_id")
    x = x.withColumn("cos", F.cos(F.radians(F.col("axis_deg") - angle)))
    s = x.groupBy("record_id").agg(F.sum(F.col("value") * F.col("cos")).alias("vc"), F.sum(F.col("cos") * F.col("cos")).alias("cc"), F.sum(F.col("value") * F.col("value")).alias("vv"), F.max("axis_deg").alias("axis_deg"))
    rest = F.col("vv") - F.col("vc") * F.col("vc") / F.col("cc")
    return s.select("record_id", "axis_deg", F.sqrt(F.greatest(F.lit(0.0), rest) / F.greatest("vv", F.lit(1e-12))).alias("fit_score"))


def without_one(values: DataFrame) -> DataFrame:
    """The axis of each record with each of its leads left out: record_id, removed, axis_deg, and how far it turns."""
    removed = values.select(F.col("record_id").alias("_r"), F.col("lead").alias("removed"))
    x = values.join(removed, (F.col("record_id") == F.col("_r")) & (F.col("lead") != F.col("removed")))
    x = x.withColumn("record_id", F.struct("record_id", "removed")).select("record_id", "lead", "value", "conf")
    out = frontal_axis(x).select("record_id.record_id", "record_id.removed", "axis_deg")
    return out.join(frontal_axis(values).select("record_id", F.col("axis_deg").alias("whole")), "record_id").select("record_id", "removed", "axis_deg", circular_delta(F.col("axis_deg"), F.col("whole")).alias("turn_deg"))


def signed_area(area: Column, signed: Column, amp: Column, usable: Column, least_amp: float = 0.02) -> Column:
    """The signed area if there is one, else the area with the amplitude's sign; null unless usable and high enough."""
    return F.when(usable & (F.abs(amp) >= least_amp), F.coalesce(signed, area * F.signum(amp)))


#: Fixed values of the core of beats' PR: range in ms, confidence, beats for percentiles, gap in ms and in typical gaps, beats on its sides, percentiles of all and of the lower side.
PR_RANGE, PR_CONF, PR_BEATS, PR_GAP, PR_GAP_RATIO, PR_SIDES, PR_ALL, PR_LOWER = (120.0, 220.0), 0.5, 5, 18.0, 2.0, (3, 2), 0.78, 0.75


def pr_beat_core(values: DataFrame) -> DataFrame:
    """record_id, n_beats, split, pr_ms of leads' PR intervals (record_id, beat_id, pr, conf, unreliable): beats' medians of sure and plausible ones.

    Of two to four beats the median, of five or more the 78th percentile, but where the (first) widest
    gap parts three or more from two or more beats, 18 ms and two typical gaps wide, the 75th of the lower
    side. A single beat tells nothing. Missing confidences are 0, missing flags false.
    """
    sure = F.col("pr").between(*PR_RANGE) & (F.coalesce("conf", F.lit(0.0)) >= PR_CONF) & ~F.isnan(F.coalesce("conf", F.lit(0.0))) & ~F.coalesce("unreliable", F.lit(False))
    b = values.where(sure).groupBy("record_id", "beat_id").agg(median("pr").alias("pr"))
    w = by_record().orderBy("pr", "beat_id")
    b = b.withColumns({"k": F.row_number().over(w), "gap": F.col("pr") - F.lag("pr").over(w)})
    g = b.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_beats"), F.max(F.struct("gap", (-F.col("k")).alias("first"))).alias("widest"), median("gap").alias("usual"))
    lower = -F.col("widest.first") - 1
    split = (F.col("n_beats") >= PR_BEATS) & (F.col("widest.gap") >= F.greatest(F.lit(PR_GAP), PR_GAP_RATIO * F.col("usual"))) & (lower >= PR_SIDES[0]) & (F.col("n_beats") - lower >= PR_SIDES[1])
    x = b.join(g.withColumns({"split": split, "n_lower": lower}), "record_id").where("n_beats >= 2")
    below = F.when(F.col("k") <= F.col("n_lower"), F.col("pr"))
    out = x.groupBy("record_id", "n_beats", "split").agg(F.percentile(below, F.lit(PR_LOWER)).alias("low"), F.percentile("pr", F.lit(PR_ALL)).alias("high"), median("pr").alias("mid"))
    return out.select("record_id", "n_beats", "split", F.when(F.col("n_beats") < PR_BEATS, F.col("mid")).when(F.col("split"), F.col("low")).otherwise(F.col("high")).alias("pr_ms"))


def descents(values: DataFrame, slack: float = 0.0) -> DataFrame:
    """How often a value falls by more than ``slack`` from one chest lead to the next up to the record's highest, and where that is. values: record_id, idx, value."""
    top = values.groupBy("record_id").agg(F.max(F.struct("value", (-F.col("idx")).alias("first"))).alias("b"))
    x = values.withColumn("last", F.lag("value").over(by_record().orderBy("idx"))).join(top, "record_id").where(F.col("idx") <= -F.col("b.first"))
    return x.groupBy("record_id").agg(F.count_if(F.col("last") - F.col("value") > slack).alias("violations"), F.max(-F.col("b.first")).alias("peak_idx"))


def regions(rows: DataFrame) -> DataFrame:
    """Runs of rows for which ``on`` holds: record_id, start and stop (of idx), n."""
    w = by_record().orderBy("idx")
    x = rows.withColumn("k", F.row_number().over(w)).where("on").withColumn("island", F.col("k") - F.row_number().over(w))
    return x.groupBy("record_id", "island").agg(F.min("idx").alias("start"), F.max("idx").alias("stop"), F.count(F.lit(1)).alias("n")).drop("island")


def multilead_flutter(leads: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """The largest set of leads whose rate is within the tolerance of one of them; consensus with two leads and 40 % at least. leads: record_id, lead, bpm."""
    other = leads.select(F.col("record_id").alias("_r"), F.col("bpm").alias("_bpm"))
    near = leads.join(other, (F.col("record_id") == F.col("_r")) & (F.abs(F.col("bpm") - F.col("_bpm")) <= tolerance)).groupBy("record_id", "lead", "bpm").agg(F.count(F.lit(1)).alias("support"), median("_bpm").alias("rate"))
    best = near.groupBy("record_id").agg(F.max(F.struct("support", (-F.col("bpm")).alias("slow"), "rate")).alias("b"), F.count(F.lit(1)).alias("n"))
    share = F.col("b.support") / F.col("n")
    return best.select("record_id", F.col("b.support").alias("support"), share.alias("share"), F.col("b.rate").alias("rate_bpm"), ((F.col("b.support") >= 2) & (share >= 0.4)).alias("consensus"))


def pacing_evidence(x: DataFrame) -> DataFrame:
    """Conflicts in pacing evidence, one row a record: n_spikes, n_qrs, n_captured, n_associated, median_offset."""
    c = F.col
    conflict = reasons((c("n_spikes") / F.greatest("n_qrs", F.lit(1)) > 2.5, "spike_burden"), ((c("n_spikes") >= 4) & (c("n_captured") / c("n_spikes") < 0.25), "capture_alignment"), ((c("n_spikes") > 0) & (c("n_associated") / F.greatest("n_spikes", F.lit(1)) < 0.20), "association"))
    routed = (c("n_associated") >= 2) & F.coalesce(F.abs("median_offset") <= 55.0, F.lit(False))
    return x.withColumns({"conflicts": conflict, "routing_allowed": routed})


def pr_availability(x: DataFrame) -> DataFrame:
    """PR is withheld for hard reasons, or where the rhythm is irregular and atrial measurements can't be had. x: pr, reasons (array), rr_cv, atrial_unavailable."""
    hard = F.array(*(F.lit(r) for r in ("af", "flutter", "continuous_pacing", "wide_pacing_like", "complete_block")))
    withheld = F.arrays_overlap("reasons", hard) | (F.coalesce(F.col("rr_cv") >= 0.15, F.lit(False)) & F.col("atrial_unavailable"))
    return x.withColumns({"withheld": withheld, "pr": F.when(~withheld, F.col("pr"))})


def limited_mode(x: DataFrame, *fields: str) -> DataFrame:
    """In limited input mode the fields are not applicable: null, with a state that says why."""
    limited = F.col("input_mode") == "limited"
    return x.withColumns({f: F.when(~limited, F.col(f)) for f in fields} | {"state": F.when(limited, "not_applicable:input_mode_limited").otherwise("measured")})


def one_to_one(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Greedy one-to-one pairs of a (record_id, x) and b (record_id, y): each x in order takes the nearest y within reach that is still free (the earlier of equal ones). A task holds only the peaks within reach of each other; null positions match nothing."""
    peaks = a.select("record_id", F.col("x").cast("double").alias("at"), F.lit(0).alias("side")).unionByName(b.select("record_id", F.col("y").cast("double").alias("at"), F.lit(1).alias("side"))).where("at is not null")
    kind = dict(a.dtypes)["record_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, waiting, free = None, deque(), []  # free: in order, as peaks come

        def settled(before: float) -> list[tuple]:
            """Pairs of the waiting x whose reach ends before ``before``."""
            out = []
            while waiting and waiting[0] + reach < before:
                x = waiting.popleft()
                k = bisect_left(free, x)  # the nearest stands on either side of here
                near = [j for j in (bisect_left(free, free[k - 1]) if k else -1, k) if 0 <= j < len(free) and abs(free[j] - x) <= reach]
                if near:
                    y = free.pop(min(near, key=lambda j: (abs(free[j] - x), free[j])))
                    out.append((record, x, y, abs(y - x)))
            del free[: bisect_left(free, (waiting[0] if waiting else before) - reach)]
            return out

        def made(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (key, *[pa.float64()] * 3), strict=True)], names=["record_id", "x", "y", "gap"])

        key = None
        for batch in batches:
            key, out = batch.schema.field("record_id").type, []
            for r, at, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != record:
                    out += settled(float("inf"))
                    free.clear()
                    record = r
                out += settled(at)
                (free if side else waiting).append(at)
            if out:
                yield made(out, key)
        if last := settled(float("inf")):
            yield made(last, key)

    return peaks.repartition("record_id").sortWithinPartitions("record_id", "at", "side").mapInArrow(run, f"record_id {kind}, x double, y double, gap double")


def agreement(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """record_id, n_a, n_b, matched, precision, recall, f1 of peaks a (record_id, x) against b (record_id, y)."""
    n = lambda p, name: p.groupBy("record_id").agg(F.count(F.lit(1)).alias(name))
    x = n(a, "n_a").join(n(b, "n_b"), "record_id", "full").join(n(one_to_one(a, b, reach), "matched"), "record_id", "left").fillna(0, ["n_a", "n_b", "matched"])
    x = x.withColumns({"precision": F.col("matched") / F.greatest("n_a", F.lit(1)), "recall": F.col("matched") / F.greatest("n_b", F.lit(1))})
    both = F.col("precision") + F.col("recall")
    return x.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


#: json.dumps() would build one for each leaf.
_encoder = json.JSONEncoder(ensure_ascii=False)


def _text(x: object) -> str:
    """The JSON text of a leaf."""
    return int.__repr__(x) if type(x) is int else _encoder.encode(x)


def leaves_of(value: object, pointer: str = "") -> Iterator[tuple[str, str]]:
    """Pointer and JSON text of every leaf: what is neither an object nor an array, and empty ones. A stack stands in for recursion, so depth is no limit."""
    left = [(pointer, value)]
    while left:
        at, x = left.pop()
        if isinstance(x, dict) and x:
            left += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list) and x:
            left += [(f"{at}/{k}", v) for k, v in reversed(list(enumerate(x)))]
        else:
            yield at, _text(x)


def leaves(docs: DataFrame, *beside: str) -> DataFrame:
    """key, pointer, value (JSON text) of every leaf of JSON documents (key, doc), at any depth, in the order of the text; nothing is shuffled. Of a repeated member the last counts. Null documents and text that isn't JSON have no leaves. Columns named in ``beside`` stay, behind the key."""
    names, kinds = ["key", *beside], dict(docs.dtypes)

    def of(doc: str | None) -> list[tuple[str, str]]:
        try:
            return list(leaves_of(json.loads(doc))) if doc is not None else []
        except (ValueError, RecursionError):
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [of(doc) for doc in batch.column("doc").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(mine)), np.array([len(m) for m in mine], int)))
            found = list(chain.from_iterable(mine))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names), pa.array([p for p, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=[*names, "pointer", "value"])

    return docs.select(*names, "doc").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", pointer string, value string")


def leaves_apart(found: DataFrame) -> DataFrame:
    """key, pointer, before, after of the leaves (key, side, pointer, value) that side 0 and side 1 don't have alike: null where a side has no such leaf.

    A key's leaves must follow one another in one task, in whatever order; those of one key
    are held, and nothing is shuffled. Where a key comes repeatedly, each value of a side is
    held against each of the other, and the first two that differ are told.
    """
    kind = dict(found.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def told() -> list[tuple]:
            """Those of the key in hand."""
            pairs = ((p, product(before or [None], after or [None])) for p, (before, after) in held.items())
            return [(key, p, *differing) for p, both in pairs if (differing := next((x for x in both if x[0] != x[1]), None))]

        def made(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (key, *[pa.string()] * 3), strict=True)], names=["key", "pointer", "before", "after"])

        of = None
        for batch in batches:
            of, out = batch.schema.field("key").type, []
            for k, side, pointer, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += told()
                    key, held = k, {}
                held.setdefault(pointer, ([], []))[side].append(value)
            if out:
                yield made(out, of)
        if last := told():
            yield made(last, of)

    return found.select("key", "side", "pointer", "value").mapInArrow(run, f"key {kind}, pointer string, before string, after string")


#: What the input of two runs must agree on before their results are compared.
INPUT_FACTS = ("adapter", "window", "fs", "units", "lead_names", "shape", "signal_sha256", "signal_meta_sha256", "source_files")


def input_mismatches(expected: DataFrame, observed: DataFrame, facts: tuple[str, ...] = INPUT_FACTS) -> DataFrame:
    """key, mismatches (names in order) of the cases that both have: facts that differ, nulls being equal to nulls."""
    x = expected.select("key", F.struct(*facts).alias("e")).join(observed.select("key", F.struct(*facts).alias("o")), "key")
    return x.select("key", F.array_compact(F.array(*(F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"o.{f}")), f) for f in facts))).alias("mismatches"))


def compare_cases(expected: DataFrame, observed: DataFrame, tolerances: DataFrame, facts: tuple[str, ...] = INPUT_FACTS) -> DataFrame:
    """key, status, mismatches, changed, removed, added of cases (key, facts, doc as JSON): leaf by leaf, all leaves of one side against those of the other.

    status: missing (one side has no such case), integrity_error (the inputs differ, so
    leaves aren't compared), diff or pass. Numbers at a pointer that matches a pattern of
    ``tolerances`` (pattern, at_most) may differ by the least of these; others must be equal.
    The documents of both sides are dealt by key once; their leaves stay where these lie. The
    table of tolerances is a configuration of a few rows, and is broadcast as one list.
    """
    both = input_mismatches(expected, observed, facts)
    w, text = Window.partitionBy("key"), F.coalesce("doc", F.lit(""))
    # each key once, by the least number of its rows: this goes by the join's order and needs no sort
    sound = both.where(F.size("mismatches") == 0).select("key", F.monotonically_increasing_id().alias("k")).withColumn("first", F.min("k").over(w)).where("k = first").select("key")
    docs = expected.select("key", F.lit(0).alias("side"), "doc").unionByName(observed.select("key", F.lit(1).alias("side"), "doc"))
    # merged: a broadcast would hold the documents, or a key of every case
    docs = docs.join(sound.hint("merge"), "key")
    # the window has all of a key's documents in one task, as leaves_apart() needs; if they are one text, so are their leaves (a null has none, as a text that isn't JSON)
    docs = docs.withColumn("differ", F.min(text).over(w) != F.max(text).over(w)).where("differ")
    apart = leaves_apart(leaves(docs, "side"))  # most leaves are equal and need no tolerance
    limits = tolerances.agg(F.collect_list(F.struct("pattern", "at_most")).alias("limits"))
    at_most = F.array_min(F.transform(F.filter("limits", lambda t: F.regexp_like("pointer", t["pattern"])), lambda t: t["at_most"]))
    gap = F.abs(F.expr("try_cast(before as double)") - F.expr("try_cast(after as double)"))
    kind = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(~F.coalesce(gap <= F.col("at_most"), F.lit(False)), "changed")
    told = apart.crossJoin(F.broadcast(limits)).withColumn("at_most", at_most).select("key", kind.alias("kind"))
    counts = told.groupBy("key").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("changed", "removed", "added")))
    cases = expected.select("key").join(observed.select("key"), "key", "full").join(both, "key", "left").join(counts, "key", "left").fillna(0, ["changed", "removed", "added"])
    # what both sides have has a list of mismatches
    status = F.when(F.col("mismatches").isNull(), "missing").when(F.size("mismatches") > 0, "integrity_error").when(F.col("changed") + F.col("removed") + F.col("added") > 0, "diff").otherwise("pass")
    return cases.select("key", status.alias("status"), F.coalesce("mismatches", F.array().cast("array<string>")).alias("mismatches"), "changed", "removed", "added")

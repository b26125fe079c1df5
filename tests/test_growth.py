"""Queries whose tasks took too much memory or time: what they do is the same, and their plans stay small."""

import contextlib
import io
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from pulsequilt.functions import beats, dsp
from pulsequilt.operators import documents, engine, fusion, kernels, rescues
from pulsequilt.plans import signals


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def anchor(rows, radius):
    """peak_anchor of one beat by loops; rows: (lead, peak, weight)."""
    best = None
    for centre in sorted({p for _, p, _ in rows}):
        kept = {}
        for lead, p, w in sorted(rows, key=lambda x: (-x[2], x[1])):
            if abs(p - centre) <= radius:
                kept.setdefault(lead, (p, w))
        w = sum(w for _, w in kept.values())
        score = round(w * (len(kept) if len(kept) > 1 else 0.5), 9)
        if best is None or score > best[0]:
            best = score, sum(p * w for p, w in kept.values()) / w, len(kept)
    return round(best[1], 9), best[2]


def test_peak_anchor_by_loops(spark):
    r = random.Random(2)
    rows = [(r.randrange(40), 0, r.choice([1, 2, 3, None]), float(r.randrange(30)), float(r.randrange(1, 9))) for _ in range(400)]
    odd = [(90, 0, 1, None, 2.0), (None, 0, 1, 3.0, 2.0)]
    x = spark.createDataFrame(rows + odd, "record_id long, beat_id int, lead int, peak double, weight double")
    got = {g.record_id: (round(g.anchor, 9), g.n_leads) for g in fusion.peak_anchor(x, 6.0).collect()}
    assert got == {k: anchor([(a, p, w) for i, _, a, p, w in rows if i == k], 6.0) for k in {i for i, *_ in rows}}


def test_peak_anchor_deals_its_rows_once(spark):
    """One shuffle and no join (before: five and a join), into as many tasks as there are partitions whatever the bytes."""
    x = spark.range(100).select(F.col("id").alias("record_id"), F.lit(0).alias("beat_id"), F.lit(1).alias("lead"), F.lit(2.0).alias("peak"), F.lit(1.0).alias("weight"))
    plan = plan_of(fusion.peak_anchor(x, 6.0))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert "Join" not in plan


def rhythm(spikes):
    """pacing_rhythm of one record by loops: spikes, robust_cv."""
    xs = sorted(spikes)
    gap = lambda v: [b - a for a, b in zip(v, v[1:], strict=False)]
    if len(xs) >= 3:
        usual = statistics.median(gap(xs))
        xs = [x for k, x in enumerate(xs) if k == 0 or x - xs[k - 1] >= usual / 2]
    d = gap(xs)
    m = statistics.median(d) if d else 0
    return xs, 1.4826 * statistics.median(abs(v - m) for v in d) / m if len(xs) >= 3 and m > 0 else None


def test_pacing_rhythm_by_loops(spark):
    r = random.Random(4)
    records = {k: [r.randrange(5000) if k % 2 else 400 * j + r.randrange(20) for j in range(1 + k % 9)] for k in range(60)}
    x = spark.createDataFrame([(k, s, 3) for k, v in records.items() for s in v], "record_id long, sample long, lead_votes long")
    got = {g.record_id: (g.spikes, g.robust_cv) for g in engine.pacing_rhythm(x).collect()}
    assert got == {k: rhythm(v) for k, v in records.items()}


def test_spikes_are_dealt_once(spark):
    """Clusters and rhythm of spikes: one shuffle by record, no join (before: sixteen sorts and three joins)."""
    c = spark.range(100).select(F.col("id").alias("record_id"), F.lit("I").alias("lead"), F.lit(500.0).alias("fs"), F.col("id").alias("sample"), F.lit(9.0).alias("score"), F.lit(2.0).alias("width_ms"), F.lit(300.0).alias("prominence_uv"))
    plan = plan_of(engine.pacing_rhythm(engine.spike_clusters(c)))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert "Join" not in plan


def test_families_hold_a_window_against_all_at_once(monkeypatch):
    """The families of a loop over all means; only those that may be the best are aligned and compared one by one."""
    gen = np.random.default_rng(6)
    shapes = gen.normal(size=(40, 2, 24))
    windows = [np.roll(shapes[k % 40], k % 3, axis=1) + gen.normal(0, 0.3, (2, 24)) for k in range(400)]
    windows[50:60] = [np.ones((2, 24))] * 10
    calls, aligned = [], beats.aligned
    monkeypatch.setattr(beats, "aligned", lambda *a: calls.append(1) or aligned(*a))
    held, means, want = beats.Families(0.5, 3), [], []
    got = [held.join(w, k % 9 == 0, "x") for k, w in enumerate(windows)]
    for k, w in enumerate(windows):
        best, most = None, -1.0
        for i, (paced, mean, _) in enumerate(means):
            if paced == (k % 9 == 0) and (c := beats.likeness(aligned(w, mean, 3), mean)) > most:
                best, most = i, c
        if best is None or most < 0.5:
            means.append((k % 9 == 0, w, 1))
            want.append(len(means))
        else:
            paced, mean, n = means[best]
            means[best] = paced, mean + (aligned(w, mean, 3) - mean) / (n + 1), n + 1
            want.append(best + 1)
    assert got == want and len(means) > 30
    assert len(calls) < 3 * len(windows)  # before: one a family


def test_reliable_leads_are_sorted_once(spark):
    """Leads that hold their record's facts: one shuffle and one sort, no join (before: three sorts and a join), with the same rows as facts beside them."""
    r = random.Random(8)
    rows = [(k // 6, f"L{k % 6}", k % 6, r.choice([None, 400.0, 420.0, 640.0]), r.choice([None, 410.0]), r.choice([None, 10.0, 28.0]), r.random(), r.uniform(-1, 1), *(r.random() < 0.7 for _ in range(4))) for k in range(600)]
    leads = spark.createDataFrame(rows, "record_id long, lead string, lead_no int, qt double, qt_consensus double, qt_sd double, conf double, t_amp double, reliable_qt boolean, reliable_global boolean, reliable_t boolean, confused boolean")
    facts = {"qrs_ms": 80.0 + F.col("record_id") % 60, "consensus_ms": F.lit(400.0), "rr_cv": F.lit(0.05)}
    one = rescues.reliable_leads(rescues.prepared(leads.withColumns(facts)))
    beside = rescues.reliable_leads(rescues.prepared(leads, leads.select("record_id").distinct().withColumns(facts)))
    plan = plan_of(one)
    told = lambda df: sorted((g.record_id, g.lead) for g in df.collect())
    assert told(one) == told(beside) != []
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert plan.count("Sort [") == 1 and "Join" not in plan


FACTS = "record_id string, beat int, beat_id string, r_sample int, lead_no int, lead string, t_amplitude_uv long, t_amplitude_uv_why string"
with_onset = lambda x: x.withColumns({"p_onset": F.lit(1).cast("long"), "p_onset_why": F.lit(None).cast("string")})
ACQUIRED = "record_id string, sample_rate_hz double, sample_count int, input_mode string, amplitude_unit string"


def test_documents_fill_gaps_by_place(spark):
    """Records of any gaps, repeated cells, two ids of a beat: as by looking each cell up."""
    r = random.Random(5)
    rows = [(f"r{k}", b, f"b{b}", b * 100, x, f"L{x}", r.choice([None, r.randrange(-9, 9)]), r.choice([None, "low", "flat"])) for k in range(30) for b in range(0, 12, 2) for x in range(1, 5) for _ in range(r.choice([0, 1, 1, 2]))]
    rows += [("twice", 0, i, 0, 1, "L1", v, None) for i, v in (("a", 1), ("b", 2))] + [("twice", 0, "b", 0, 2, "L2", 7, None), ("twice", 3, "c", 0, 2, "L2", 8, None)]
    least, lows = {}, lambda v: (v is not None, v if v is not None else 0)
    for x in rows:
        key = (x[0], x[1], x[4])
        order = [lows(v) for v in (x[2], x[3], x[5], x[6], x[7])]
        if key not in least or order < least[key][0]:
            least[key] = order, x
    docs = {d.record_id: d.doc for d in documents.documents(with_onset(spark.createDataFrame(rows, FACTS)), spark.createDataFrame([("r1", 500.0, 9, "limited", "mV")], ACQUIRED), {"fiducials": ["p_onset"], "amplitudes": ["t_amplitude_uv"]}).collect()}
    assert set(docs) == {x[0] for x in rows}
    for k, doc in docs.items():
        own = {c[1:]: x for c, (_, x) in least.items() if c[0] == k}
        beats, leads = sorted({(x[1], x[2], x[3]) for x in own.values()}), sorted({(x[4], x[5]) for x in own.values()})
        f = doc.measurements.amplitudes.t_amplitude_uv
        assert f["values"] == [[own[b, n][6] if (b, n) in own else None for n, _ in leads] for b, _, _ in beats]
        said = {f"{i}|{x}": own[b, n][7] or "measurement_unavailable" if (b, n) in own else "measurement_unavailable" for b, i, _ in beats for n, x in leads if (b, n) not in own or own[b, n][6] is None}
        counts = sorted((-list(said.values()).count(w), w) for w in set(said.values()))
        if not said:
            assert f.absence is None
        elif len(counts) == 1 and len(said) == len(beats) * len(leads):
            assert f.absence.kind == "unmeasurable" and f.absence.reason == counts[0][1]
        else:
            assert f.absence.default.reason == counts[0][1]
            assert (f.absence.unmeasurable or {}) == {c: w for c, w in said.items() if w != counts[0][1]}
        assert doc.acquisition.sample_rate_hz == (500.0 if k == "r1" else None)


def test_documents_deal_their_rows_once(spark):
    """Facts are dealt once, by number, and no whole document is sorted (before: by bytes, sorted for each cell, and merged with acquisitions)."""
    many = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), *(F.lit(0 if "int" in t or "long" in t else "x").cast(t).alias(c) for c, t in (x.split() for x in FACTS.split(", ")[1:])))
    acquired = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), *(F.lit("1").cast(t).alias(c) for c, t in (x.split() for x in ACQUIRED.split(", ")[1:])))
    plan = plan_of(documents.documents(with_onset(many), acquired, {"fiducials": ["p_onset"], "amplitudes": ["t_amplitude_uv"]}))
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_dense_bytes_are_written_in_batches(spark):
    """The bytes and states of Arrow batches are those made cell by cell, whatever absence says; text of each cell is made no more."""
    rows = [("r1", b, f"b{b}", 0, x, f"L{x}", None if (b + x) % 3 else -b, "low" if b else "flat") for b in range(4) for x in range(3)]
    docs = documents.documents(with_onset(spark.createDataFrame(rows, FACTS)), spark.createDataFrame([], ACQUIRED), {"fiducials": ["p_onset"], "amplitudes": ["t_amplitude_uv"]})
    path, absence = "measurements.amplitudes.t_amplitude_uv.absence", F.col("doc.measurements.amplitudes.t_amplitude_uv.absence")
    texts = lambda m: F.lit(None).cast("map<string,string>") if m is None else F.create_map(*(F.lit(v) for kv in m.items() for v in kv))
    default = lambda kind: F.when(F.lit(kind is not None), F.struct(F.lit(kind).alias("kind"), F.lit("low").alias("reason"))).cast("struct<kind:string,reason:string>")
    kinds = [(None, "unmeasurable", {"b0|L1": "x"}, None), (None, "not_applicable", {"b0|L1": "x"}, None), (None, None, {"b0|L1": "x"}, {"b1|L1": "y"}), (None, "unmeasurable", None, {"b1|L1": "y"}), (None, None, None, None), ("not_applicable", None, None, None)]
    said = [F.struct(default(d).alias("default"), F.lit(k).cast("string").alias("kind"), texts(n).alias("not_applicable"), F.lit("z").alias("reason"), texts(u).alias("unmeasurable")) for k, d, u, n in kinds]
    docs = docs.join(spark.range(len(kinds)), how="cross").withColumn("record_id", F.concat("record_id", F.lit("."), "id")).withColumn("doc", F.col("doc").withField(path, F.get(F.array(*said), F.col("id").cast("int")).cast(docs.select(absence.alias("a")).schema["a"].dataType))).drop("id")
    cells = documents.split_dense(docs)[1].where("pointer like '/measurements%'")
    got = {c.record_id: (bytes(c.data), list(c.states)) for c in cells.collect()}
    for i, (k, d, u, n) in enumerate(kinds):
        code = {"unmeasurable": 2, "not_applicable": 3, None: 1}
        state = lambda c: code[k] if k else 2 if c in (u or {}) else 3 if c in (n or {}) else code[d]  # noqa: B023, E731
        assert got[f"r1.{i}"] == (b"".join((x[6] or 0).to_bytes(4, "little", signed=True) for x in rows), [state(f"{x[2]}|{x[5]}") if x[6] is None else 0 for x in rows])
    assert "MapInArrow" in plan_of(cells)


def test_boundaries_are_fused_together_as_alone():
    """To the last bit, whatever the sizes (sums of eight and more round otherwise), ties, weights and values that aren't finite."""
    r = np.random.default_rng(3)
    sizes = np.concatenate([r.integers(1, 25, 3000), [63, 64, 200]])
    n = int(sizes.sum())
    for values, weights in ((r.integers(200, 251, n).astype(float), 1 - 5 * np.round(r.integers(0, 11, n) / 100, 2)), (r.normal(300, 20, n), r.uniform(1e-3, 2, n))):
        odd = r.integers(0, n, 40)
        values[odd[:20]] = np.nan
        weights[odd[20:]] = 0.0
        starts = np.cumsum(sizes) - sizes
        alone = []
        for a, k in zip(starts, sizes, strict=True):
            try:
                alone.append(dsp.fuse(values[a : a + k], weights[a : a + k], 500.0))
            except ValueError:  # a boundary that isn't a number is an error, as before
                alone.append(None)
        good = np.array([x is not None for x in alone])
        held = np.repeat(good, sizes)
        got = dsp.fuse_all(values[held], weights[held], sizes[good], 500.0)
        for name in ("boundary", "support", "mad_ms", "ci_ms"):
            assert np.array_equal(got[name], np.array([x[name] for x in alone if x is not None]), equal_nan=True), name
    assert all(x.size == 0 for x in dsp.fuse_all(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 500.0).values())


def test_recordings_are_dealt_once(spark):
    """From vectors to a record's leads: one shuffle, by number (before: several, by bytes, so that few tasks held all samples)."""
    plan = plan_of(kernels.records(signals.limbs(spark, "/root/testdata/sf0.001")))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan

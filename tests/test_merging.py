"""Merging in order, against brute force and by hand."""

import random

import numpy as np
from test_engine import FS, frame

from pulsequilt.operators import kernels as K
from pulsequilt.operators import merging as M


def slow_clusters(rows, radius):
    """Clusters of sorted (value, weight) rows, each worked out anew."""
    out = []
    for v, w in sorted(rows):
        if out:
            order = sorted(out[-1])
            half = sum(x[1] for x in order) / 2
            center = next(x[0] for k, x in enumerate(order) if sum(y[1] for y in order[: k + 1]) >= half)
            if abs(v - center) <= radius and max(order[-1][0] - order[0][0], abs(v - center)) <= 2 * radius:
                out[-1].append((v, w))
                continue
        out.append([(v, w)])
    return out


def test_clusters_equal_brute_force(spark):
    r = random.Random(4)
    rows = {k: [(float(r.randint(0, 60)), r.choice([0.25, 0.5, 1.0])) for _ in range(r.randint(0, 40))] for k in range(20)}
    df = spark.createDataFrame([(k, *x) for k, v in rows.items() for x in v] + [(1, None, 1.0), (1, 2.0, None)], "record_id long, value double, weight double").repartition(5)
    got = {}
    for x in M.compact_clusters(df, 4.0).collect():
        got.setdefault(x.record_id, {}).setdefault(x.cluster, []).append((x.value, x.weight))
    for k, v in rows.items():
        assert [sorted(c) for _, c in sorted(got.get(k, {}).items())] == [sorted(c) for c in slow_clusters(v, 4.0)]


def slow_merge(events, reach):
    out = []
    for e in sorted(events, key=lambda e: (e["sample"], e["time_ms"], e["association"])):
        for k, o in enumerate(out):
            if abs(o["sample"] - e["sample"]) <= reach:
                win, lose = (e, o) if e["association"] != "blocked" and o["association"] == "blocked" else (o, e)
                out[k] = win | {"confidence": max(win["confidence"], lose["confidence"]), "leads": sorted(set(win["leads"]) | set(lose["leads"]))}
                break
        else:
            out.append(e | {"leads": sorted(set(e["leads"]))})
    return out


def test_merged_events_equal_brute_force(spark):
    r = random.Random(5)
    rows = [{"record_id": k, "sample": r.randint(0, 300), "time_ms": float(i), "confidence": round(r.random(), 3), "association": r.choice(["blocked", "blocked", "conducted", "retrograde"]), "leads": r.sample(["I", "II", "V1"], r.randint(1, 2))} for k in range(15) for i in range(r.randint(0, 40))]
    schema = "record_id long, sample long, time_ms double, confidence double, association string, leads array<string>"
    df = spark.createDataFrame([tuple(x.values()) for x in rows] + [(1, None, 0.0, 1.0, "blocked", ["I"])], schema).repartition(4)
    got = sorted((x.asDict() for x in M.merged_events(df, 12).collect()), key=repr)
    assert got == sorted((e for k in range(15) for e in slow_merge([x for x in rows if x["record_id"] == k], 12)), key=repr)
    assert M.merged_events(spark.createDataFrame([(7, 5, None, None, None, None)], schema), 12).collect()[0].association == "blocked"


def test_mains_are_told(spark):
    t = np.arange(2500) / FS
    r = np.random.default_rng(6)
    hum = lambda hz: 0.2 * np.sin(2 * np.pi * hz * t) + r.normal(0, 0.01, t.size)
    rows = [(1, "I", hum(50)), (1, "II", hum(50.4)), (2, "I", hum(60)), (2, "II", hum(59.6)), (3, "I", 0 * t)]
    assert {x.record_id: x.mains_hz for x in K.mains_frequency(frame(spark, rows)).collect()} == {1: 50, 2: 60, 3: 50}


def test_weighted_middle_adds_up_in_plain_doubles():
    """Weights whose running sum meets half of their plain sum at the second; half of a sum that makes up for rounding is greater."""
    w = [k / 100 + 0.01 for k in (83, 70, 18, 66, 59, 8)]
    assert M.weighted_middle([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], w) == 2.0

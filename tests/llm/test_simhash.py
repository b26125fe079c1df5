import random
from collections import defaultdict

import numpy as np
import xxhash

from pulsequilt.llm import simhash
from pulsequilt.llm.graph import components

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs):
    """Least id of each id's component, by comparing all fingerprints."""
    ids = [i for i, _ in pairs]
    fp = np.array([f for _, f in pairs], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 62)
    for k, i in enumerate(ids):
        least[find(k)] = min(least[find(k)], i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: f"{f:016x}" for i, f in want} == {i: r.fingerprint for i, r in got.items()}
    assert groups(want) == {i: r.component_id for i, r in got.items()}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(groups(want).values())


def test_awkward_rows(awkward, no_documents):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[3].component_id == 1 and by[5].component_id == 4
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = sorted(r.doc_id or 0 for r in simhash.one_of_each(awkward).collect())
    assert kept == [0, 1, 4, 7, 8, 9, 10, 11]
    assert simhash.one_of_each(no_documents).count() == 0
    assert simhash.one_of_each(awkward).columns == awkward.columns
    assert {tuple(r[5:]) for r in simhash.one_of_each(awkward).collect()} == {tuple(r[5:]) for r in awkward.collect()}


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 64, 3000, np.uint64)
    other = fp.copy()
    for k in range(fp.size):
        for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
            other[k] ^= np.uint64(1 << b)
    home, rows = simhash.home_keys(fp.view(np.int64), True)
    held = defaultdict(set)
    for key, r in zip(home.tolist(), rows.tolist()):
        held[r].add(key)
    near, rows = simhash.near_keys(other.view(np.int64))
    met = {r for key, r in zip(near.tolist(), rows.tolist()) if key in held[r]}
    assert len(met) == fp.size


def test_golay_code_is_perfect():
    _, near = simhash.golay()
    assert (near[:, 0] >= 0).all() and max(int(x).bit_count() for x in near[:, 0]) == 3
    close = (near >= 0) & (np.bitwise_count(near.astype(np.uint64)) <= 4)
    assert sorted(close.sum(axis=1).tolist()) == [1] * 277 + [6] * 1771
    assert (close == (simhash.codewords(near[:, 0], simhash.WIDE) >= 0)[:, :1] & close).all() and (near >= 0).sum() == 44552  # all words within five errors
    word = np.array([0b1010101], np.int64)
    assert 0 <= simhash.codewords(word)[0, 0] < 4096


def test_dense_clouds_and_chains(spark):
    """A cloud of near fingerprints, chains of four-bit steps, and lone ones, joined exactly."""
    r = random.Random(9)
    fps = set()
    base = r.getrandbits(64)
    for _ in range(400):
        fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    x = r.getrandbits(64)
    for _ in range(60):
        fps.add(x)
        x ^= sum(1 << b for b in r.sample(range(64), 4))
    fps |= {r.getrandbits(64) for _ in range(300)}
    pairs = list(enumerate(sorted(fps)))
    signed = [(f - (f >> 63 << 64),) for _, f in pairs]
    df = spark.createDataFrame(signed, "fp long")
    got = defaultdict(set)
    for row in simhash.link_components(df).collect():
        got[row.root].add(row.fp & (1 << 64) - 1)
    want = defaultdict(set)
    which = groups(pairs)
    for i, f in pairs:
        want[which[i]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sent_whole(plan):
    """Lines below a broadcast that make more rows of what they read."""
    depth, found = None, []
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None and ("MapInArrow" in line or "Generate" in line):
            found.append(line.strip())
        if depth is None and "BroadcastExchange" in line:
            depth = at
    return found


def test_keys_and_dealt_rows_are_not_sent_through_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pulsequilt.llm import common, graph

    plans = []

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df)

    monkeypatch.setattr(simhash, "stored", stored)
    monkeypatch.setattr(graph, "stored", stored)
    # keys of 2000 fingerprints, some of them near, stand below Spark's limit for broadcasts by the size of the fingerprints alone
    nodes = stored(spark.range(2000).select(F.expr("CASE WHEN id % 4 > 0 THEN xxhash64(id) ELSE shiftleft(1L, CAST(id % 60 AS INT)) END").alias("fp")).distinct())
    plans.append(simhash.link_components(nodes)._jdf.queryExecution().executedPlan().toString())
    assert any("MapInArrow" in p for p in plans)
    assert [x for p in plans for x in sent_whole(p)] == []


def test_released_gives_the_same_batches():
    """What a task gives stays as it is; memory goes back when it ends."""
    from pulsequilt.llm.common import released

    assert list(released(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]

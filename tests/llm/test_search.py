import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from pulsequilt.llm import search

SF = "/root/testdata/sf0.001"


def slow_terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def slow(docs, items, k=20):
    """(item, rank, doc_id, score) of every item by scoring all documents."""
    counted = [(i, Counter(slow_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 75 + (25 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in slow_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def fast(docs, items, k=20):
    return sorted((tuple(r) for r in search.search(search.build(docs), items, k).collect()), key=repr)


def pairs(df, key):
    return [(r[key], r.text) for r in df.collect()]


def test_whole_table_against_a_loop_and_sql(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = fast(docs, items)
    assert got == slow(pairs(docs, "doc_id"), pairs(items, "item_id")) and len(got) == 800
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(c.execute(f"SELECT item_id, rank, doc_id, score FROM ({search.SQL})").fetchall(), key=repr) == got


def topics(spark, n=1200, words=150, seed=5):
    """Documents of 8 topics with words of their own, beside common ones, in mixed order."""
    r = random.Random(seed)
    rows = [(k, k % 8, " ".join(r.choice([f"t{k % 8}w{int(r.random() ** 2 * words)}", f"c{r.randint(0, 30)}"]) for _ in range(40))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, topic int, text string").repartition(6)


def test_bisection_separates_topics(spark):
    rows, docs = topics(spark)
    tree = search.fit_tree(search.sample(docs))
    assert len(tree.least) == 15
    leaves = Counter((tree.leaf(set(search.terms_of(t.encode()))), topic) for _, topic, t in rows)
    most = Counter()
    for (leaf, _), n in leaves.items():
        most[leaf] = max(most[leaf], n)
    assert sum(most.values()) > 0.9 * len(rows)


def test_bisection_lowers_the_cost_of_gaps():
    r = np.random.default_rng(2)
    ids = [np.unique(r.integers(0, 50, 12) + 50 * (k % 2)) for k in range(200)]
    right = search.bisect(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), np.concatenate(ids), 100)
    assert right.sum() == 100
    assert max(np.mean(right[::2]), np.mean(right[1::2])) > 0.95


def test_shards_below_the_bound_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 600)
    monkeypatch.setattr(search, "ROUNDS", (2, 6))
    rows, docs = topics(spark)
    items = spark.createDataFrame([(k, f"t{k}w1 t{k}w2 t{k}w3 t{k}w3") for k in range(8)], "item_id long, text string")
    seen, score = [], search._score

    def counted(*args):
        run = score(*args)
        visited = spark.sparkContext.accumulator(0)
        seen.append(visited)

        def watch(postings, visits):
            visited.add(visits.num_rows)
            return run(postings, visits)

        return watch

    monkeypatch.setattr(search, "_score", counted)
    index = search.build(docs)
    shards = index.postings.where("term is null").count()
    got = sorted((tuple(r) for r in search.search(index, items, 5).collect()), key=repr)
    assert got == slow([(i, t) for i, _, t in rows], [(r.item_id, r.text) for r in items.collect()], 5)
    assert shards > 30 and 8 * 2 <= sum(v.value for v in seen) < 8 * shards / 2


def test_ties_repeated_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 50)
    rows = [(k * 7 % 101, "the same text") for k in range(101)] + [(3, "the same text"), (None, "the same text"), (200, "other words"), (201, None), (202, "Éa éa A1b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(1, "same"), (1, "SAME other other"), (2, None), (3, "éa É none"), (None, "text 1b a1B"), (4, "words"), (4, "words")]
    assert fast(docs, spark.createDataFrame(items, "item_id long, text string")) == slow(rows, items)


def test_awkward_rows(spark, awkward, no_documents):
    items = spark.createDataFrame([(1, "same words", 1), (2, "日本語 🙂 long", 2), (3, "", 3), (4, "x" * 70000, 4)], "item_id long, text string, q int")
    assert fast(awkward, items) == slow(pairs(awkward, "doc_id"), pairs(items, "item_id"))
    assert fast(no_documents, items) == [] and fast(awkward, items.where("false")) == []
    assert fast(awkward.where("doc_id < 4"), items) == []

"""Ranked lexical search over a clustered index of reordered documents.

Recursive graph bisection orders documents so that those with the same terms
stand together: each node splits its documents into halves, and swaps those
that lower the log-gap cost of the halves' terms, until none do. The tree is
fitted on a bounded sample (``SAMPLE`` different texts, ``SKETCH`` terms of
each); its nodes keep each term's pull to a side, by which every document of
the table goes down to a leaf. Leaves are cut into shards of bounded size.

The index holds, for each shard and term, the documents and their impacts (the
part of the score that is free of the query), and the greatest impact. For each
query a shard's bound is the sum of its terms' greatest impacts, weighted. Shards
are visited from the highest bound down, in rounds; a shard whose bound is
below the score that is k-th so far cannot hold a result, and one whose bound
equals it can, by a smaller doc_id, so it is visited: results are exact whatever
the tree. Scores are 64-bit integers; ties go by doc_id, null ids last.

Null texts have no terms. Repeated documents are ranked each; repeated items are
answered each. No documents, no items or no common term give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Different texts that the bisection is fitted on, terms of each at most, and the longest of these in bytes.
SAMPLE, SKETCH, LONGEST = 4096, 512, 32
#: Terms that the bisection knows at most: the most frequent in the sample, but for those in over half of its texts.
VOCABULARY = 1 << 14
#: A leaf has this many texts of the sample at least; a node's halves swap in so many passes at most.
LEAF, PASSES = 64, 12
#: Postings of a shard, about.
SHARD_POSTINGS = 1 << 19
#: Shards that a query visits in its first rounds; the last round takes all that the bound leaves.
ROUNDS = (4, 32)
#: Items that are answered at once; their terms and weights are sent to all tasks.
BLOCK = 1024
#: A document's m: its constant, and the share of its length.
FLAT, BY_LENGTH = 75, 25

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: stretches of digits, letters and whatever is not ASCII, with A-Z in lower case."""
    return text.translate(_FOLD).split()


# ---------------------------------------------------------------- recursive graph bisection


@dataclass
class Tree:
    """A full binary tree in breadth-first order: each node's pull of every term to the right, and the least pull that goes right."""

    places: dict[bytes, int]
    pull: np.ndarray
    least: np.ndarray

    def leaf(self, terms: Iterator[bytes]) -> int:
        get, node = self.places.get, 0
        known = np.array([p for t in terms if (p := get(t)) is not None], np.int64)
        while node < len(self.least):
            node = 2 * node + 1 + int(self.pull[node, known].sum(dtype=np.float64) > self.least[node])
        return node - len(self.least)


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    """About the bits of the gaps of terms with d of n documents."""
    return d * np.log2(n / (d + 1.0))


def bisect(start: np.ndarray, ids: np.ndarray, n_terms: int) -> np.ndarray:
    """Which documents (term places ``ids`` from ``start`` on) go to the right half, by swaps of those that gain most."""
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    right = np.arange(n) >= n // 2
    sizes = n - n // 2, n // 2
    for _ in range(PASSES):
        degrees = np.bincount(ids + n_terms * right[owner], minlength=2 * n_terms).reshape(2, n_terms).astype(float)
        gains = []
        for own, other, n_own, n_other in ((degrees[0], degrees[1], *sizes[::-1]), (degrees[1], degrees[0], *sizes)):
            gains.append(_cost(own, n_own) + _cost(other, n_other) - _cost(np.maximum(own - 1, 0), n_own) - _cost(other + 1, n_other))
        gain = np.bincount(owner, np.where(right[owner], gains[1][ids], gains[0][ids]), minlength=n)
        left_order, right_order = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~right, right))
        m = min(len(left_order), len(right_order))
        swaps = int(np.count_nonzero(np.cumsum(np.ones(m))[gain[left_order[:m]] + gain[right_order[:m]] > 1e-9]))
        if not swaps:
            break
        right[left_order[:swaps]], right[right_order[:swaps]] = True, False
    return right


def fit_tree(texts: list[list[bytes]]) -> Tree:
    """The bisection of sampled texts (their different terms). Without texts, or few, it has one leaf."""
    df = Counter(t for terms in texts for t in terms)
    chosen = sorted((t for t, d in df.items() if 2 <= d <= len(texts) / 2), key=lambda t: (-df[t], t))[:VOCABULARY]
    places = {t: k for k, t in enumerate(chosen)}
    rows = [np.array(sorted(places[t] for t in terms if t in places), np.int64) for terms in texts]
    depth = max(0, (len(texts) // LEAF).bit_length() - 1)
    pull, least = np.zeros((2**depth - 1, len(places)), np.float32), np.zeros(2**depth - 1)
    members = {0: np.arange(len(texts))}
    for node in range(2**depth - 1):
        mine = members.pop(node)
        if len(mine) > 1:
            start = np.concatenate([[0], np.cumsum([len(rows[k]) for k in mine])])
            ids = np.concatenate([rows[k] for k in mine])
            right = bisect(start, ids, len(places))
            owner = np.repeat(np.arange(len(mine)), np.diff(start))
            there = [np.bincount(ids[side[owner]], minlength=len(places)) for side in (~right, right)]
            share = [np.log2((t + 1) / (side.sum() + 2)) for t, side in zip(there, (~right, right), strict=True)]
            pull[node] = share[1] - share[0]
            pulls = np.array([pull[node, rows[k]].sum(dtype=np.float64) for k in mine])
            least[node] = np.median(pulls)
            goes = pulls > least[node]
        else:
            goes = np.zeros(len(mine), bool)
        members[2 * node + 1], members[2 * node + 2] = mine[~goes], mine[goes]
    return Tree(places, pull, least)


def sample(docs: DataFrame) -> list[list[bytes]]:
    """Terms of SAMPLE different texts: those of the least hashes, so copies count once."""
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    terms = sorted(x for x in set(terms_of(t)) if len(x) <= LONGEST)
                    out.append((h, terms[:: -(-len(terms) // SKETCH) or 1]))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.binary()))], names=["h", "terms"])

    small_batches(docs.sparkSession)
    sketches = hashed.join(F.broadcast(least), "h").mapInArrow(run, "h long, terms array<binary>").groupBy("h").agg(F.any_value("terms").alias("terms"))
    return [[bytes(t) for t in r.terms] for r in sketches.orderBy("h").collect()]


# ---------------------------------------------------------------- the index


@dataclass
class Index:
    """postings: shard, term, df, top, places and impacts; for each shard also a row without a term, with its doc_ids. n_docs: documents with a term."""

    postings: DataFrame
    n_docs: int


def _lists(lengths: np.ndarray | list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), pa.int32()), values)


def forward(docs: DataFrame, tree: Tree) -> DataFrame:
    """leaf, row (a number of its own), doc_id, n, terms, times of every document with a term."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            lengths = [len(c) for c in counts]
            total = sum(lengths)
            times = np.fromiter((k for c in counts for k in c.values()), np.int32, total)
            columns = {
                "leaf": pa.array([tree.leaf(c) for c in counts], pa.int32()),
                "row": pa.array(range(row, row + len(counts)), pa.int64()),
                "doc_id": batch.column(0),
                "n": pa.array([c.total() for c in counts], pa.int64()),
                "terms": _lists(lengths, pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())),
                "times": _lists(lengths, pa.array(times)),
            }
            row += len(counts)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "leaf int, row long, doc_id long, n long, terms array<string>, times array<int>").where("n > 0")


POSTINGS = "shard long, term string, df long, top int, places array<int>, impacts array<int>, ids array<long>"


def _invert(n_docs: int, n_terms: int):
    """A function from a shard's documents to its postings."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])  # nulls come last
        shard = table.column("shard")[0].as_py()
        lists = table.column("terms").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        code, tf = coded.indices.to_numpy(), table.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = FLAT + BY_LENGTH * table.column("n").to_numpy() * n_docs // n_terms
        place = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        impact = (1_000_000_000 * tf // (1000 * tf + 12 * m[place])).astype(np.int32)
        order = np.argsort(code, kind="stable")
        df = np.bincount(code, minlength=len(coded.dictionary))
        top = np.maximum.reduceat(impact[order], np.concatenate([[0], np.cumsum(df)[:-1]]))
        k, nulls = len(df), lambda kind: pa.nulls(1, kind)
        columns = [
            pa.array(np.full(k + 1, shard), pa.int64()),
            pa.concat_arrays([coded.dictionary.cast(pa.string()), nulls(pa.string())]),
            pa.concat_arrays([pa.array(df, pa.int64()), nulls(pa.int64())]),
            pa.concat_arrays([pa.array(top, pa.int32()), nulls(pa.int32())]),
            _lists([*df, 0], pa.array(place[order])),
            _lists([*df, 0], pa.array(impact[order])),
            _lists([0] * k + [len(lengths)], table.column("doc_id").combine_chunks()),
        ]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in POSTINGS.split(", ")])

    return run


def build(docs: DataFrame) -> Index:
    """The index of all documents (doc_id, text). Texts are read whole; what is shuffled are their terms, by shard."""
    rows = stored(forward(docs, fit_tree(sample(docs))))
    # one row a leaf, of at most SAMPLE / LEAF leaves
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum(F.size("terms").cast("long")).alias("postings")).orderBy("leaf").collect()
    n_docs, n_terms = sum(r.docs for r in leaves), sum(r.n for r in leaves)
    cuts, first, shard = 0, {}, F.lit(None).cast("long")
    for r in leaves:
        first[r.leaf], parts = cuts, -(-r.postings // SHARD_POSTINGS)
        shard = F.when(F.col("leaf") == r.leaf, F.pmod(F.xxhash64("row"), F.lit(parts)) + cuts).otherwise(shard)
        cuts += parts
    sharded = rows.select(shard.alias("shard"), "row", "doc_id", "n", "terms", "times")
    return Index(stored(sharded.groupBy("shard").applyInArrow(_invert(n_docs, max(n_terms, 1)), POSTINGS)), n_docs)


# ---------------------------------------------------------------- search


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """q (a number of its own), key, terms, times of every item with a term."""
    docs = items.select(F.col(key).cast("long").alias("doc_id"), "text")
    return forward(docs, Tree({}, np.zeros((0, 0)), np.zeros(0))).select(F.col("row").alias("q"), F.col("doc_id").alias(key), "terms", "times")


def _score(asked: dict[int, list[tuple[str, int]]], k: int):
    """A function from a shard's postings and the items that visit it to each item's k best documents there; asked has each item's terms with their weights."""

    def run(postings: pa.Table, visits: pa.Table) -> pa.Table:
        terms = postings.column("term").to_pylist()
        where = {t: i for i, t in enumerate(terms)}
        ids = postings.column("ids").combine_chunks()[where[None]].values if None in where else pa.array([], pa.int64())
        lists = postings.column("places").combine_chunks(), postings.column("impacts").combine_chunks()
        offsets = lists[0].offsets.to_numpy()
        places, impacts = (x.values.to_numpy() for x in lists)
        out_q, out_score, out_id = [], [], []
        for q in visits.column("q").to_pylist():
            score = np.zeros(len(ids), np.int64)
            for term, weight in asked[q]:
                if (i := where.get(term)) is not None:
                    a, b = offsets[i], offsets[i + 1]
                    score[places[a:b]] += weight * impacts[a:b].astype(np.int64)
            found = np.flatnonzero(score)
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            best = found[np.argsort(-score[found], kind="stable")][:k]  # places are in order of doc_id
            out_q += [q] * len(best)
            out_score.append(score[best])
            out_id.append(ids.take(pa.array(best)))
        return pa.Table.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate([*out_score, np.zeros(0, np.int64)])), pa.concat_arrays([*out_id, pa.array([], pa.int64())])], names=["q", "score", "doc_id"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search_block(index: Index, items: DataFrame, k: int) -> DataFrame:
    """q, rank, doc_id, score for a block of items."""
    from pyspark.sql import Window

    spark = items.sparkSession
    pairs = items.select("q", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("q", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    mine = stored(index.postings.join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi").unionByName(index.postings.where("term is null")))
    df = mine.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * index.n_docs + 2)).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = stored(pairs.join(df, "term").select("q", "term", (F.col("times") * weight).alias("weight")))
    asked: dict[int, list[tuple[str, int]]] = {}
    for q, term, w in weights.collect():  # the terms of at most BLOCK items
        asked.setdefault(q, []).append((term, w))
    bounds = stored(mine.where("term is not null").select("shard", "term", "top").join(F.broadcast(weights), "term").groupBy("q", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0"))
    best = spark.createDataFrame([], "q long, score long, doc_id long")
    done = bounds.select("q", "shard").where("false")
    for most in (*ROUNDS, None):
        least = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("q", "least")
        left = bounds.join(done, ["q", "shard"], "left_anti").join(F.broadcast(least), "q", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0)))
        if most:
            left = left.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "shard"))).where(F.col("place") <= most)
        visits = stored(left.select("q", "shard"))
        found = mine.join(visits.select("shard").distinct(), "shard", "left_semi").groupBy("shard").cogroup(visits.groupBy("shard")).applyInArrow(_score(asked, k), "q long, score long, doc_id long")
        best = stored(_best(best.unionByName(found), k).select("q", "score", "doc_id"))
        done = done.unionByName(visits)
    return _best(best, k)


def search(index: Index, items: DataFrame, k: int = 20, key: str = "item_id") -> DataFrame:
    """key, rank, doc_id, score: each item's k highest-scoring documents with a score above 0."""
    asked = stored(item_terms(items, key))
    blocks = -(-asked.count() // BLOCK)
    out = items.sparkSession.createDataFrame([], f"{key} long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        out = out.unionByName(_search_block(index, block, k).join(block.select("q", key), "q").select(key, "rank", "doc_id", "score"))
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
#: The same rows from all postings, without an index.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, term, times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), stats),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * ({FLAT} + ({BY_LENGTH} * n * docs) // total)))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN n USING (r), stats GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r) WHERE score > 0) WHERE rank <= 20"""

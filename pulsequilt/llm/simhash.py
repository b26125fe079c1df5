"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits part into segments of 22, 21 and 21 bits, each read as
a word of the binary Golay code [23, 12, 7]. Every word lies within three bits
of exactly one codeword, its home; words at distance three have five more
codewords at distance four. Two words at most one bit apart are such that the
home of one is among the near codewords (distance four or less) of the other.

Of at most four errors, either two segments have at most one each, and then
the pair of their codeword indices (24 bits) meets between home and near keys;
or the errors are two, two and none, and then one segment is equal and another
two bits apart: the equal segment with the other's home codeword (33 bits or
more) meets among its codewords of distance five or less, some 22. So six home
keys and some 170 others of a fingerprint find all links, which an exact
Hamming test confirms. Of n fingerprints without likeness, some n^2 / 200,000
pairs meet by chance in a key of two codewords: linear work up to some hundred
million documents, beyond which longer fingerprints would be needed.

Copies meet as one fingerprint before any key is made. Pivots of the home keys
link most of a large group by stars; the keys' join then looks only at pairs
from different components, and skips keys that hold a single one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, by_batch, dealt_join, hot_values, released, shuffled, stored, texts
from .graph import components

#: Offset and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
PIVOTS = 4
MAX_ERRORS = 4


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of word shingles, as an unsigned number; A to Z count as lower case, words part at ASCII white space. No words: 0."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    n = len(tokens) - words + 1
    buffer = b" ".join(tokens)
    if n <= 1:
        return hash_of(buffer, 42)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes) + np.arange(len(tokens))
    starts = (ends - sizes)[:n].tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([hash_of(buffer[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


# ---------------------------------------------------------------- Golay code


#: Codewords at distance four or less, and at distance five or less, of a word, at most.
NEAR, WIDE = 6, 22


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte at each of three places; and for each of 2048 remainders the errors to all codewords at distance five or less (-1: none), nearest first."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    of_byte = np.array([[remainder(b << 8 * k) if b << 8 * k < 1 << 23 else 0 for b in range(256)] for k in range(3)])
    of_bit = [remainder(1 << k) for k in range(23)]
    near = np.full((2048, WIDE), -1, np.int64)
    used = np.zeros(2048, int)
    for weight in range(6):
        for places in combinations(range(23), weight):
            e = s = 0
            for p in places:
                e, s = e | 1 << p, s ^ of_bit[p]
            near[s, used[s]] = e
            used[s] += 1
    return of_byte, near


def codewords(x: np.ndarray, most: int = NEAR) -> np.ndarray:
    """Indices (12 bits each) of codewords near 23-bit words: the home in the first column, then those of greater distance (-1: none); NEAR columns hold all up to distance four, WIDE all up to five."""
    of_byte, near = golay()
    s = of_byte[0][x & 255] ^ of_byte[1][x >> 8 & 255] ^ of_byte[2][x >> 16 & 255]
    e = near[s, :most]
    if most == NEAR:
        e = np.where(np.bitwise_count(e.astype(np.uint64)) > 4, -1, e)
    return np.where(e < 0, -1, (x[:, None] ^ e) >> 11)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


#: The kind of a key (0 to 2: two codewords; 3 to 5: an equal segment and a codeword of the next) is in its bits from here on.
KIND = 40


def home_keys(fp: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row each is of: one for each pair of segments, and with ``exact`` one for each equal segment."""
    parts = segments(fp)
    codes = [codewords(x, 1)[:, 0] for x in parts]
    keys = [k << KIND | codes[a] << 12 | codes[b] for k, (a, b) in enumerate(PAIRS)]
    if exact:
        keys += [(3 + k) << KIND | x << 12 | codes[(k + 1) % 3] for k, x in enumerate(parts)]
    return np.concatenate(keys), np.tile(np.arange(fp.size), len(keys))


def near_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a linked fingerprint has among its home keys (with exact), and the row each is of."""
    parts = segments(fp)
    codes = [codewords(x) for x in parts]
    keys, rows = [], []
    for k, (a, b) in enumerate(PAIRS):
        both = k << KIND | codes[a][:, :, None] << 12 | codes[b][:, None, :]
        at = np.nonzero((codes[a][:, :, None] >= 0) & (codes[b][:, None, :] >= 0))
        keys.append(both[at])
        rows.append(at[0])
    for k, x in enumerate(parts):
        wide = codewords(parts[(k + 1) % 3], WIDE)
        at = np.nonzero(wide >= 0)
        keys.append(((3 + k) << KIND | x[:, None] << 12 | wide)[at])
        rows.append(at[0])
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(nodes: DataFrame, kind: str) -> DataFrame:
    """key and the columns of nodes (fp first; all long) for each key."""
    names = nodes.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, rows = near_keys(fp) if kind == "near" else home_keys(fp, kind == "exact")
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c.to_numpy(zero_copy_only=False)[rows], pa.int64()) for c in part.columns)], names=["key", *names])

    return nodes.mapInArrow(released(run), ", ".join(f"{n} long" for n in ["key", *names]))


# ---------------------------------------------------------------- links and components


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed number) of every text, as a stored table."""

    def make():
        def run(x):
            fps = [fingerprint(t, words) for t in x["text"]]
            return {"doc_id": x["doc_id"], "fp": [f - (f >> 63 << 64) for f in fps]}

        return run

    return stored(by_batch(texts(docs), make, "doc_id long, fp long"))


def _first_way() -> F.Column:
    """The lowest key kind that is sure to find the pair (fp, other), so that each link comes once."""
    d = [F.bit_count(F.col("fp").bitwiseXOR(F.col("other")).bitwiseAND(F.lit(((1 << width) - 1) << at if at + width < 64 else -(1 << at)))) for at, width in SEGMENTS]
    pairs = [(d[a] <= 1) & (d[b] <= 1) for a, b in PAIRS]
    ways = [*pairs, d[0] == 0, d[1] == 0, d[2] == 0]
    out = F.when(ways[0], 0)
    for k, way in enumerate(ways[1:], 1):
        out = out.when(way, k)
    return out


def link_components(nodes: DataFrame) -> DataFrame:
    """fp, root (the least fingerprint that links reach) of distinct fingerprints; nodes is a stored table with a column fp."""
    nodes = nodes.select("fp")
    homes = _keyed(nodes, "home")
    pivots = homes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.min(F.struct(F.xxhash64(F.col("fp"), F.lit(k)).alias("h"), F.col("fp").alias("fp"))).alias(f"p{k}") for k in range(PIVOTS))).where("n > 1").select("key", F.array_distinct(F.array(*(F.col(f"p{k}.fp") for k in range(PIVOTS)))).alias("pivots"))
    close = F.filter("pivots", lambda p: (p != F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(p)) <= MAX_ERRORS))
    stars = homes.join(shuffled(pivots), "key").select("fp", F.explode(close).alias("pivot")).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    first = stored(components(stars))
    own = stored(nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))

    held = stored(_keyed(own, "exact"))
    # bits that all of a key's fingerprints share bound the distance to each of them from below: a key met by chance mostly goes by that
    ends = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any"))
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("all")).bitwiseAND(F.bitwise_not(F.col("all").bitwiseXOR(F.col("any")))))
    seek = shuffled(_keyed(own, "near")).join(shuffled(ends), "key").where(((F.col("low") != F.col("high")) | (F.col("low") != F.col("root"))) & (differ <= MAX_ERRORS)).select("key", "fp", "root")
    other = held.select("key", F.col("fp").alias("other"), F.col("root").alias("other_root"))
    apart = (F.col("root") != F.col("other_root")) & (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_ERRORS)
    seek, other = seek.alias("s"), other.alias("o")
    links = seek.join(shuffled(other), (F.col("s.key") == F.col("o.key")) & apart & (_first_way() == F.shiftright(F.col("s.key"), KIND))).select(F.col("root").alias("a"), F.col("other_root").alias("b"))
    second = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    hot = hot_values(own.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    return dealt_join(own, second, ["root"], among("root", hot), F.xxhash64("fp"), "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most four differing bits reach.

    Null and empty texts, and texts of white space, have fingerprint zero, and
    link like any other. Repeated rows stay, each with the same component. Null
    doc_ids are kept; they count for a component only where it has no other.
    """
    rows = fingerprints(docs, words)
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = stored(link_components(nodes).join(nodes, "fp"))
    tops = stored(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_fp = dealt_join(roots.select("fp", "root"), tops.drop("n"), ["root"], among("root", hot_values(tops, "root")), F.xxhash64("fp")).select("fp", "component_id")
    found = dealt_join(rows, of_fp, ["fp"], among("fp", hot_values(nodes, "fp")), F.xxhash64("doc_id", F.spark_partition_id()))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with one document of each component: that of the least doc_id, or if it is repeated there, of the least hashed text. Null doc_ids stay only where a component has no other; of equal rows one stays."""
    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def make():
        def run(x):
            fps = [fingerprint(t, words) for t in x["text"]]
            return {"doc_id": x["doc_id"], "h": x["h"], "fp": [f - (f >> 63 << 64) for f in fps]}

        return run

    rows = stored(by_batch(shown.withColumn("h", F.xxhash64("text")), make, "doc_id long, h long, fp long"))
    nodes = stored(rows.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "h")).alias("least")))
    roots = link_components(nodes)
    kept = roots.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("x")).select(F.coalesce("x.doc_id", F.lit(0)).alias("id"), "x.unnamed", "x.h")
    hot = among("h", hot_values(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h"))
    # columns of the table stand inside a struct, where no name of ours can meet them
    doc = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.isnull("doc_id").alias("unnamed"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    on = ["id", "unnamed", "h"]
    return dealt_join(doc, kept, on, hot, F.spark_partition_id()).dropDuplicates(on).select("row.*")

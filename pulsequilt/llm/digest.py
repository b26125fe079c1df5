"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every window of four bytes gives three triplets, each hashed into one of 128
buckets. The digest holds a logarithmic length, the ratios of the quartiles of
the bucket counts, and for each bucket the quartile it falls in (two bits).
Digests compare by a bounded score; ``likeness`` scales it to 0..1.

Null texts are empty. Texts under four bytes have empty buckets. Equal texts
have equal digests; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, texts

BUCKETS = 128
#: Positions of the triplets in a window of four bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Odd multipliers of the triplets' hash; any would do, they fix the format.
MIX = (2654435761, 2246822519, 3266489917)
PART = 1 << 20
#: A full step in length or in a quartile ratio weighs as many bucket steps.
STEP_WEIGHT, STEPS = 6, 8


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit. Long texts go through in parts that overlap by a window."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 3, 0), PART):
        b = np.frombuffer(data, np.uint8, min(PART + 3, len(data) - at), at).astype(np.uint32)
        n = b.size - 3
        for salt, places in enumerate(TRIPLETS):
            h = np.full(n, salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for place, m in zip(places, MIX, strict=True):
                h += b[place : place + n] * np.uint32(m)
            h ^= h >> np.uint32(15)
            h *= np.uint32(MIX[0])
            total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """Length (two hex digits), two quartile ratios (one each), then two bits a bucket, in hex."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
    length = min(255, round(8 * math.log2(1 + len(data))))
    ratios = [int(16 * q) // int(q3) % 16 if q3 else 0 for q in (q1, q2)]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


def _fields(d: str) -> tuple[int, int, int, np.ndarray]:
    body = np.frombuffer(bytes.fromhex(d[4:]), np.uint8)
    return int(d[:2], 16), int(d[2], 16), int(d[3], 16), (body[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(np.int16)


def difference(x: str, y: str) -> int:
    """0 for equal digests, at most ``MOST``. Opposite quartiles weigh double; length and ratios count up to STEPS steps."""
    (lx, ax, bx, cx), (ly, ay, by, cy) = _fields(x), _fields(y)
    d = np.abs(cx - cy)
    around = lambda p, q: min(abs(p - q), 16 - abs(p - q))
    return int(d.sum() + 3 * (d == 3).sum()) + STEP_WEIGHT * (min(STEPS, abs(lx - ly)) + around(ax, ay) + around(bx, by))


MOST = 6 * BUCKETS + 3 * STEP_WEIGHT * STEPS


def likeness(x: str, y: str) -> float:
    return 1.0 - difference(x, y) / MOST


def edited(text: str, after: str) -> str:
    """text with its last third replaced by as many code points from the start of the text after it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Digests of every text and of its edited form, compared with each other and with the next text's.

    The next text is the one with the next smaller doc_id; after the last comes
    the first. Ties in doc_id go by the text; null ids come last. One shuffle
    deals the texts into ranges of doc_id; each task streams its range, and the
    last row of a range meets the first of the following range in a second,
    small step (two rows a range).
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = (F.col("doc_id").desc_nulls_last(), F.col("text"))
    ranges = texts(docs).repartitionByRange(order[0]).sortWithinPartitions(*order)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema([*zip(names, kinds, strict=True), ("part", pa.int64()), ("edge", pa.string()), ("edge_text", pa.string())])

    def full(doc_id, text, mark, after, after_mark) -> list:
        e = edited(text, after).encode()
        f = digest(e)
        return [doc_id, len(text), hashlib.sha256(e).hexdigest(), mark, f, likeness(mark, f), likeness(mark, after_mark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        empty = [None] * 4
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = digest(text.encode())
                if last is None:
                    rows.append([doc_id, None, None, mark, *empty[:3], part, "first", text])
                else:
                    rows.append([*full(*last, text, mark), part, None, None])
                last = doc_id, text, mark
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [last[0], None, None, last[2], *empty[:3], part, "last", last[1]], strict=True))], schema)

    dealt = stored(ranges.mapInArrow(run, f"{FIELDS}, part long, edge string, edge_text string"))

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [full(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)

    # Two rows a range: the parts are numbered anew without gaps, and each last row is joined to the following part's first.
    first = dealt.where("edge = 'first'").select("part", F.col("edge_text").alias("after"), F.col("fingerprint").alias("after_mark"))
    last = dealt.where("edge = 'last'").select("part", "doc_id", F.col("edge_text").alias("text"), F.col("fingerprint").alias("mark"))
    parts = sorted(r[0] for r in first.select("part").collect())  # one number for each range, as many as shuffle partitions
    ring = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part long, following long")
    edges = last.join(ring, "part").join(first.withColumnRenamed("part", "following"), "following").select("doc_id", "text", "mark", "after", "after_mark").mapInArrow(join_edges, FIELDS)
    return dealt.where("edge is null").select(*names).unionByName(edges)

"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each its own gzip member, one or more
files a task, in the shared folder; a payload that an earlier page (of smaller
id) has too becomes a revisit record. Capture lines, sorted by reversed-host
URL key and page id, are compressed in blocks of ``BLOCK_LINES``; a sparse
directory keeps each block's first key. A lookup searches the directory, then
the block, in halves each, and reads the record's bytes by range.

Files of lost or repeated tasks stay unread: only what the stored capture
lines name counts. Null urls and payloads are empty; a null page_id is kept
and comes first. Rows that repeat a page_id and its payload are records each;
the read returns each of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, dealt_join, hot_values, made, shared_dir, small_batches, stored

BLOCK_LINES = 256
#: The directory that goes to all tasks has at most so many entries; beyond, each stands for several blocks.
DIRECTORY = 200_000
#: A file is closed and a new one begun at this size.
FILE_BYTES = 1 << 30
#: Records this near in a file are read by one task, and a task reads as much on average.
STRETCH = 4 << 20
LEAST = -(1 << 63)

_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#]*))?([^#]*)")


def url_key(url: str) -> str:
    """The URL's host, lower case and from its last label on, then its path and query; the fragment is dropped and white space is escaped."""
    _, host, path = _URL.match(url).groups()
    host, _, port = (host or "").lower().partition(":")
    key = f"{','.join(reversed(host.split('.')))}{':' + port if port else ''}){path or '/'}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    value = name.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def encode_record(page_id: int | None, url: str, payload: bytes, original: int | None) -> bytes:
    """A gzip member with a response record, or a revisit of ``original``, whose block keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if original is None else head
    lines = [f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if original is not None:
        lines += [f"WARC-Refers-To: {_name(original)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n", 4, mtime=0)


class DamagedRecord(ValueError):
    """A record does not hold what its headers or the index say."""


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise DamagedRecord("no end of headers")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, rest


def decode_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a gzip member; a response's payload is digested anew and compared."""
    raw = gzip.decompress(data)
    if not raw.startswith(b"WARC/1."):
        raise DamagedRecord("no WARC version")
    fields, rest = _headers(raw)
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise DamagedRecord("length of the block")
    http, payload = _headers(rest[:n])
    size, digest, kind = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise DamagedRecord("payload")
    return _id(fields["warc-record-id"]), size, digest, kind, _id(fields["warc-refers-to"]) if kind == "revisit" else None


# ---------------------------------------------------------------- writing


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def write_archive(pages: DataFrame) -> DataFrame:
    """Writes the archive of pages (page_id, url, html); returns its capture lines (key, page_id, file, offset, length) as a stored table."""
    spark = pages.sparkSession
    small_batches(spark)
    root = made(shared_dir(spark) + "-warc")
    rows = _rows(pages).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    ids = stored(rows.select("page_id", "sha1"))
    first = stored(ids.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")))
    hot = among("sha1", hot_values(first, "sha1"))
    again = dealt_join(ids, first.where("n > 1").drop("n"), ["sha1"], hot, F.xxhash64("page_id")).where("page_id <> first").distinct()
    rows = rows.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for page_id, url, html, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    record = encode_record(page_id, url, html.encode(), original)
                    out.write(record)
                    lines.append((url_key(url), page_id, f"{root}/{name}", at, len(record)))
                    at += len(record)
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"))


# ---------------------------------------------------------------- index


def build_index(captures: DataFrame) -> DataFrame:
    """Blocks of sorted capture lines: part, no, first_key, first_id, n, data (compressed lines), as a stored table. The sparse directory is its (first_key, first_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held = TaskContext.get().partitionId(), 0, []

        def block(lines: list[tuple]) -> pa.RecordBatch:
            data = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in x) for x in lines).encode(), 6)
            first = lines[0]
            return pa.RecordBatch.from_pylist([{"part": part, "no": no, "first_key": first[0], "first_id": LEAST if first[1] is None else first[1], "n": len(lines), "data": data}], pa.schema([("part", pa.int64()), ("no", pa.int64()), ("first_key", pa.string()), ("first_id", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                no += 1
                held = held[BLOCK_LINES:]
        if held:
            yield block(held)

    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    lines = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", F.col("page_id").asc_nulls_first()).sortWithinPartitions(*order)
    return stored(lines.mapInArrow(run, "part long, no long, first_key string, first_id long, n long, data binary"))


def locate(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, file, offset, length of all captures of the distinct pairs of wanted (page_id, url)."""
    spark = index.sparkSession
    small_batches(spark)
    n = index.count()
    stride = max(1, -(-n // DIRECTORY))
    directory = index.select("first_key", "first_id", "part", "no")
    if stride > 1:
        directory = directory.where(F.col("no") % stride == 0)
    firsts = sorted(tuple(r) for r in directory.collect())  # bounded by DIRECTORY and the number of parts

    def span(entries: list[tuple], key: tuple) -> range:
        """The entries whose blocks may hold the key: equal lines can begin in the block before the first that starts with them, and go through several."""
        last = bisect_right(entries, (*key, 1 << 62)) - 1
        return range(max(0, bisect_left(entries, key) - 1), last + 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(url_key(url), LEAST if page_id is None else page_id) for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            rows = [(slot, *key) for key in keys for slot in span(firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["slot", "key", "id"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [bisect_right(firsts, x) - 1 for x in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *batch.columns], names=["slot", *batch.schema.names])

    def read(wanted_rows: pa.Table, blocks: pa.Table) -> pa.Table:
        held = sorted(zip(*(blocks.column(c).to_pylist() for c in ("first_key", "first_id", "part", "no", "data")), strict=True), key=lambda x: x[:4])
        tops, open_at, keys, lines, out = [x[:4] for x in held], None, [], [], []
        for key in sorted(set(zip(wanted_rows.column("key").to_pylist(), wanted_rows.column("id").to_pylist(), strict=True))):
            for at in span(tops, key):
                if at != open_at:
                    lines = [x.split("\t") for x in zlib.decompress(held[at][4]).decode().split("\n")]
                    keys = [(x[0], int(x[1]) if x[1] else LEAST) for x in lines]
                    open_at = at
                out += [(None if key[1] == LEAST else key[1], x[2], int(x[3]), int(x[4])) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["page_id", "file", "offset", "length"])

    asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url")).distinct().mapInArrow(find, "slot long, key string, id long")
    blocks = index.select("first_key", "first_id", "part", "no", "data").mapInArrow(place, "slot long, first_key string, first_id long, part long, no long, data binary")
    return asked.groupBy("slot").cogroup(blocks.groupBy("slot")).applyInArrow(read, "page_id long, file string, offset long, length long")


def read_records(located: DataFrame) -> DataFrame:
    """Reads the records at (file, offset, length) by range: page_id, payload_bytes, payload_digest, record_type, refers_to. Raises DamagedRecord if one isn't its page's."""
    small_batches(located.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, file = None, None
        for batch in batches:
            out = []
            for page_id, path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "file", "offset", "length")), strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    store, local = fs.FileSystem.from_uri(path)
                    name, file = path, store.open_input_file(local)
                file.seek(offset)
                found = decode_record(file.read(length))
                if found[0] != page_id:
                    raise DamagedRecord(f"{path} at {offset} holds another page")
                out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    located = stored(located)
    # as many tasks as the bytes they read ask for, not their pointers
    tasks = 1 + (located.agg(F.sum("length")).first()[0] or 0) // STRETCH
    near = located.withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    dealt = near.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes the archive and its index, looks up every page in it and reads its record back."""
    index = build_index(write_archive(pages))
    return read_records(locate(index, pages))

"""Media columns: lossless PNG in binary columns and low-frequency cosine hashes.

A payload of 8-bit samples becomes a greyscale PNG: signature, IHDR, IDAT
chunks (one zlib stream), IEND, each chunk with its CRC-32. The decoder tests
every checksum and undoes all five row filters with numpy. Pictures live in a
binary column of a Parquet table; features are computed from what is read back.

Null or empty payloads are padded to one full block, so every row has a picture.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import by_batch, stored, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of the picture.
WIDTH = 576
IDAT_BYTES = 1 << 20


class DamagedPicture(ValueError):
    """A checksum, a length or a filter type is wrong."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """A greyscale PNG of uint8[height, width]. Rows like the one above are stored as differences (Up), constant rows too (Sub), all others as they are."""
    height, width = samples.shape
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = 0, samples
    same = np.zeros(height, bool)
    same[1:] = (samples[1:] == samples[:-1]).all(axis=1)
    flat = (samples == samples[:, :1]).all(axis=1) & ~same
    rows[same, 0], rows[same, 1:] = 2, 0
    rows[flat, 0], rows[flat, 2:] = 1, 0
    packed = zlib.compress(rows.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _paeth(row: np.ndarray, up: np.ndarray) -> None:
    left = corner = 0
    above = up.tolist()
    out = row.tolist()
    for i, x in enumerate(out):
        b = above[i]
        p = left + b - corner
        da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
        out[i] = left = (x + (left if da <= db and da <= dc else b if db <= dc else corner)) & 255
        corner = b
    row[:] = out


def _average(row: np.ndarray, up: np.ndarray) -> None:
    left, above, out = 0, up.tolist(), row.tolist()
    for i, x in enumerate(out):
        out[i] = left = (x + ((left + above[i]) >> 1)) & 255
    row[:] = out


def unfilter(rows: np.ndarray) -> np.ndarray:
    """uint8[height, width] of filtered rows with their filter types in column 0."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise DamagedPicture("filter type")
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    zero = np.zeros(out.shape[1], np.uint8)
    for i in np.flatnonzero(kinds > 1):
        above = out[i - 1] if i else zero
        if kinds[i] == 2:
            out[i] += above
        else:
            (_average if kinds[i] == 3 else _paeth)(out[i], above)
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing; raises DamagedPicture at a wrong checksum or length."""
    if data[:8] != SIGNATURE:
        raise DamagedPicture("signature")
    at, packed, size, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise DamagedPicture("chunk checksum")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise DamagedPicture("only 8-bit greyscale is stored here")
            size = height, width
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or size is None:
        raise DamagedPicture("chunks end too soon")
    try:
        raw = zlib.decompress(b"".join(packed))  # tests the Adler-32 checksum
    except zlib.error as e:
        raise DamagedPicture(str(e)) from e
    if len(raw) != size[0] * (size[1] + 1):
        raise DamagedPicture("length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


@lru_cache
def _cosines(low: int, n: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def _shrunk(samples: np.ndarray, n: int) -> np.ndarray:
    """Means over an n by n grid of equal areas (cells may share samples at their edges)."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        size = out.shape[axis]
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        edges = np.linspace(0, size, n + 1)
        low = np.minimum(edges.astype(int), size - 1)
        part = (edges - low).reshape([-1, 1] if axis == 0 else [1, -1])
        at = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
        out = np.diff(at, axis=axis) * (n / size)
    return out


def cosine_hash(samples: np.ndarray, grid: int = 32, low: int = 8) -> str:
    """64 bits in hex: which of the low-frequency coefficients of the shrunk picture are above their median (the constant one left out of it)."""
    c = _cosines(low, grid)
    f = np.round(c @ _shrunk(samples, grid) @ c.T, 6).ravel()
    return np.packbits(f > np.median(f[1:])).tobytes().hex()


def padded(data: bytes, block: int = WIDTH) -> bytes:
    """data and bytes 255 up to a positive multiple of block."""
    return data + b"\xff" * (-len(data) % block if data else block)


def media_table(docs: DataFrame, *, block: int = WIDTH, level: int = 3) -> DataFrame:
    """doc_id, n_bytes, media (PNG, binary) of every text, as a stored table. Null texts are empty; one row a row."""

    def make():
        def run(x):
            data = [t.encode() for t in x["text"]]
            return {"doc_id": x["doc_id"], "n_bytes": [len(b) for b in data], "media": [encode_png(np.frombuffer(padded(b, block), np.uint8).reshape(-1, block), level) for b in data]}

        return run

    return stored(by_batch(texts(docs), make, "doc_id long, n_bytes long, media binary"))


def media_features(media: DataFrame) -> DataFrame:
    """Reads doc_id, n_bytes, media and returns sizes, digests of the payload and of the stored form, and the cosine hash. A damaged picture stops the job."""

    def make():
        def run(x):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stored_bytes in x["media"]:
                samples = decode_png(stored_bytes)
                payload = samples.tobytes()
                for k, v in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-32:])), ("media_bytes", len(stored_bytes)), ("media_sha256", hashlib.sha256(stored_bytes).hexdigest()), ("feature", cosine_hash(samples))):
                    out[k].append(v)
            return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], **out}

        return run

    return by_batch(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

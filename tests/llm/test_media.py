import hashlib
import zlib

import numpy as np
import pytest

from pulsequilt.llm import media


def test_query_against_hand_made_values(spark, awkward):
    got = media.media_features(media.media_table(awkward)).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "").encode()) for r in awkward.collect())
    assert len(got) == len(want)
    for r, (_, data) in zip(sorted(got, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_bytes)), want, strict=True):
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({r.feature for r in got if r.doc_id in (4, 5)}) == 1


def test_empty_table(no_documents):
    assert media.media_features(media.media_table(no_documents)).count() == 0


def test_all_filters_are_undone():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (10, 33), np.uint8)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]

    def paeth(a, b, c):
        p = int(a) + int(b) - int(c)
        d = [abs(p - int(v)) for v in (a, b, c)]
        return (a, b, c)[d.index(min(d))]

    for kind in range(5):
        guess = [np.zeros_like(x), left, up, ((left.astype(int) + up) // 2).astype(np.uint8), np.vectorize(paeth)(left, up, corner).astype(np.uint8)][kind]
        rows = np.concatenate([np.full((10, 1), kind, np.uint8), x - guess], axis=1)
        assert (media.unfilter(rows) == x).all(), kind


def test_damage_is_noticed():
    png = media.encode_png(np.arange(576 * 3, dtype=np.uint8).reshape(3, 576))
    assert (media.decode_png(png) == np.arange(576 * 3, dtype=np.uint8).reshape(3, 576)).all()
    for at in (0, 20, len(png) // 2, len(png) - 5):
        with pytest.raises(media.DamagedPicture):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(media.DamagedPicture):
        media.decode_png(png[:-12])


def test_constant_and_repeated_rows_come_back():
    x = np.full((5, 576), 255, np.uint8)
    x[2] = 7
    assert (media.decode_png(media.encode_png(x)) == x).all()

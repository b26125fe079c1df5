import hashlib

from pulsequilt.llm import digest

SF = "/root/testdata/sf0.001"


def check(docs):
    got = {r.doc_id: r for r in digest.fingerprint_neighbours(docs).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        e = text[: len(text) - n] + nxt[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest.digest(text.encode()), digest.digest(e.encode()))
        assert r.near_edited == digest.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == digest.likeness(r.fingerprint, digest.digest(nxt.encode()))
        assert 0 <= r.near_next <= 1
    return got


def test_whole_table_against_a_loop(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet")).values()
    edited, other = sorted(r.near_edited for r in got), sorted(r.near_next for r in got)
    assert edited[len(edited) // 10] > other[len(other) // 2]


def test_awkward_rows(spark, awkward, no_documents):
    check(awkward.where("doc_id is not null and doc_id <> 5").repartition(3))
    assert digest.fingerprint_neighbours(awkward).count() == awkward.count()
    assert digest.fingerprint_neighbours(no_documents).count() == 0
    one = check(spark.createDataFrame([(1, "only one text here")], "doc_id long, text string"))
    assert one[1].near_next == 1.0


def test_score_is_bounded_and_symmetric():
    texts = [b"", b"abc", b"hello world " * 50, bytes(range(256)) * 20, b"x" * 5000]
    marks = [digest.digest(t) for t in texts]
    for a in marks:
        assert digest.likeness(a, a) == 1.0
        for b in marks:
            assert digest.difference(a, b) == digest.difference(b, a) <= digest.MOST


def test_long_texts_in_parts_count_alike(monkeypatch):
    data = bytes(range(256)) * 40
    whole = digest.bucket_counts(data)
    monkeypatch.setattr(digest, "PART", 1000)
    assert (digest.bucket_counts(data) == whole).all()

import base64
import gzip
import hashlib

import pytest

from pulsequilt.llm import warc

SF = "/root/testdata/sf0.001"


def check(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, data in rows:
        if i is not None:
            first[data] = min(first.get(data, i), i)
    want = []
    for i, data in rows:
        again = i is not None and first[data] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    got = [tuple(r) for r in warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/pages.parquet"))


def test_awkward_pages(spark):
    rows = [(1, "http://a.org/", "x"), (2, "http://b.org/", "x"), (3, None, None), (4, "", ""), (5, "http://a.org/", "y\r\n\r\nz"), (5, "http://a.org/", "other"), (6, "http://a.org/a b\tc\nd", "é" * 10000), (None, "http://n.org", "null id"), (7, "no url", "x"), (8, "HTTP://User@A.Org:8080/P?q=1#f", "WARC/1.1\r\n")]
    rows += [(100 + k, "http://hot.example.com/", "same payload") for k in range(700)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, offset int, key string")
    check(df.repartition(4))
    check(df.where("false"))


def test_a_repeated_row_is_read_back_twice(spark):
    check(spark.createDataFrame([(1, "http://a.org", "x"), (1, "http://a.org", "x"), (2, "http://a.org", "x")], "page_id long, url string, html string"))


@pytest.mark.parametrize("directory", [200_000, 3])
def test_repeated_rows_over_a_block_bound_are_all_read(spark, monkeypatch, directory):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "DIRECTORY", directory)
    rows = [(k, f"http://h.org/{k:03}", f"p{k}") for k in range(40) for _ in range(1 + k % 3)] + [(20, "http://h.org/020", "p20")] * 11
    check(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_lookup_finds_only_what_is_there(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.org/{k}", f"p{k}") for k in range(1500)], "page_id long, url string, html string")
    index = warc.build_index(warc.write_archive(pages))
    assert index.count() >= 1500 // warc.BLOCK_LINES
    asked = spark.createDataFrame([(3, "http://h3.org/3"), (3, "http://h4.org/3"), (9999, "http://h3.org/9999"), (1499, "http://h1.org/1499"), (None, "http://h1.org")], "page_id long, url string")
    assert sorted(r.page_id for r in warc.locate(index, asked).collect()) == [3, 1499]


def test_a_coarse_directory_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "DIRECTORY", 10)
    check(spark.createDataFrame([(k, f"http://h{k % 7}.org/{k}", f"p{k % 90}") for k in range(600)], "page_id long, url string, html string"))


def test_keys_sort_by_reversed_host():
    assert warc.url_key("http://Blog.Example.com/a?b=1#c") == "com,example,blog)/a?b=1"
    assert warc.url_key("https://example.com:8080") == "com,example:8080)/"
    assert warc.url_key("") == ")/"


def test_damage_is_noticed():
    record = warc.encode_record(5, "http://a.org", b"hello", None)
    assert warc.decode_record(record)[0] == 5
    raw = gzip.decompress(record)
    for bad in (raw.replace(b"hello", b"hellx"), raw[:-2], raw.replace(b"WARC/1.1", b"JUNK/1.1")):
        with pytest.raises(warc.DamagedRecord):
            warc.decode_record(gzip.compress(bad))

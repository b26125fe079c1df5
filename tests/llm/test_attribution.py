import numpy as np

from pulsequilt.llm import attribution

SF = "/root/testdata/sf0.001"


def brute(text, rule="most"):
    encoding, _ = attribution.byte_encoding(*attribution.default_tokenizer())
    data = text.encode()
    lines = data.split(b"\n")
    ends, at = [], 0
    for k, x in enumerate(lines):
        at += len(x) + (k < len(lines) - 1)
        ends.append(at)
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    counts, start = [0] * len(ends), 0
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        spans = [max(0, min(start + n, e) - max(start, s)) for s, e in zip([0, *ends], ends)]
        counts[spans.index(max(spans)) if rule == "most" else next(i for i, x in enumerate(spans) if x)] += 1
        start += n
    return counts


def test_counts_against_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in attribution.section_tokens(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        rows = got[d.doc_id]
        assert [r.n_tokens for r in rows] == brute(d.text)
        assert "".join(d.text[r.start : r.end] for r in rows) == d.text


def test_awkward_rows(awkward, no_documents):
    rows = attribution.section_tokens(awkward).collect()
    assert sum(r.section == 0 for r in rows) == awkward.count()
    assert attribution.section_tokens(no_documents).count() == 0
    assert [(r.start, r.end, r.n_tokens) for r in rows if r.doc_id == 1] == [(0, 0, 0)]


def test_rules_at_boundaries():
    tokens, sections = np.array([2, 6, 10]), np.array([4, 5, 10])
    assert attribution.attribute(tokens, sections)[0].tolist() == [0, 0, 2]
    assert attribution.attribute(np.array([4]), np.array([1, 4]))[0].tolist() == [1]
    assert attribution.attribute(np.array([4]), np.array([1, 4]), "first")[0].tolist() == [0]
    assert attribution.attribute(np.array([4]), np.array([2, 4]))[0].tolist() == [0]


def test_crossing_tokens_of_a_text(spark):
    text = "a\n\n\n\nb   \n   c\r\n\r\nd é\né"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for rule in ("most", "first"):
        assert [r.n_tokens for r in attribution.section_tokens(df, rule=rule).orderBy("section").collect()] == brute(text, rule)

from collections import defaultdict

import corpus_pipeline
from pulsequilt.llm import pii
from pulsequilt.llm.common import stored
from test_packing import check
from test_simhash import groups, slow_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, steps = [n for n, _ in corpus_pipeline.STAGES], dict(corpus_pipeline.STAGES)
    assert names == ["language", "near_duplicates", "personal_data", "packing"]
    told = stored(steps["language"](spark, docs, SF))
    assert told.columns == docs.columns and told.count() == docs.count()
    once = stored(steps["near_duplicates"](spark, told, SF))
    want = groups([(r.doc_id, slow_fingerprint(r.text)) for r in told.collect()])
    assert {r.doc_id for r in once.collect()} == set(want.values())
    clean = stored(steps["personal_data"](spark, once, SF))
    before = {r.doc_id: r for r in once.collect()}
    field, touched = pii.trained(), 0
    for r in clean.collect():
        spans = pii.all_spans(before[r.doc_id].text, pii.base_spans(before[r.doc_id].text), field)
        assert r.text == pii.redacted(before[r.doc_id].text, spans)
        assert not pii.base_spans(r.text)
        touched += bool(spans)
    assert clean.columns == docs.columns and touched > 0
    check(clean, 0.01)


def test_run_covers_what_is_kept(spark):
    pieces = corpus_pipeline.run(spark, SF)
    length, total = defaultdict(int), {}
    for p in pieces.collect():
        length[p.doc_id] += p.length
        total[p.doc_id] = p.doc_tokens
    assert dict(length) == total and len(total) > 800


def test_awkward_and_empty_documents_pass_through(spark, awkward, no_documents):
    for docs in (awkward, no_documents):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stored(stage(spark, docs, SF)) if k < 3 else stage(spark, docs, SF)
        docs.count()

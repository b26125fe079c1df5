import hashlib
import random
import re
import time

import pytest

from pulsequilt.llm import pii

SF = "/root/testdata/sf0.01"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = [c for c in m[0] if c in "0123456789"]
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and pii.luhn("".join(d)), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_against_plain_patterns():
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("0123456789..@@aB%+-() \n14") for _ in range(r.randint(0, 40)))
        assert brute(t) == pii.base_spans(t), t


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in pii.digest_spans(pii.find_spans(docs)).collect()}
    for d in docs.collect():
        base, r = brute(d.text), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)


def test_awkward_rows(awkward, no_documents):
    rows = pii.digest_spans(pii.find_spans(awkward)).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[11].spans.count(":") == 6
    assert pii.find_spans(no_documents).count() == 0
    out = pii.redact(awkward)
    assert out.schema == awkward.schema
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[1].text is None
    assert texts[11].text == "call [PHONE] or [EMAIL] from [IP]" and texts[11].n_chars == len(texts[11].text)


@pytest.mark.parametrize("text", ["1 " * 60000, "1.2" * 50000, "a" * 200000, "@" * 100000, "+1 " * 50000, "a.b@" * 30000, "12345 67890 " * 20000], ids=lambda t: t[:6])
def test_long_texts_stay_fast(text):
    pii.all_spans(text, pii.base_spans(text), pii.trained())


def test_held_out_sentences():
    field, hit, wrong, missed = pii.trained(), 0, 0, 0
    for text, truth in pii.sentences(300, seed=123):
        found = {(a, b): k for a, b, k in pii.all_spans(text, pii.base_spans(text), field)}
        hit += sum(truth.get(k) == v for k, v in found.items())
        wrong += sum(truth.get(k) != v for k, v in found.items())
        missed += sum(found.get(k) != v for k, v in truth.items())
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


@pytest.mark.parametrize("address", ["john.smith [at] example.com", "j.doe at mail dot org", "first dot last at x dot com", "anna Dot berg At mail Dot example Dot org", "k.l.m (At) a.b.c.d.e.example.net", "rose AT one DOT two DOT three DOT four DOT five DOT com", "ab.cd [dot] ef [at] 1.example [dot] com"])
def test_spelled_addresses_are_found_whole(address):
    text = f"write (or not) to {address}, thanks"
    assert [text[a:b] for a, b, k in pii.all_spans(text, pii.base_spans(text), pii.trained()) if k == "email"] == [address]


@pytest.mark.parametrize("text", ["a dot " * 30000, "a.b." * 50000, "a at b." * 30000, "a at " + "b." * 60000, "a dot b at c dot " * 15000], ids=lambda t: t[:8])
def test_long_texts_of_spelled_parts_stay_fast(text):
    begun = time.perf_counter()
    pii.all_spans(text, pii.base_spans(text), pii.trained())
    assert time.perf_counter() - begun < 20


def test_dynamic_program_against_all_segmentations():
    field = pii.trained()
    for text, _ in pii.sentences(60, seed=5):
        for n, ending in pii.runs(text):
            segments = [s for j in range(n) for s in ending(j)]
            if not segments or n > 9:
                continue
            scores = field.scores(segments)

            def best(at):
                if at >= n:
                    return 0.0
                return max([best(at + 1)] + [scores[k].max() + best(s.last + 1) for k, s in enumerate(segments) if s.first == at])

            chosen = {(a, b) for a, b, _ in field.best(n, ending)}
            got = sum(scores[k].max() for k, s in enumerate(segments) if (s.start, s.end) in chosen)
            assert abs(got - best(0)) < 1e-6

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsequilt.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def check(docs, most_padding):
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces = packing.pack(docs, PATH).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    assert of_doc.keys() == want.keys()
    for i, ids in want.items():
        if len(ids) == 1:  # of repeated ids only the total is looked at
            at = 0
            for p in sorted(of_doc[i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, ids[0].size)
                assert p.ids_crc32 == zlib.crc32(ids[0][at : at + p.length].tobytes())
                at += p.length
            assert at == ids[0].size
        else:
            assert sum(p.length for p in of_doc[i]) == sum(x.size for x in ids)
    padding = 0
    for s in of_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.SEQUENCE
        padding += packing.SEQUENCE - at if at & (at - 1) else 0
    total = sum(x.size for v in want.values() for x in v)
    assert padding <= most_padding * total
    return pieces


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), 0.01)


def test_awkward_rows(awkward, no_documents):
    check(awkward, 1.0)
    assert packing.pack(no_documents, PATH).count() == 0


def test_equal_awkward_lengths_leave_no_padding(spark):
    """A third of all rows has the same length, of which two don't fit into a sequence."""
    rows = [(k, "word " * (2500 if k % 3 == 0 else 5 + 13 * k % 900)) for k in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 0.01)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=16))
def test_patterns_hold_every_piece_once(counts):
    demand = np.zeros(17, np.int64)
    demand[1 : 1 + len(counts)] = counts
    patterns = packing.whole_patterns(demand, 16)
    held = sum((m * p for m, p in patterns), np.zeros(17, np.int64))
    assert (held == demand).all()
    weights = np.arange(17)
    assert all((p * weights).sum() <= 16 for _, p in patterns)
    least = -(-int((demand * weights).sum()) // 16)
    bins = sum(m for m, _ in patterns)
    assert least <= bins <= 1.25 * least + 18


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(20):
        price = np.concatenate([[0], rng.random(7)])
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [best[c - w] + price[w] for w in range(1, 8) if w <= c])
        value, counts = packing.best_pattern(price, 12)
        assert abs(value - best[12]) < 1e-9 and abs((counts * price).sum() - value) < 1e-9


def test_places_fill_patterns():
    patterns = [(2, np.array([0, 2, 0, 1])), (1, np.array([0, 1, 1, 0]))]
    p = packing.Places(patterns)
    assert p.of(np.array([1] * 5), np.arange(5)).tolist() == [0, 0, 1, 1, 2]
    assert p.of(np.array([3, 3, 2]), np.array([0, 1, 0])).tolist() == [0, 1, 2]


def test_word_ids_are_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    texts = ["", "a.b. C, d,, e.,", "don't I'll we've", "İ, é. ß ﬁ 日本, x\x1cy　z", "<|endoftext|> a<|startoftext|>b", *(" ".join(f"w{k}x{j}," for j in range(30)) for k in range(20))]
    for part in (texts, texts[:3], texts[::-1]):
        for x, ids in zip(part, packing.word_ids(part, PATH, 50), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids

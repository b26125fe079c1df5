import functools
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pulsequilt.llm import pieces
from pulsequilt.llm.queries import op5_piece_lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def unpacked(b):
    return list(struct.unpack(f"<{len(b) // 4}i", b))


def test_ids_are_the_librarys_and_decode_to_the_text(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect():
        assert unpacked(r.ids) == model.encode(r.text), r.doc_id
        assert r.decoded == r.text


def test_a_large_file_is_cut_into_slices_of_bounded_units(spark, tmp_path, monkeypatch):
    path, root = str(tmp_path / "one"), tmp_path / "shared"
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    assert pieces.read_in_place(docs) and not pieces.read_in_place(docs.repartition(2))
    monkeypatch.setattr(pieces, "GATHERED", 1000)
    monkeypatch.setattr(pieces, "SLICE_UNITS", 1000)
    monkeypatch.setattr(pieces, "shared_dir", lambda _: str(root / "x"))
    monkeypatch.setattr(pieces, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50"))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = pieces.encode(docs, PATH).collect()
    assert len(rows) == docs.count()
    assert all(unpacked(r.ids) == model.encode(r.text) for r in rows)
    assert spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold") == "128"
    tables = [spark.read.parquet(str(d)).count() for d in root.glob("x-units/file=*/*") if d.is_dir()]
    whole = spark.read.parquet(str(root / "x-units")).select("unit").distinct().count()
    assert len(tables) > 1 and max(tables) < whole


def test_awkward_texts(awkward, no_documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = pieces.decode(pieces.encode(awkward, PATH), PATH).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert unpacked(r.ids) == model.encode(r.text), r.doc_id
        assert r.decoded == r.text
    assert pieces.encode(no_documents, PATH).count() == 0


def test_symbols_spaces_and_unknown_characters(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["Hello  world\n x\ty  ", " a", "    ", "²²..;x²y", "a_b__c", "12345 1²3", "💥💥 ok", "don't;{}()[]=>", "\x00\x01", "αβγ δ", "a ", "▁a b", "a ▁b c", "'''\"\"\"", "ſ", "éé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect():
        assert unpacked(r.ids) == model.encode(r.text), r.text
        assert r.decoded == r.text.replace("▁", " ")  # ids do not tell the mark from a space


def test_odd_pieces_take_more_than_one_pass(spark):
    vocab = pieces.Vocabulary(("a", "b", "c", "d", "bc", "abcd", "ab", "cd", "abc"), (0.0, 0, 0, 0, -1, -2, -3, -3, -4), frozenset(), 100)
    assert {p for p, _, odd in pieces.ranked(vocab) if odd} == {"abcd", "ab", "cd"}  # "abcd" comes only after "abc"; "ab" and "cd" tie
    units = ["abcd", "abc", "bcd", "aabcd", "cdab", "abcdabcd", "dcba"]
    got = {r.unit: list(r.ids) for r in pieces.unit_ids(spark.createDataFrame([(u,) for u in units], "unit string"), vocab).collect()}
    for u in units:
        assert got[u] == pieces.merged_in_python(u, vocab, vocab.ids), u


def test_python_queue_equals_the_fold(spark):
    vocab = pieces.vocabulary(PATH)
    units = ["▁" * 16, "▁" * 17 + "a", "▁" * 33, "💥", "💥é", "x" * 61, "▁international", "xx", "▁▁▁▁▁a", "aaaaaaaa", "▁the", "qzqzqzq", "ééé", "))))))))", "abcabcabcabcabc"]
    got = {r.unit: list(r.ids) for r in pieces.unit_ids(spark.createDataFrame([(u,) for u in units], "unit string"), vocab).collect()}
    for u, ids in got.items():
        assert ids == pieces.merged_in_python(u, vocab, vocab.ids)


def brute_viterbi(unit, table, unknown):
    best = [(0.0, [0])]
    for e in range(1, len(unit) + 1):
        found = [(best[s][0] + table[unit[s:e]], -s, best[s][1] + [e]) for s in range(e) if unit[s:e] in table]
        if unit[e - 1 : e] not in table:
            found.append((best[e - 1][0] + unknown, -(e - 1), best[e - 1][1] + [e]))
        score, _, path = max(found)
        best.append((score, path))
    return best[-1][1]


def test_viterbi_fold_finds_the_best_path(spark):
    table = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -6.0, "c": -3.0, "bc": -3.2, "ca": -1.5}
    vocab = pieces.Vocabulary(tuple(table), tuple(table.values()), frozenset(), 100)
    units = ["abcabc", "aabbcc", "cab", "abxab", "bcbca", "a"]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r.unit: list(r.ids) for r in pieces.unit_ids(df, vocab, fold="viterbi", unknown=-10.0).collect()}
    for u in units:
        at = brute_viterbi(u, table, -10.0)
        ids = []
        for s, e in zip(at, at[1:]):
            ids += [vocab.pieces.index(u[s:e])] if u[s:e] in table else [100 + b for b in u[s:e].encode()]
        assert got[u] == ids, u


@pytest.mark.parametrize("pattern_text", ["▁the▁²²..", "▁▁▁", "ab12_cd"])
def test_units_tile_texts(pattern_text):
    import re

    vocab = pieces.vocabulary(PATH)
    assert "".join(re.findall(pieces.unit_pattern(vocab), pattern_text)) == pattern_text


def test_query_over_the_whole_table(spark):
    got = op5_piece_lattice(spark, SF)
    assert got.where(~F.col("round_trip")).count() == 0
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_long_units_of_the_viterbi_fold_take_the_best_path(spark):
    vocab = pieces.Vocabulary(("<0>", "a", "b", "ab", "ba", "aab"), (0.0, -2.0, -2.5, -3.0, -3.25, -3.5), frozenset({0}), 1000)
    unit = "aabab" * 13 + "b"

    @functools.cache
    def best(at):
        return max((vocab.scores[i] + best(at + len(p)) for p, i in vocab.ids.items() if unit.startswith(p, at)), default=0.0)

    [row] = pieces.unit_ids(spark.createDataFrame([(unit,)], "unit string"), vocab, fold="viterbi").collect()
    assert len(unit) > pieces.LONGEST_UNIT and "".join(vocab.pieces[i] for i in row.ids) == unit
    assert abs(sum(vocab.scores[i] for i in row.ids) - best(0)) < 1e-9

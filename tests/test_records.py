import contextlib
import io
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import escape_token, unescape_token
from pulsequilt.operators import leads
from pulsequilt.operators import records as D
from pulsequilt.operators import rhythm as R
from pulsequilt.operators.leads import agreement


def test_absence_has_one_default_and_the_rest_as_exceptions(spark):
    rows = [(1, "f", 5, None), (1, "f", None, "b"), (1, "f", None, "a"), (1, "g", None, "a"), (1, "g", None, "a"), (1, "h", 3, None)]
    got = {r.field: r for r in D.absence(spark.createDataFrame(rows, "record_id long, field string, value long, reason string")).collect()}
    assert (got["f"].default_reason, got["f"].n_exceptions, got["f"].whole) == ("a", 1, False)
    assert (got["g"].default_reason, got["g"].n_exceptions, got["g"].whole) == ("a", 0, True)
    assert (got["h"].default_reason, got["h"].n_missing) == (None, 0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=8), min_size=1, max_size=20))
def test_pointer_tokens_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(unescape_token(escape_token(F.col("t")))).collect()] == texts


def test_malformed_tokens_and_addresses_are_null(spark):
    df = spark.createDataFrame([("~2",), ("~",), ("a~01",)], "t string")
    assert [r[0] for r in df.select(unescape_token(F.col("t"))).collect()] == [None, None, "a~1"]
    df = spark.createDataFrame([("ecg-record:r@1.0.0#/a/b~1c",), ("ecg-record:r@1.0#/a",), ("x",), ("ecg-record:r@1.0.0#",)], "t string")
    got = [r[0] for r in df.select(D.parse_address(F.col("t"))).collect()]
    assert got[0].pointer == "/a/b~1c" and got[1] is None and got[2] is None and got[3].pointer == ""


def test_mobitz_types(spark):
    rows = [(1, 150.0, 170.0, None, None), (2, 160.0, 165.0, 158.0, None), (3, None, 160.0, None, None), (4, 100.0, 105.0, 180.0, None)]
    df = spark.createDataFrame(rows, "k long, before2 double, before1 double, after1 double, after2 double")
    assert {r.k: r.av_block for r in R.second_degree_type(df).collect()} == {1: "mobitz_i", 2: "mobitz_ii", 3: "second_degree_av_block", 4: "second_degree_av_block"}


def test_fibrillation_branches(spark):
    rows = [("af", 0.2, 0.3, None, 0.2, False, 0.0), ("flutter", 0.05, 0.9, None, 0.9, True, 0.8), ("indeterminate", 0.1, 0.2, None, 0.2, False, 0.0), ("none", 0.02, 0.95, None, 0.2, False, 0.0), ("af", 0.2, 0.7, 30.0, 0.2, False, 0.0), ("none", 0.2, 0.7, 10.0, 0.2, False, 0.0), ("none", None, 0.2, None, 0.2, None, None)]
    df = spark.createDataFrame(rows, "want string, rr_cv double, organized_p_ratio double, pr_dispersion_ms double, repetitiveness double, flutter_consensus boolean, flutter_confidence double")
    assert all(r.want == r.verdict for r in R.fibrillation(df).collect())


def test_empty_tables_give_empty_results(spark):
    beats = spark.createDataFrame([], "record_id long, beat_id long, kind string, rr_prev double, rr_next double, us long, mark long")
    for f in (R.heart_rate, R.time_domain, R.interval_entropy, R.robust_profile, R.pauses, R.escape_or_interpolated, R.longest_runs):
        assert f(beats).count() == 0


def test_peaks_match_one_to_one_in_order(spark):
    r = random.Random(4)
    xs = {(0, 0.0), (0, 10.0), (2, 5.0)} | {(1, float(r.randint(0, 400))) for _ in range(120)}
    ys = {(0, 9.0), (0, 11.0), (3, 5.0)} | {(1, float(r.randint(0, 400))) for _ in range(120)}
    want = {}
    for k in range(4):
        free, want[k] = sorted(y for i, y in ys if i == k), 0
        for x in sorted(x for i, x in xs if i == k):
            if near := [(abs(y - x), y) for y in free if abs(y - x) <= 10]:
                free.remove(min(near)[1])
                want[k] += 1
    got = {row.record_id: row for row in agreement(spark.createDataFrame(sorted(xs), "record_id long, x double"), spark.createDataFrame(sorted(ys), "record_id long, y double"), 10.0).collect()}
    assert {k: row.matched for k, row in got.items()} == want and want[0] == 2
    assert (got[0].precision, got[0].recall, got[0].f1) == (1.0, 1.0, 1.0) and got[2].f1 == 0.0


def test_leaves_at_any_depth_by_hand(spark):
    deep = "[" * 400 + "1" + "]" * 400
    rows = [(1, '{"a":{"b":1},"c":[1,{"d~/":null}],"e":{},"f":[],"":"é"}'), (2, "3.5"), (3, "{}"), (4, None), (5, "{no"), (6, deep), (7, '{"k":1,"k":2}')]
    got = {}
    for r in leads.leaves(spark.createDataFrame(rows, "key long, doc string")).collect():
        got.setdefault(r.key, []).append((r.pointer, r.value))
    assert got[1] == [("/a/b", "1"), ("/c/0", "1"), ("/c/1/d~0~1", "null"), ("/e", "{}"), ("/f", "[]"), ("/", '"é"')]
    assert got[2] == [("", "3.5")] and got[3] == [("", "{}")] and got[7] == [("/k", "2")]
    assert got[6] == [("/0" * 400, "1")] and 4 not in got and 5 not in got


def test_cases_by_hand(spark):
    side = lambda rows: spark.createDataFrame(rows, "key string, fs int, window string, doc string")
    before = side([("same", 500, None, '{"a":1,"b":[1,2]}'), ("near", 500, None, '{"a":1.0}'), ("far", 500, None, '{"a":1.0,"t":"x","n":null}'), ("input", 500, None, '{"a":1}'), ("gone", 500, None, "{}"), ("moved", 500, "w", '{"b":[1,2]}')])
    after = side([("same", 500, None, '{"b":[1,2],"a":1}'), ("near", 500, None, '{"a":1.5}'), ("far", 500, None, '{"a":2.0,"t":"y","n":1}'), ("input", 250, "w", '{"a":9}'), ("new", 500, None, "{}"), ("moved", 500, "w", '{"b":[1],"c":{}}')])
    tolerances = spark.createDataFrame([("^/a$", 0.5), ("^/", 0.1)], "pattern string, at_most double")
    # the least tolerance of those that match holds
    got = {r.key: (r.status, r.mismatches, r.changed, r.removed, r.added) for r in leads.compare_cases(before, after, tolerances.where("at_most = 0.5"), ("fs", "window")).collect()}
    assert got == {"same": ("pass", [], 0, 0, 0), "near": ("pass", [], 0, 0, 0), "far": ("diff", [], 3, 0, 0), "input": ("integrity_error", ["fs", "window"], 0, 0, 0), "gone": ("missing", [], 0, 0, 0), "new": ("missing", [], 0, 0, 0), "moved": ("diff", [], 0, 1, 1)}
    assert {r.key: r.status for r in leads.compare_cases(before, after, tolerances, ("fs", "window")).collect()}["near"] == "diff"


def test_cases_keep_repeated_and_odd_ones(spark):
    side = lambda rows: spark.createDataFrame(rows, "key string, fs int, doc string")
    before = side([("twice", 500, '{"a":1,"b":1}')] * 2 + [("mixed", 500, '{"a":1}'), ("mixed", 250, '{"a":1}'), ("other", 250, '{"a":1}'), ("none", 500, None), ("both none", 500, None), ("bad", 500, "{no"), ("some", 500, '{"a":1,"b":2}'), ("some", 500, '{"a":1}'), (None, 500, "{}"), ("gone", 500, None), ("gone", 500, None)])
    after = side([("twice", 500, '{"a":2,"c":1}')] * 2 + [("mixed", 500, '{"a":2}'), ("other", 500, '{"a":2}'), ("none", 500, '{"a":1}'), ("both none", 500, None), ("bad", 500, ""), ("some", 500, '{"a":1,"b":2}'), (None, 500, "{}")])
    tolerances = spark.createDataFrame([("^/none", 1.0), (None, 9.0), ("^/a", None)], "pattern string, at_most double")
    got = {}
    for r in leads.compare_cases(before, after, tolerances, ("fs",)).collect():
        got.setdefault(r.key, []).append((r.status, r.mismatches, r.changed, r.removed, r.added))
    assert got.pop("twice") == [("diff", [], 1, 1, 1)] * 16  # every pair of rows, for every pair
    assert sorted(got.pop("mixed")) == [("diff", [], 1, 0, 0)] * 2 + [("integrity_error", ["fs"], 1, 0, 0)] * 2
    assert got.pop("some") == [("pass", [], 0, 0, 0)] * 4  # a leaf that one of two equal ids has is there
    assert got.pop(None) == got.pop("gone") == [("missing", [], 0, 0, 0)] * 2
    assert got == {"other": [("integrity_error", ["fs"], 0, 0, 0)], "none": [("diff", [], 0, 0, 1)], "both none": [("pass", [], 0, 0, 0)], "bad": [("pass", [], 0, 0, 0)]}
    assert leads.compare_cases(before, after, tolerances.where("false"), ("fs",)).where("status = 'diff'").count() == 19


def test_cases_deal_documents_once_and_no_leaves(spark):
    """The leaves of both sides are held against each other where the documents lie (before: two shuffles of all leaves, one of those apart, two of documents)."""
    x = spark.range(20).select(F.col("id").alias("key"), F.lit(500).alias("fs"), F.format_string('{"a":%d}', "id").alias("doc"))
    tolerances = spark.createDataFrame([("^/a$", 0.5)], "pattern string, at_most double")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        leads.compare_cases(x, x.where("key > 3"), tolerances, ("fs",)).explain()
    dealt = [line for line in out.getvalue().splitlines() if "Exchange hashpartitioning" in line]
    assert 0 < len(dealt) <= 9 and not any("pointer" in line for line in dealt)
    assert "SortMergeJoin" in out.getvalue() and "MapInArrow" in out.getvalue()


def test_leaves_keep_what_stands_beside_them(spark):
    rows = [(1, 0, '{"a":[1,2]}'), (2, 1, None), (None, 1, '"x"')]
    got = [tuple(r) for r in leads.leaves(spark.createDataFrame(rows, "key long, side int, doc string").coalesce(1), "side").collect()]
    assert got == [(1, 0, "/a/0", "1"), (1, 0, "/a/1", "2"), (None, 1, "", '"x"')]


def test_null_peaks_match_nothing(spark):
    a = spark.createDataFrame([(1, 5.0), (1, None), (2, None)], "record_id long, x double")
    b = spark.createDataFrame([(1, None), (1, 6.0), (1, 4.0), (1, 4.0)], "record_id long, y double")
    assert [tuple(r) for r in leads.one_to_one(a, b, 2.0).collect()] == [(1, 5.0, 4.0, 1.0)]


def test_pr_cores_by_hand(spark):
    rows = [(1, k, pr, 0.9, False) for k, pr in enumerate([150.0, 152.0, 154.0, 190.0, 192.0])]
    rows += [(2, k, pr, 0.9, None) for k, pr in enumerate([150.0, 160.0, 170.0, 180.0, 190.0])]
    rows += [(3, 0, 150.0, 0.9, False), (3, 0, 160.0, 0.5, False), (3, 0, 100.0, 0.9, False), (3, 1, 170.0, 0.9, False), (3, 2, 180.0, 0.4, False), (3, 3, 200.0, 0.9, True), (3, 4, 200.0, None, False)]
    rows += [(4, 0, 150.0, 0.9, False), (5, 0, 150.0, float("nan"), False)]
    rows += [(6, k, pr, 0.9, False) for k, pr in enumerate([130.0, 150.0, 170.0, 190.0, 210.0])]  # equal gaps: none stands out
    got = {r.record_id: (r.n_beats, r.split, r.pr_ms) for r in leads.pr_beat_core(spark.createDataFrame(rows, "record_id long, beat_id long, pr double, conf double, unreliable boolean")).collect()}
    assert got[1] == (5, True, 153.0) and got[3] == (2, False, 162.5)
    assert got[2][:2] == (5, False) and abs(got[2][2] - 181.2) < 1e-9
    assert got[6][1] is False and set(got) == {1, 2, 3, 6}

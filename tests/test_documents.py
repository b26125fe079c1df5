"""Record documents: hand-made ones against each rule, and dense cells beside them."""

import copy
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import LEADS
from pulsequilt.operators import documents as R
from pulsequilt.plans import documents as P_DOCS
from pulsequilt.sources.adapters import stored


def field(kind="integer", unit="sample", axes=("beat", "lead"), values=None, **more):
    return {"type": kind, "unit": unit, "axes": list(axes), "values": values, "nullable": True, "validation": {"status": "unvalidated", "evidence": []}, "provenance_ref": "/provenance/fields/kernels", **more}


def base():
    fid = {"p_onset": field(values=[[100, None], [None, 610]], absence={"default": {"kind": "unmeasurable", "reason": "low"}, "unmeasurable": {"b2|II": "noise"}}), "p_offset": field(values=[[120, 130], [600, 640]])}
    del fid["p_onset"]["absence"]["unmeasurable"]
    groups = {
        "intervals": {"pr_interval_ms": field(unit="ms", values=[[150, 160], [170, 180]])},
        "flags": {"paced": field("boolean", None, ["beat"], [True, False])},
        "global": {"heart_rate_bpm": field("integer", "1/min", [], 60), "qtc_bazett_ms": field("integer", "ms", [], None, absence={"kind": "not_applicable", "reason": "limited"}), "frontal_qrs_axis_deg": field("integer", "deg", [], None, absence={"kind": "not_applicable", "reason": "limited"})},
    }
    return {"schema_version": "1.0.0", "profile": "all", "record_id": "r1", "acquisition": {"sample_rate_hz": 500.0, "sample_count": 1000, "input_mode": "limited", "leads": ["I", "II"], "amplitude_unit": "mV"}, "axes": {"leads": ["I", "II"], "beats": [{"id": "b1", "r_sample": 200}, {"id": "b2", "r_sample": None}]}, "quality": {}, "provenance": {"fields": {"kernels": {"method": "x"}}}, "delineation": {"fiducials": fid}, "measurements": groups, "artifacts": {"raw": None}}


P, G, I = ("delineation", "fiducials", "p_onset"), ("measurements", "global", "heart_rate_bpm"), ("measurements", "intervals", "pr_interval_ms")
SHA = "sha256:" + "0" * 64
#: Where a valid document is changed, into what (... removes), and what is told.
CASES = [
    (("axes",), ..., "record is missing required members"),
    (("record_id",), "a@b", "record_id must be non-empty and free of @ and #"),
    (("record_id",), " ", "record_id must be non-empty and free of @ and #"),
    (("schema_version",), "1.0", "schema_version must use SemVer"),
    (("schema_version",), "2.0.0", "unsupported schema major"),
    (("profile",), "short", "unsupported record profile"),
    (("acquisition", "leads"), ["II", "I"], "acquisition and lead axis disagree"),
    (("acquisition", "sample_rate_hz"), 0, "invalid sample_rate_hz"),
    (("acquisition", "sample_rate_hz"), "500", "invalid sample_rate_hz"),
    (("acquisition", "sample_count"), 10.5, "invalid sample_count"),
    (("acquisition", "amplitude_unit"), "V", "invalid acquisition amplitude unit"),
    (("acquisition", "input_mode"), "standard_12", "standard_12 requires all canonical leads"),
    (("axes", "beats", 1, "id"), "b1", "duplicate beat identity"),
    (("axes", "beats", 1, "id"), "b|2", "invalid beat identity"),
    (("axes", "beats", 0, "r_sample"), 1000, "beat sample outside acquisition"),
    (("axes", "beats", 0, "r_sample"), 1.5, "beat sample outside acquisition"),
    (("axes", "leads"), ["I", "I"], "duplicate lead axis"),
    (("provenance", "schema_version"), "1.0.1", "provenance schema version disagrees"),
    (("measurements", "other"), {}, "unknown measurement group; use extensions"),
    (("measurements", "areas"), [], "group must be an object"),
    ((*P, "unit"), "ms", "expected an integer in the group's unit"),
    ((*P, "unit"), ..., "incomplete field wrapper: unit"),
    ((*P, "type"), "float", "invalid type"),
    ((*P, "axes"), ["lead", "beat"], "invalid axes"),
    ((*P, "values"), [[1, 2]], "beat dimension mismatch"),
    ((*P, "values"), [[1, 2], [3]], "lead dimension mismatch"),
    ((*P, "values", 0, 0), 1000, "sample outside acquisition"),
    ((*P, "values", 0, 0), 121, "p_onset/p_offset: fiducial order violated"),
    ((*P, "values", 0, 0), "100", "cell type mismatch"),
    ((*P, "values", 0, 0), 100.5, "cell type mismatch"),
    ((*P, "nullable"), "yes", "nullable must be boolean"),
    ((*P, "validation", "status"), "great", "invalid validation status"),
    ((*P, "validation", "status"), "validated", "validation claim requires evidence"),
    ((*P, "provenance_ref"), "/elsewhere", "invalid provenance pointer"),
    ((*P, "provenance_ref"), "/provenance/fields/none", "unresolved provenance pointer"),
    ((*P, "absence"), "none", "invalid absence"),
    ((*P, "absence"), {"kind": "unmeasurable", "reason": "low"}, "absence contradicts measured values"),
    ((*P, "absence"), {"kind": "lost", "reason": "low"}, "invalid field absence"),
    ((*P, "absence"), {"lost": {}}, "unknown absence kind"),
    ((*P, "absence", "default"), {"kind": "unmeasurable"}, "invalid default absence"),
    ((*P, "absence"), {"unmeasurable": {"b1|I": "x"}}, "absence coordinate has no null cell"),
    ((*P, "absence"), {"unmeasurable": {"b9|I": "x"}}, "absence coordinate has no null cell"),
    ((*P, "absence"), {"unmeasurable": {"b1|II": ""}}, "invalid reason"),
    ((*P, "absence"), {"unmeasurable": {"b1|II": "x"}, "not_applicable": {"b1|II": "y"}}, "cell has two absence states"),
    ((*P, "absence"), {"unmeasurable": ["b1|II"]}, "absence map must be an object"),
    ((*I, "values", 1, 1), -2, "negative interval"),
    ((*I, "sidecar"), {"array_key": "x"}, "only null dense values may be sidecar-backed"),
    ((*G, "axes"), ["lead"], "global fields cannot have beat or lead axes"),
    ((*G, "unit"), "bpm", "incorrect global unit or type"),
    ((*G, "absence"), {"default": {"kind": "unmeasurable", "reason": "x"}}, "default absence needs axes"),
    (("measurements", "global", "qtc_bazett_ms", "values"), 400, "formal report is not applicable to limited input"),
    (("measurements", "flags", "paced", "values"), [True], "dimension mismatch"),
    (("measurements", "flags", "paced", "values", 0), 1, "cell type mismatch"),
    (("measurements", "flags", "paced", "unit"), "x", "flags require boolean type with no unit"),
    (("measurements", "flags", "paced"), 7, "field must be an object"),
    (("artifacts", "raw"), 7, "artifact must be an object or null"),
    (("artifacts", "raw"), {"uri": "x", "sha256": SHA}, "artifact requires uri and media_type"),
    (("artifacts", "raw"), {"uri": "x", "media_type": "y", "sha256": "0"}, "artifact requires SHA-256 digest"),
]


def changed(path, value):
    doc = copy.deepcopy(base())
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


@pytest.fixture(scope="module")
def told(spark):
    twelve = base() | {"acquisition": base()["acquisition"] | {"input_mode": "standard_12", "leads": list(LEADS)}, "axes": {"leads": list(LEADS), "beats": []}, "delineation": {"fiducials": {"p_onset": field(values=[])}}, "measurements": {}}
    plain = changed((*P, "nullable"), False)
    del plain["delineation"]["fiducials"]["p_onset"]["absence"]
    claim = changed((*P, "validation"), {"status": "validated", "evidence": ["e1"]})
    rows = [(f"case {k}", json.dumps(changed(p, v))) for k, (p, v, _) in enumerate(CASES)]
    rows += [("valid", json.dumps(base())), ("twelve", json.dumps(twelve)), ("plain", json.dumps(plain)), ("claim", json.dumps(claim)), ("text", "{no json"), ("list", "[1]"), ("null", None), ("empty", "{}")]
    registry = spark.createDataFrame([("/delineation/fiducials/p_onset", "unvalidated"), ("/measurements/intervals/pr_interval_ms", "benchmark_validated")], "pointer string, ceiling string")
    out = {}
    for r in R.violations(spark.createDataFrame(rows, "name string, doc string").repartition(4), registry, key="name").collect():
        out.setdefault(r.name, []).append((r.code, r.pointer, r.message))
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_each_rule(told, k):
    path, _, message = CASES[k]
    assert message in [m for _, _, m in told[f"case {k}"]]
    # a change breaks the rules of its own place (an axis may break those of cells too)
    if path[0] in ("delineation", "measurements") and len(path) > 2:
        assert all(p.startswith(("/" + "/".join(path[:2]), "/artifacts")) for _, p, _ in told[f"case {k}"])


def test_valid_and_unreadable_documents(told):
    assert "valid" not in told and "twelve" not in told
    assert [m for _, _, m in told["plain"]] == ["plain null forbidden"] * 2
    assert sorted(p for _, p, _ in told["plain"]) == ["/delineation/fiducials/p_onset/values/0/1", "/delineation/fiducials/p_onset/values/1/0"]
    assert [c for c, _, _ in told["claim"]] == ["validation_above_registry"]
    assert [c for c, _, _ in told["text"]] == [c for c, _, _ in told["null"]] == ["invalid_record_json"]
    assert [c for c, _, _ in told["list"]] == ["record_not_object"]
    assert [c for c, _, _ in told["empty"]] == ["missing_record_members"]


GROUPS = {"fiducials": ["p_onset"], "amplitudes": ["t_amplitude_uv"]}


@pytest.fixture(scope="module")
def built(spark):
    """Three records: a full one, one with gaps and repeated rows, one without any value."""
    facts = [("r1", b, f"b{b}", 500 * b, k, LEADS[k], 500 * b + k, None, -7 * k if k else None, "flat") for b in range(3) for k in range(2)]
    facts += [("r2", 0, "b0", 0, 0, "I", 5, None, 2**31 - 1, None), ("r2", 1, "b1", 400, 1, "II", None, "noise", -(2**31), None), ("r2", 0, "b0", 0, 0, "I", 9, None, 1, None)]
    facts += [("r3", 0, "b0", None, 0, "I", None, "low", None, None)]
    df = spark.createDataFrame(facts, "record_id string, beat int, beat_id string, r_sample int, lead_no int, lead string, p_onset long, p_onset_why string, t_amplitude_uv long, t_amplitude_uv_why string").repartition(3)
    acquisition = spark.createDataFrame([(r, 500.0, 5000, "limited", "mV") for r in ("r1", "r2", "r3")], "record_id string, sample_rate_hz double, sample_count int, input_mode string, amplitude_unit string")
    return stored(R.documents(df, acquisition, GROUPS))


def test_documents_by_hand(spark, built):
    docs = {r.record_id: json.loads(r.doc) for r in R.as_json(built).collect()}
    assert R.violations(R.as_json(built)).count() == 0
    p, t = (docs["r2"]["delineation"]["fiducials"]["p_onset"], docs["r2"]["measurements"]["amplitudes"]["t_amplitude_uv"])
    assert p["values"] == [[5, None], [None, None]]
    assert p["absence"] == {"default": {"kind": "unmeasurable", "reason": R.NO_REASON}, "unmeasurable": {"b1|II": "noise"}}
    assert t["values"] == [[2**31 - 1, None], [None, -(2**31)]] and t["absence"] == {"default": {"kind": "unmeasurable", "reason": R.NO_REASON}}
    assert docs["r3"]["delineation"]["fiducials"]["p_onset"]["absence"] == {"kind": "unmeasurable", "reason": "low"}
    assert "absence" not in docs["r1"]["delineation"]["fiducials"]["p_onset"]
    assert docs["r1"]["axes"] == {"leads": ["I", "II"], "beats": [{"id": f"b{b}", "r_sample": 500 * b} for b in range(3)]}


def codes(docs, cells):
    return {r.record_id: r.code for r in R.join_dense(docs, cells).collect()}


def test_dense_cells_come_back_or_are_refused(spark, built):
    docs, cells = R.split_dense(built)
    assert R.violations(R.as_json(docs)).count() == 0
    back = R.join_dense(docs, cells)
    assert {r.record_id: r.doc for r in R.as_json(back).collect()} == {r.record_id: r.doc for r in R.as_json(built).collect()}
    data = {(r.record_id, r.pointer): (bytes(r.data), bytes(r.states)) for r in cells.collect()}
    assert data["r2", "/measurements/amplitudes/t_amplitude_uv"] == (bytes.fromhex("ffffff7f" + "00" * 8 + "00000080"), bytes([0, 2, 2, 0]))
    assert len({r.sha256 for r in cells.collect()}) == 3
    assert codes(docs, cells.where("record_id <> 'r1'"))["r1"] == "sidecar_missing"
    changed = cells.withColumn("data", F.when(F.col("record_id") == "r2", F.unhex(F.regexp_replace(F.hex("data"), "^..", "AA"))).otherwise(F.col("data")))
    assert codes(docs, changed) == {"r1": None, "r2": "sidecar_digest", "r3": None}
    assert codes(docs, cells.where("pointer not like '%p_onset'")) == dict.fromkeys(["r1", "r2", "r3"], "sidecar_digest")
    # the document now says other than the states; or names another record's cells
    other = docs.withColumn("doc", F.col("doc").withField("delineation.fiducials.p_onset.absence", F.lit(None).cast(docs.schema["doc"].dataType["delineation"].dataType["fiducials"].dataType["p_onset"].dataType["absence"].dataType)))
    assert codes(other, cells) == {"r1": None, "r2": "sidecar_state", "r3": "sidecar_state"}
    foreign = docs.withColumn("doc", F.col("doc").withField("artifacts.dense_measurements.record_id", F.lit("r1")))
    assert codes(foreign, cells) == {"r1": None, "r2": "sidecar_identity", "r3": "sidecar_identity"}
    lost = R.as_json(docs.withColumn("doc", F.col("doc").withField("artifacts.dense_measurements.fields", F.array(F.lit("/x")))))
    assert {r.code for r in R.violations(lost).collect()} == {"invalid_sidecar"}


def test_cells_beyond_32_bits_are_an_error(spark):
    df = spark.createDataFrame([([2**31],)], "v array<bigint>")
    with pytest.raises(Exception, match="32 bits"):
        df.select(R.int32_bytes(F.col("v"))).collect()
    both = spark.createDataFrame([([0, 1, -1, 2**31 - 1, -(2**31), 258],), ([],)], "v array<bigint>").select("v", R.int32_values(R.int32_bytes(F.col("v"))).alias("w")).collect()
    assert all(r.v == r.w for r in both)


def test_each_level_of_a_document_is_taken_apart_once(spark):
    """A variant taken out of another is a copy of all below it: rules must not take the whole document apart one by one."""
    found = R.violations(spark.createDataFrame([("r1", json.dumps(base()))], "record_id string, doc string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get(v#") <= 8


@pytest.mark.parametrize("values, told", [([[100, -1], [None, 1000]], {"/0/1", "/1/1"}), ([[100, 1.5], [None, 1000]], {"/0/1", "/1/1"}), ([[None, None], [None, None]], set())])
def test_whole_numbers_out_of_range_are_told_among_nulls(spark, values, told):
    d = base()
    d["delineation"]["fiducials"] = {"r_peak": field(values=values)}
    found = R.violations(spark.createDataFrame([("r1", json.dumps(d))], "record_id string, doc string")).collect()
    assert {r["pointer"] for r in found} == {"/delineation/fiducials/r_peak/values" + t for t in told}


def test_cells_are_read_back_from_bytes_and_documents_compared_by_fingerprint(spark):
    x = spark.createDataFrame([([0, 1, -1, 255, -(2**31), 2**31 - 1, 305419896],), ([],)], "v array<long>")
    assert all(r["v"] == r["back"] for r in x.select("v", R.int32_values(R.int32_bytes(F.col("v"))).alias("back")).collect())
    d = spark.createDataFrame([(1, ("a", 1)), (2, ("a", 1)), (3, ("a", 2)), (4, None)], "k int, doc struct<n:string,m:int>")
    one, same, other, none = (r[0] for r in d.orderBy("k").select(R.fingerprint()).collect())
    assert one == same != other and none is None


def test_round_trip_broadcasts_nothing(spark):
    """Cells and fingerprints are rows of every record: a broadcast of them would go through the driver."""
    df = P_DOCS.sidecar_round_trip(spark, "/root/testdata/sf0.001")
    assert df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def plain_base():
    doc = base()
    doc["record_id"] = "r2"
    for n, v in (("qrs_onset", [[140, 150], [620, 650]]), ("r_peak", [[150, 149], [None, 660]]), ("qrs_offset", [[160, 170], [610, 1000]])):
        doc["delineation"]["fiducials"][n] = field(values=v)
    doc["delineation"]["fiducials"]["r_peak"]["absence"] = {"default": {"kind": "unmeasurable", "reason": "low"}, "unmeasurable": {"b2|I": "noise"}}
    doc["measurements"]["intervals"]["qrs_duration_ms"] = field(unit="ms", values=[[40, -40], [None, 0]])
    return doc


def test_plain_fields_break_the_same_rules(spark):
    """A registry without rows leaves every field to the rules: what is told without one is the same, whether fields are taken out of the text before or not."""
    docs = [plain_base()]
    for path, new, _ in CASES:
        doc = plain_base()
        at = doc
        for k in path[:-1]:
            at = at[k]
        if new is ...:
            del at[path[-1]]
        else:
            at[path[-1]] = new
        docs.append(doc)
    texts = [(str(k), json.dumps(d)) for k, d in enumerate(docs)]
    texts += [("nan", texts[0][1].replace("500.0", "NaN")), ("twice", texts[0][1].replace('"nullable": true', '"nullable": true, "nullable": true', 1)), ("one", texts[0][1].replace('"nullable": true', '"nullable": 1')), ("long", texts[0][1].replace("620", str(2**63))), ("real", texts[0][1].replace("620", "620.0")), ("none", None)]
    df = spark.createDataFrame(texts, "record_id string, doc string")
    told = lambda r: sorted(map(tuple, R.violations(df, r).collect()), key=repr)
    assert told(None) == told(spark.createDataFrame([], "pointer string, ceiling string"))
    lean, cells = R.plain_fields(texts[0][1])
    # p_onset stays with p_offset where one of both is not plain; here all are
    assert json.loads(lean)["delineation"]["fiducials"] == {} and json.loads(lean)["measurements"]["intervals"] == {}
    assert {m for _, m in cells} == {"sample outside acquisition", "negative interval", "qrs_onset/r_peak/qrs_offset: fiducial order violated"}
    assert R.plain_fields("no JSON") == ("no JSON", []) and R.plain_fields(None) == (None, [])


def test_absences_by_hand():
    values = pa.array([[1, None, None, None], [None, None], [1], [None, 5, None]], pa.list_(pa.int64()))
    whys = pa.array([[None, "b", "a", None], ["low", "low"], [None], ["low", None, "low"]], pa.list_(pa.string()))
    names = pa.array([["c0", "c1", "c2", "c3"], ["d0", "d1"], ["e0"], ["f0", "f1", "f2"]])
    told = lambda default, reason, named: {"default": default and {"kind": "unmeasurable", "reason": default}, "kind": reason and "unmeasurable", "not_applicable": None, "reason": reason, "unmeasurable": named}
    # of equally frequent reasons the first by name
    assert R.absences(values, whys, names).to_pylist() == [told("a", None, [("c1", "b"), ("c3", R.NO_REASON)]), told(None, "low", None), None, told("low", None, None)]
    assert R.absences(values[2:3], whys[2:3], names[2:3]).to_pylist() == [None]
    assert R.absences(values[:0], whys[:0], names[:0]).to_pylist() == []

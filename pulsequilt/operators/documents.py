"""Record documents: built from tables by keyed aggregation, validated by rules whose violations are rows, dense matrices kept beside them.

``facts``: record_id, beat, beat_id, r_sample, lead_no, lead, and for each field
a whole number and ``<field>_why`` (the reason of a null). A document is one row
by definition; its size is that of one recording.

Documents travel as JSON text, so those of others can be checked too. Null
members are left out of what is written; a field's missing ``values`` counts as
null where the field names a sidecar.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import chain as chained
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from pulsequilt.functions.expressions import LEADS, escape_token, let, spread, unescape_token

#: Fixed values of the document's contract.
VERSION = "1.0.0"
PROFILES = ("summary", "all", "measurement", "debug")
MEMBERS = ("schema_version", "profile", "record_id", "acquisition", "axes", "quality", "provenance", "delineation", "measurements", "artifacts")
ACQUISITION = ("sample_rate_hz", "sample_count", "input_mode", "leads", "amplitude_unit")
FIELD = ("type", "unit", "axes", "values", "nullable", "validation", "provenance_ref")
UNITS = {"fiducials": "sample", "intervals": "ms", "amplitudes": "uV", "areas": "uV_ms"}
GLOBAL_UNITS = {"heart_rate_bpm": "1/min", "frontal_qrs_axis_deg": "deg", "qtc_bazett_ms": "ms", "qrs_wide_ms": "ms"}
STATUSES = ("benchmark_validated", "indirectly_validated", "unvalidated", "validated", "partially_validated")
STATUS_RANK = {"known_problem": 0, "unvalidated": 1, "indirectly_validated": 2, "partially_validated": 2, "benchmark_validated": 3, "validated": 3}
CHAINS = (("p_onset", "p_offset"), ("qrs_onset", "r_peak", "qrs_offset"))
ABSENT = ("unmeasurable", "not_applicable")
#: Codes of a dense cell's state.
STATES = {"measured": 0, "null": 1, "unmeasurable": 2, "not_applicable": 3}
NO_REASON = "measurement_unavailable"
MEDIA_TYPE = "application/x-int32-cells"
CONTRACT, SIDECAR = "invalid_record_contract", "invalid_sidecar"

_VIOLATIONS = "array<struct<code:string,pointer:string,message:string>>"
_MAP = "map<string,variant>"
#: Types of values that are rows of whole numbers and nulls alone.
_DENSE_WHOLE = ("ARRAY<ARRAY<BIGINT>>", "ARRAY<ARRAY<VOID>>")


# ---------------------------------------------------------------- building


def one_a_cell(rows: Column) -> Column:
    """Of a record's sorted cells those that are the least of their beat and lead."""
    return let(rows, lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~(x["beat"].eqNullSafe(F.get(xs, i - 1)["beat"]) & x["lead_no"].eqNullSafe(F.get(xs, i - 1)["lead_no"]))))


def filled(cells: Column, beats: Column, leads: Column) -> Column:
    """A cell for each beat and lead in their order, null where there is none: sorted cells with as many nulls before each as places are free."""
    n = F.size(leads)
    starts, numbers = F.transform(beats, lambda b: b["beat"]), F.transform(leads, lambda x: x["lead_no"])
    place = let(starts, lambda bs: let(numbers, lambda ns: F.transform(cells, lambda c: ((F.array_position(bs, c["beat"]) - 1) * n + F.array_position(ns, c["lead_no"]) - 1).cast("int"))))
    free = lambda k: F.array_repeat(F.lit(None), k.cast("int"))
    apart = lambda at: F.transform(cells, lambda c, i: F.concat(free(F.get(at, i) - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.array(c)))
    return let(place, lambda at: F.concat(F.flatten(apart(at)), free(F.size(beats) * n - 1 - F.element_at(at, -1))))


def absences(values: pa.ListArray, whys: pa.ListArray, names: pa.ListArray) -> pa.StructArray:
    """How each record's dense field says why cells are null: one reason for all of them, or the most frequent reason (ties by name) and the cells that have another; null if no cell is."""
    n, sizes = len(values), values.value_lengths().to_numpy(zero_copy_only=False)
    missing = np.flatnonzero(values.flatten().is_null().to_numpy(zero_copy_only=False))
    record = np.repeat(np.arange(n), sizes)[missing]
    said = pc.fill_null(whys.flatten().take(pa.array(missing)), NO_REASON).dictionary_encode()
    # words in order of their bytes, as Spark compares them
    order = sorted(range(len(said.dictionary)), key=lambda k: said.dictionary[k].as_py().encode()) or [0]
    words = said.dictionary.take(pa.array(order[: len(said.dictionary)], pa.int64()))
    word = np.argsort(order)[said.indices.to_numpy()]
    counts = np.bincount(record * len(order) + word, minlength=n * len(order)).reshape(n, len(order))
    most, some = counts.argmax(1), counts.sum(1) > 0
    whole = some & (counts.sum(1) == sizes) & ((counts > 0).sum(1) == 1)
    other = word != most[record]
    ends = np.concatenate([[0], np.bincount(record[other], minlength=n).cumsum()]).astype("int32")
    # offsets that are null make null maps: cells are named only where reasons differ
    starts = pa.array(ends, mask=np.append(np.diff(ends) == 0, False))
    named = pa.MapArray.from_arrays(starts, names.flatten().take(pa.array(missing[other])), words.take(pa.array(word[other])))
    reason = words.take(pa.array(most, mask=~some))
    kind = pa.array([ABSENT[0]] * n, pa.string())
    only = lambda xs, where: pc.if_else(pa.array(where), xs, pa.scalar(None, pa.string()))
    default = pa.StructArray.from_arrays([kind, reason], ["kind", "reason"], mask=pa.array(~some | whole))
    none = pa.nulls(n, pa.map_(pa.string(), pa.string()))
    return pa.StructArray.from_arrays([default, only(kind, whole), none, only(reason, whole), named], ["default", "kind", "not_applicable", "reason", "unmeasurable"], mask=pa.array(~some))


_ABSENCE = "struct<default:struct<kind:string,reason:string>,kind:string,not_applicable:map<string,string>,reason:string,unmeasurable:map<string,string>>"


def _with_fields(one: DataFrame, names: list[str]) -> DataFrame:
    """The columns of one but its cells and coordinates, and values_k and absence_k of each field: a row of numbers and nulls a beat, and why cells are null. Written in Arrow batches, since lambdas over each cell are what took the time."""
    kept = [c for c in one.columns if c not in ("cells", "coordinates")]
    cells = F.col("cells")
    flat = one.select(*kept, "coordinates", *(cells.getField(f).cast("array<bigint>").alias(f"v{k}") for k, f in enumerate(names)), *(cells.getField(f"{f}_why").alias(f"w{k}") for k, f in enumerate(names)))
    made = {f"values_{k}": "array<array<bigint>>" for k in range(len(names))} | {f"absence_{k}": _ABSENCE for k in range(len(names))}
    kinds = StructType([*one.select(*kept).schema.fields, *one.select(*(F.lit(None).cast(kind).alias(c) for c, kind in made.items())).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beats, leads = (batch.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("beats", "leads"))
            at = lambda sizes: pa.array(np.concatenate([[0], sizes.cumsum()]).astype("int32"))
            outer, inner = at(beats), at(np.repeat(leads, beats))
            rows = [pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, batch.column(f"v{k}").flatten())) for k in range(len(names))]
            why = [absences(batch.column(f"v{k}"), batch.column(f"w{k}"), batch.column("coordinates")) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *rows, *why], names=kinds.names)

    return flat.mapInArrow(run, kinds)


def documents(facts: DataFrame, acquisition: DataFrame, groups: dict[str, list[str]], profile: str = "all") -> DataFrame:
    """record_id, doc (a struct) from facts and acquisition (record_id, sample_rate_hz, sample_count, input_mode, amplitude_unit): one shuffle by record.

    Cells without a row of facts are null for want of a measurement; of equal cells
    one counts; a record without an acquisition has none of its members.
    """
    rest = [c for c in facts.columns if c not in ("record_id", "beat", "lead_no")]
    # dealt by number, not by bytes: a record's cells pack well and take many times that when held
    one = spread(facts, "record_id").groupBy("record_id").agg(F.collect_list(F.struct("beat", "lead_no", *rest)).alias("rows"))
    one = one.select("record_id", one_a_cell(F.sort_array("rows")).alias("cells"))
    beat_of = lambda x: F.struct(x["beat"].alias("beat"), x["beat_id"].alias("id"), x["r_sample"].alias("r_sample"))
    # of neighbours with one beat the first is enough
    heads = let(F.transform("cells", beat_of), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))
    lead_of = lambda x: F.struct(x["lead_no"].alias("lead_no"), x["lead"].alias("lead"))
    one = one.withColumns({"beats": F.sort_array(F.array_distinct(heads)), "leads": F.sort_array(F.array_distinct(F.transform("cells", lead_of)))})
    key = lambda x: F.struct(x["beat"].alias("beat"), x["lead_no"].alias("lead_no"))
    # the cells in order of beats and leads; only records with two ids of a beat (or names of a lead) look each cell up
    gaps = let(F.map_from_entries(F.transform("cells", lambda x: F.struct(key(x), x))), lambda m: F.flatten(F.transform("beats", lambda b: F.transform("leads", lambda x: F.element_at(m, F.struct(b["beat"].alias("beat"), x["lead_no"].alias("lead_no")))))))
    single = lambda xs, k: (F.size(F.array_distinct(F.transform(xs, lambda x: x[k]))) == F.size(xs)) & ~F.exists(xs, lambda x: x[k].isNull())
    placed = F.when(single("beats", "beat") & single("leads", "lead_no"), filled(F.col("cells"), F.col("beats"), F.col("leads"))).otherwise(gaps)
    one = one.withColumn("cells", F.when(F.size("cells") == F.size("beats") * F.size("leads"), F.col("cells")).otherwise(placed))
    names_of = F.flatten(F.transform("beats", lambda b: F.transform("leads", lambda x: F.concat(b["id"], F.lit("|"), x["lead"]))))
    # a merge join would sort whole documents
    one = one.withColumn("coordinates", names_of).join(acquisition.hint("shuffle_hash"), "record_id", "left")
    names = sorted({n for fields in groups.values() for n in fields})
    one = _with_fields(one, names)

    def field(group: str, name: str) -> Column:
        return F.struct(
            F.col(f"absence_{names.index(name)}").alias("absence"),
            F.array(F.lit("beat"), F.lit("lead")).alias("axes"),
            F.lit(True).alias("nullable"),
            F.lit("/provenance/fields/kernels").alias("provenance_ref"),
            F.lit("integer").alias("type"),
            F.lit(UNITS[group]).alias("unit"),
            F.struct(F.array().cast("array<string>").alias("evidence"), F.lit("unvalidated").alias("status")).alias("validation"),
            F.col(f"values_{names.index(name)}").alias("values"),
        ).alias(name)

    lead_names = F.transform("leads", lambda x: x["lead"])
    part = {g: F.struct(*(field(g, n) for n in fields)).alias(g) for g, fields in groups.items()}
    doc = F.struct(
        F.struct("amplitude_unit", "input_mode", lead_names.alias("leads"), "sample_count", "sample_rate_hz").alias("acquisition"),
        F.create_map().cast("map<string,string>").alias("artifacts"),
        F.struct(F.transform("beats", lambda b: F.struct(b["id"].alias("id"), b["r_sample"].alias("r_sample"))).alias("beats"), lead_names.alias("leads")).alias("axes"),
        F.struct(part["fiducials"]).alias("delineation"),
        F.struct(*(x for g, x in part.items() if g != "fiducials")).alias("measurements"),
        F.lit(profile).alias("profile"),
        F.struct(F.struct(F.struct(F.lit("delineation").alias("method")).alias("kernels")).alias("fields"), F.lit(VERSION).alias("schema_version")).alias("provenance"),
        F.create_map().cast("map<string,string>").alias("quality"),
        F.col("record_id"),
        F.lit(VERSION).alias("schema_version"),
    )
    return one.select("record_id", doc.alias("doc"))


def as_json(docs: DataFrame) -> DataFrame:
    """record_id, doc as JSON text with members in order of their names."""
    return docs.select("record_id", F.to_json("doc").alias("doc"))


# ---------------------------------------------------------------- validation


def _at(v: Column | str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def kind_of(v: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, OBJECT, ARRAY or VOID (JSON null); null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    """Whether there is a JSON object; its members aren't looked into, as a schema would have to."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _whole_rows(values: Column, kind: Column) -> Column:
    """The rows of a variant of that type if they hold whole numbers and nulls alone, else null. By way of text, since a cell taken out of a variant costs much more."""
    return F.when(kind.isin(*_DENSE_WHOLE), F.from_json(F.to_json(values), "array<array<bigint>>"))


_WHOLE, _NUMBER = ("BIGINT",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_KINDS = {"integer": _WHOLE, "number": _NUMBER, "boolean": ("BOOLEAN",), "string": ("STRING",)}


def _broken(*rules: tuple[Column, str, Column | str] | tuple[Column, str, Column | str, str]) -> Column:
    """The violations of (holds, message, pointer[, code]); a rule that is null does not hold."""
    out = []
    for holds, message, pointer, *code in rules:
        where = F.lit(pointer) if isinstance(pointer, str) else pointer
        out.append(F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(code[0] if code else CONTRACT).alias("code"), where.alias("pointer"), F.lit(message).alias("message"))))
    return F.array_compact(F.array(*out)).cast(_VIOLATIONS)


def _document_rules() -> Column:
    """What holds for the document as a whole, its acquisition and its axes."""
    # each member is a column of its own, so that no rule takes the whole document apart
    at = lambda p, kind="variant": _at(f"_{p.split('.')[1]}", ".".join(["$", *p.split(".")[2:]]), kind)
    text = lambda p: at(p, "string")
    kind = lambda p: kind_of(at(p))
    leads, beats, lead_names, beat_ids = map(F.col, ("lead_items", "beat_items", "lead_names", "beat_names"))
    count = F.col("sample_count")
    limited = text("$.acquisition.input_mode") == "limited"
    good_name = lambda x, path: (F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING") & let(F.try_variant_get(x, path, "string"), lambda s: (s != "") & ~s.contains("|"))
    sample = lambda x: F.try_variant_get(x, "$.r_sample", "variant")
    in_record = lambda x: let(F.coalesce(F.schema_of_variant(sample(x)), F.lit("VOID")), lambda kind: (kind == "VOID") | (kind == "BIGINT") & F.try_variant_get(x, "$.r_sample", "bigint").between(0, count - 1))
    every = lambda xs, test: F.forall(xs, lambda x: F.coalesce(test(x), F.lit(False)))
    missing = F.array_compact(F.array(*(F.when(F.col("members")[m].isNull(), F.lit(m)) for m in MEMBERS)))
    record_id = text("$.record_id")
    whole = _broken(
        (F.size(missing) == 0, "record is missing required members", "", "missing_record_members"),
        ((kind("$.record_id") == "STRING") & (F.trim(record_id) != "") & ~F.regexp_like(record_id, F.lit("[@#\n\r]")), "record_id must be non-empty and free of @ and #", "/record_id", "missing_record_id"),
        ((kind("$.schema_version") == "STRING") & F.regexp_like(text("$.schema_version"), F.lit(r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$")), "schema_version must use SemVer", "/schema_version", "invalid_schema_version"),
        (F.substring_index(text("$.schema_version"), ".", 1) == "1", "unsupported schema major", "/schema_version"),
        (text("$.profile").isin(*PROFILES), "unsupported record profile", "/profile", "invalid_profile"),
        *((at(f"$.acquisition.{m}").isNotNull(), "incomplete acquisition", f"/acquisition/{m}") for m in ACQUISITION),
        (kind("$.acquisition.sample_rate_hz").isin(*_NUMBER) & (at("$.acquisition.sample_rate_hz", "double") > 0), "invalid sample_rate_hz", "/acquisition/sample_rate_hz"),
        ((kind("$.acquisition.sample_count") == "BIGINT") & (count > 0), "invalid sample_count", "/acquisition/sample_count"),
        (text("$.acquisition.amplitude_unit").isin("mV", "uV"), "invalid acquisition amplitude unit", "/acquisition/amplitude_unit"),
        (text("$.acquisition.input_mode").isin("standard_12", "limited"), "invalid acquisition input mode", "/acquisition/input_mode"),
        (F.size(leads) > 0, "axes.leads must be nonempty", "/axes/leads"),
        (every(leads, lambda x: good_name(x, "$")), "invalid lead name", "/axes/leads"),
        (F.size(F.array_distinct(lead_names)) == F.size(lead_names), "duplicate lead axis", "/axes/leads"),
        (beats.isNotNull(), "axes.beats must be an array", "/axes/beats"),
        (every(beats, lambda x: good_name(x, "$.id")), "invalid beat identity", "/axes/beats"),
        (every(beats, in_record), "beat sample outside acquisition", "/axes/beats"),
        (F.size(F.array_distinct(beat_ids)) == F.size(beat_ids), "duplicate beat identity", "/axes/beats"),
        (F.to_json(at("$.acquisition.leads")) == F.to_json(at("$.axes.leads")), "acquisition and lead axis disagree", "/acquisition/leads"),
        (limited | (F.array_sort(lead_names) == F.array_sort(F.array(*map(F.lit, LEADS)))), "standard_12 requires all canonical leads", "/axes/leads"),
        (~limited | F.size(leads).between(1, 8), "limited requires 1 to 8 leads", "/axes/leads"),
        (F.coalesce(text("$.provenance.schema_version"), text("$.schema_version")) == text("$.schema_version"), "provenance schema version disagrees", "/provenance/schema_version"),
    )
    # members that are missing are told once, not again by each rule that reads them
    return F.when(F.col("v").isNull(), _broken((F.lit(False), "invalid record JSON", "", "invalid_record_json"))).when(F.col("members").isNull(), _broken((F.lit(False), "record must be a JSON object", "", "record_not_object"))).when(F.size(missing) > 0, F.filter(whole, lambda x: x["code"] == "missing_record_members")).otherwise(whole)


def _axis_rules(pointer: Column) -> Column:
    """What holds for a field's wrapper: type, unit, axes, claims and the length of its values."""
    v, axes, group, name = F.col("field"), F.col("axes"), F.col("grp"), F.col("name")
    text = lambda p: _at(v, p, "string")
    kind = lambda p: kind_of(_at(v, p))
    expected = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[group]
    formal = F.create_map(*(F.lit(x) for kv in GLOBAL_UNITS.items() for x in kv))[name]
    rank = F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv))
    backed, length = F.col("backed"), F.size("row_sizes")
    has = [(F.col("wrapper")[m].isNotNull() | (backed if m == "values" else F.lit(False)), f"incomplete field wrapper: {m}", pointer) for m in FIELD]
    status, evidence = text("$.validation.status"), _at(v, "$.validation.evidence")
    path = F.concat(F.lit("$"), F.array_join(F.transform(F.slice(F.split(text("$.provenance_ref"), "/"), 3, 99), lambda t: F.concat(F.lit("['"), unescape_token(t), F.lit("']"))), ""))
    rules = _broken(
        (name != "", "measurement names must be nonempty", pointer),
        *has,
        (text("$.type").isin(*_KINDS), "invalid type", pointer),
        (kind("$.unit").isin("STRING", "VOID"), "invalid unit", pointer),
        (expected.isNull() | (text("$.unit") == expected) & (text("$.type") == "integer"), "expected an integer in the group's unit", pointer),
        ((group != "global") | formal.isNull() | (text("$.unit") == formal) & (text("$.type") == "integer"), "incorrect global unit or type", pointer),
        (axes.isin("[]", '["beat"]', '["lead"]', '["beat","lead"]'), "invalid axes", pointer),
        ((group != "global") | (axes == "[]"), "global fields cannot have beat or lead axes", pointer),
        ((group != "flags") | (text("$.type") == "boolean") & (kind("$.unit") == "VOID"), "flags require boolean type with no unit", pointer),
        (kind("$.nullable") == "BOOLEAN", "nullable must be boolean", pointer),
        (status.isin(*STATUSES), "invalid validation status", pointer),
        (evidence.isNull() | (kind_of(evidence) == "ARRAY"), "evidence must be an array", pointer),
        ((status == "unvalidated") | (F.size(_at(v, "$.validation.evidence", "array<variant>")) > 0), "validation claim requires evidence", pointer),
        (F.col("ceiling").isNull() | (rank[status] <= rank[F.col("ceiling")]), "validation status exceeds the registry", pointer, "validation_above_registry"),
        (text("$.provenance_ref").startswith("/provenance/"), "invalid provenance pointer", pointer),
        (~text("$.provenance_ref").startswith("/provenance/") | F.call_function("get_json_object", F.col("provenance"), path).isNotNull(), "unresolved provenance pointer", pointer),
        (~backed | (axes == '["beat","lead"]') & F.coalesce(F.col("shape"), F.lit("VOID")).isin("VOID"), "only null dense values may be sidecar-backed", pointer),
        (backed | (axes != '["beat","lead"]') | (length == F.size("beat_ids")), "beat dimension mismatch", pointer),
        (backed | (axes != '["beat","lead"]') | F.forall("row_sizes", lambda n: F.coalesce(n == F.size("leads"), F.lit(False))), "lead dimension mismatch", pointer),
        (~axes.isin('["beat"]', '["lead"]') | (length == F.when(axes == '["beat"]', F.size("beat_ids")).otherwise(F.size("leads"))), "dimension mismatch", pointer),
    )
    return F.when(F.col("wrapper").isNotNull(), rules).otherwise(_broken((F.lit(False), "field must be an object", pointer)))


def _cells(bad: Callable[[Column], Column], plain: Column) -> Column:
    """The cells of a field: coordinate (empty for a scalar), at (its place in values), value (a variant). Of a dense field of whole numbers where ``plain`` holds, only those that are ``bad``. A field whose shape is wrong was told by its wrapper's rules and has none."""
    axes, backed = F.col("axes"), F.col("backed")
    nothing = F.lit(None).cast("variant")
    one = lambda c, at, x: F.struct(c.alias("coordinate"), at.alias("at"), x.alias("value"))
    line = _at("values", "$", "array<variant>")
    beat_no, lead_no = F.sequence(F.lit(0), F.size("beat_ids") - 1), F.sequence(F.lit(0), F.size("leads") - 1)
    named = lambda i, j: F.concat(F.get("beat_ids", i), F.lit("|"), F.get("leads", j))
    place = lambda i, j: F.concat(F.lit("/"), i, F.lit("/"), j)
    along_leads = lambda r, i: F.transform(r, lambda x, j: one(named(i, j), place(i, j), x))
    inline = F.flatten(F.transform(_at("values", "$", "array<array<variant>>"), along_leads))
    outside = lambda r, i: F.transform(F.filter(F.transform(r, lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda c: bad(c["x"])), lambda c: one(named(i, c["j"]), place(i, c["j"]), c["x"].cast("variant")))
    few = F.flatten(F.transform("whole", outside))
    beside = F.flatten(F.transform(beat_no, lambda i: F.transform(lead_no, lambda j: one(named(i, j), place(i, j), nothing))))
    along = lambda labels: let(line, lambda xs: F.transform(labels, lambda label, i: one(label, F.concat(F.lit("/"), i), F.get(xs, i))))
    square = (F.size("row_sizes") == F.size("beat_ids")) & F.forall("row_sizes", lambda n: n == F.size("leads"))
    return (
        F.when((axes == '["beat","lead"]') & backed & (F.size("beat_ids") > 0), beside)
        .when((axes == '["beat","lead"]') & ~backed & square & plain, few)
        .when((axes == '["beat","lead"]') & ~backed & square, inline)
        .when((axes == '["beat"]') & (F.size("row_sizes") == F.size("beat_ids")) & (F.size("beat_ids") > 0), along("beat_ids"))
        .when((axes == '["lead"]') & (F.size("row_sizes") == F.size("leads")), along("leads"))
        .when(axes == "[]", F.array(one(F.lit(""), F.lit(""), F.col("values"))))
    )


def _cell_rules() -> Column:
    """What holds for each cell of a field: its type, its range, and a reason if it is null."""
    text = lambda p: _at("field", p, "string")
    backed, whole_kind = F.col("backed"), F.try_variant_get("absence", "$.kind", "string")
    default = F.try_variant_get("absence", "$.default", "variant").isNotNull()
    kinds = F.create_map(*(x for k, v in _KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[text("$.type")]
    may_be_null = backed | (_at("field", "$.nullable", "boolean") == F.lit(True)) | whole_kind.isNotNull() | default
    formal = F.col("limited") & (F.col("grp") == "global") & F.col("name").isin("frontal_qrs_axis_deg", "qtc_bazett_ms")
    sample, interval = text("$.unit") == "sample", F.col("grp") == "intervals"
    listed = F.concat(*(F.coalesce(F.map_keys(F.try_variant_get("absence", f"$.{k}", "map<string,variant>")), F.array().cast("array<string>")) for k in ABSENT))
    # whole numbers whose type and nulls are right can only be out of range
    plain = F.coalesce(F.col("whole").isNotNull() & may_be_null & whole_kind.isNull() & F.array_contains(kinds, _WHOLE[0]), F.lit(False)) & ~F.coalesce(formal, F.lit(False))
    facts = F.struct(plain.alias("plain"), may_be_null.alias("null_ok"), formal.alias("formal"), sample.alias("sample"), interval.alias("interval"), kinds.alias("kinds"), whole_kind.alias("whole"), listed.alias("listed"))

    def each(f: Column) -> Column:
        in_record = lambda n: ~F.coalesce(f["sample"], F.lit(False)) | F.coalesce(n.between(0, F.col("sample_count") - 1), F.lit(True))
        forward = lambda n: ~F.coalesce(f["interval"], F.lit(False)) | F.coalesce(n >= 0, F.lit(True))

        def rules(x: Column) -> Column:
            return let(kind_of(x["value"]), lambda kind: told(x, kind))

        def told(x: Column, kind: Column) -> Column:
            number = F.try_variant_get(x["value"], "$", "double")
            kept = F.coalesce(kind != "VOID", F.lit(False))
            at = F.concat("pointer", F.lit("/values"), x["at"])
            return _broken(
                (~kept | f["whole"].isNull(), "absence contradicts measured values", at),
                (~F.coalesce(f["formal"], F.lit(False)) | ~kept & (f["whole"] == "not_applicable"), "formal report is not applicable to limited input", at),
                (kept | F.coalesce(f["null_ok"], F.lit(False)) | F.array_contains(f["listed"], x["coordinate"]), "plain null forbidden", at),
                (~kept | F.array_contains(f["kinds"], kind), "cell type mismatch", at),
                (~kept | in_record(number), "sample outside acquisition", at),
                (~kept | forward(number), "negative interval", at),
            )

        return F.flatten(F.transform(_cells(lambda n: ~(in_record(n) & forward(n)), f["plain"]), rules))

    return let(facts, each)


def _absence_rules(pointer: Column) -> Column:
    """What holds for a field's statement of absence as a whole."""
    a = F.col("absence")
    names, default = F.map_keys("states"), F.col("states")["default"]
    said = lambda v, p: F.try_variant_get(v, p, "string")
    good = lambda v: said(v, "$.kind").isin(*ABSENT) & (kind_of(F.try_variant_get(v, "$.reason", "variant")) == "STRING") & (said(v, "$.reason") != "")
    whole = F.array_contains(names, "kind")
    maps = F.forall(F.filter(names, lambda n: n.isin(*ABSENT)), lambda n: F.when(n == ABSENT[0], F.col(ABSENT[0]).isNotNull()).otherwise(F.col(ABSENT[1]).isNotNull()))
    told = _broken(
        (~whole | good(a), "invalid field absence", pointer),
        (whole | F.forall(names, lambda n: n.isin(*ABSENT, "default")), "unknown absence kind", pointer),
        (whole | default.isNull() | (F.array_sort(F.map_keys(F.try_variant_get(default, "$", "map<string,variant>"))) == F.array(F.lit("kind"), F.lit("reason"))) & good(default), "invalid default absence", pointer),
        (whole | default.isNull() | (F.col("axes") != "[]"), "default absence needs axes", pointer),
        (whole | maps, "absence map must be an object", pointer),
    )
    return F.when(a.isNull(), F.array().cast(_VIOLATIONS)).when(F.col("states").isNotNull(), told).otherwise(_broken((F.lit(False), "invalid absence", pointer)))


def _named_rules() -> Column:
    """What holds for each cell that a field's absence names: it is there, null, and named once."""
    entries = lambda k: F.transform(F.map_entries(F.coalesce(F.col(k), F.create_map().cast("map<string,variant>"))), lambda e: F.struct(F.lit(k).alias("state"), e["key"].alias("coordinate"), e["value"].alias("reason")))
    backed, axes, plain = F.col("backed"), F.col("axes"), F.col("whole").isNotNull()
    # as text each is null where JSON is; those of whole numbers are there as such
    texts = F.when(~plain, F.struct(_at("values", "$", "array<array<string>>").alias("rows"), _at("values", "$", "array<string>").alias("line")))
    second = F.coalesce(F.map_keys(F.col(ABSENT[1])), F.array().cast("array<string>"))
    place_of = lambda labels, x: (F.array_position(labels, x) - 1).cast("int")

    def rules(x: Column, text: Column) -> Column:
        parts = F.split(x["coordinate"], r"\|")
        i, j = place_of("beat_ids", F.get(parts, F.lit(0))), place_of("leads", F.get(parts, F.lit(1)))
        label = F.when(axes == '["beat"]', place_of("beat_ids", x["coordinate"])).otherwise(place_of("leads", x["coordinate"]))
        there = F.when(axes == '["beat","lead"]', (i >= 0) & (j >= 0) & (F.size(parts) == 2)).when(axes == "[]", x["coordinate"] == "").otherwise(label >= 0)
        empty = backed | F.when(axes == '["beat","lead"]', F.when(plain, F.get(F.get("whole", i), j).isNull()).otherwise(F.get(F.get(text["rows"], i), j).isNull())).when(axes == "[]", F.coalesce(F.col("shape"), F.lit("VOID")) == "VOID").otherwise(F.when(plain, F.get("whole", label).isNull()).otherwise(F.get(text["line"], label).isNull()))
        where = F.concat("pointer", F.lit("/absence/"), x["state"], F.lit("/"), escape_token(x["coordinate"]))
        return _broken(
            (there & empty, "absence coordinate has no null cell", where),
            ((kind_of(x["reason"]) == "STRING") & (F.try_variant_get(x["reason"], "$", "string") != ""), "invalid reason", where),
            (~(F.array_contains(second, x["coordinate"]) & (x["state"] == ABSENT[0])), "cell has two absence states", where),
        )

    named = let(texts, lambda text: F.flatten(F.transform(F.concat(*map(entries, ABSENT)), lambda x: rules(x, text))))
    return F.when(F.try_variant_get("absence", "$.kind", "variant").isNull(), named)


#: What a plain field's wrapper holds besides its unit, values and absence.
_PLAIN = {"axes": ["beat", "lead"], "type": "integer", "validation": {"evidence": [], "status": "unvalidated"}}
_EXACT = 2**53


def _once(pairs: list) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("repeated member")
    return made


def _as_written(number: str) -> float:
    if repr(float(number)) != number:
        raise ValueError("a number that would be written otherwise")
    return float(number)


def _no_constant(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(object_pairs_hook=_once, parse_float=_as_written, parse_constant=_no_constant)


def _said(x: object) -> bool:
    return type(x) is str and x != ""


def _absence_fits(a: object, flat: list, place: dict[str, int]) -> bool:
    """Whether a field's absence breaks no rule: one reason for all cells, or a default and the null cells it names, each once."""
    good = lambda x: type(x) is dict and set(x) == {"kind", "reason"} and x["kind"] in ABSENT and _said(x["reason"])
    if type(a) is not dict or "kind" in a:
        return good(a) and not any(v is not None for v in flat)
    maps = [a[k] for k in ABSENT if k in a]
    if not set(a) <= {"default", *ABSENT} or not all(type(m) is dict and all(map(_said, m.values())) for m in maps):
        return False
    named = [c for m in maps for c in m]
    return ("default" not in a or good(a["default"])) and len(set(named)) == len(named) and all(c in place and flat[place[c]] is None for c in named)


def plain_fields(text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """A document's text without its plain fields, and their violations (pointer, message).

    A field is plain if it is dense, holds whole numbers and nulls and has the wrapper
    that documents() writes, so only the range and the order of its cells can be wrong.
    What is anything else stays in the text, for the rules: a field with all others of
    its chain of bounds, or the whole document where its axes are not sound.
    """
    if text is None or len(text) > 1 << 22 or "\\u" in text:
        return text, []
    try:
        doc = _JSON.decode(text)
        leads, beats, count = doc["axes"]["leads"], [b["id"] for b in doc["axes"]["beats"]], doc["acquisition"]["sample_count"]
        fiducials, measured, provenance = doc["delineation"]["fiducials"], doc["measurements"], {"provenance": doc["provenance"]}
        sound = all(type(xs) is list and xs and all(_said(x) and "|" not in x for x in xs) and len(set(xs)) == len(xs) for xs in (leads, beats))
    except (ValueError, KeyError, TypeError, RecursionError):
        return text, []
    if not sound or type(count) is not int or abs(count) >= _EXACT or type(fiducials) is not dict or type(measured) is not dict:
        return text, []
    place = {f"{b}|{x}": k for k, (b, x) in enumerate((b, x) for b in beats for x in leads)}

    @cache
    def resolved(ref: str) -> bool:
        at = provenance
        for token in ref.split("/")[1:] if re.fullmatch(r"/provenance(/[A-Za-z0-9_]+){1,9}", ref) else ("",):
            at = at.get(token) if type(at) is dict else None
        return type(at) is dict or _said(at)

    def cells(group: str, name: str, f: object) -> list | None:
        """The cells of a plain field in order of beats and leads; None of another."""
        if type(f) is not dict or f.keys() - {"absence"} != set(FIELD) or not re.fullmatch("[^~/]+", name):
            return None
        if f["nullable"] is not True or f["unit"] != UNITS[group] or any(f[k] != v for k, v in _PLAIN.items()) or not (_said(f["provenance_ref"]) and resolved(f["provenance_ref"])):
            return None
        rows = f["values"]
        if type(rows) is not list or len(rows) != len(beats) or not all(type(r) is list and len(r) == len(leads) for r in rows):
            return None
        flat = list(chained.from_iterable(rows))
        whole = [v for v in flat if v is not None]
        if not set(map(type, whole)) <= {int} or whole and not -_EXACT < min(whole) <= max(whole) < _EXACT:
            return None
        return flat if "absence" not in f or _absence_fits(f["absence"], flat, place) else None

    groups = {("fiducials", "/delineation/fiducials"): fiducials} | {(g, f"/measurements/{g}"): f for g, f in measured.items() if g in ("intervals", "amplitudes", "areas") and type(f) is dict}
    found = {(g, n): flat for (g, _), fields in groups.items() for n, f in fields.items() if (flat := cells(g, n, f)) is not None}
    out = []
    for names in CHAINS:
        bounds = [found.get(("fiducials", n)) for n in names]
        if None not in bounds:
            wrong = sorted({k for one, other in combinations(bounds, 2) for k, (a, b) in enumerate(zip(one, other)) if a is not None and b is not None and a > b})
            out += [(f"/delineation/fiducials/{names[0]}/values/{k // len(leads)}/{k % len(leads)}", "/".join(names) + ": fiducial order violated") for k in wrong]
        elif all(n in fiducials for n in names):
            found = {key: flat for key, flat in found.items() if key[0] != "fiducials" or key[1] not in names}
    for (group, where), fields in groups.items():
        for name in [n for g, n in found if g == group]:
            del fields[name]
            flat, message = found[group, name], {"fiducials": "sample outside acquisition", "intervals": "negative interval"}.get(group)
            if message:
                wrong = [k for k, v in enumerate(flat) if v is not None and (v < 0 or group == "fiducials" and v >= count)]
                out += [(f"{where}/{name}/values/{k // len(leads)}/{k % len(leads)}", message) for k in wrong]
    return (json.dumps(doc, ensure_ascii=False) if found else text), out


def _without_plain_fields(docs: DataFrame) -> DataFrame:
    """docs (_key, doc) with plain fields taken out of their texts and, as told_cells, what these break. Rules over each cell of a variant are what took the time."""
    kinds = StructType([*docs.schema.fields[:1], StructField("doc", StringType()), StructField("told_cells", docs.select(F.lit(None).cast(_VIOLATIONS).alias("x")).schema["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, told = zip(*map(plain_fields, batch.column("doc").to_pylist())) if len(batch) else ((), ())
            pointers, messages = ([x[k] for xs in told for x in xs] for k in (0, 1))
            ends = np.cumsum([0, *map(len, told)]).astype("int32")
            rows = pa.StructArray.from_arrays([pa.array([CONTRACT] * len(pointers), pa.string()), pa.array(pointers, pa.string()), pa.array(messages, pa.string())], ["code", "pointer", "message"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends), rows)], names=["_key", "doc", "told_cells"])

    return docs.mapInArrow(run, kinds)


def violations(docs: DataFrame, registry: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """key, code, pointer, message: every rule that a document (key, doc as JSON) breaks; a valid one has no rows.

    registry (pointer, ceiling): the highest validation status that a field may
    claim. It has a row a field of the contract, whatever the input. All violations
    are told, not the first alone. Nothing is shuffled: a document's rules read that document.
    Without a registry, fields that are as documents() writes them are settled in Arrow batches first.
    """
    docs = docs.select(F.col(key).alias("_key"), "doc")
    docs = _without_plain_fields(docs) if registry is None else docs.withColumn("told_cells", F.array().cast(_VIOLATIONS))
    # a variant taken out of another is a copy of all below it, so each level is taken apart once, into columns
    parsed = docs.select("_key", "told_cells", F.try_parse_json("doc").alias("v"))
    leads, beats = _at("v", "$.axes.leads", "array<string>"), F.transform(_at("v", "$.axes.beats", "array<variant>"), lambda b: F.try_variant_get(b, "$.id", "string"))
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,variant>")
    whole = parsed.select(
        "_key",
        "told_cells",
        "v",
        F.try_variant_get("v", "$", _MAP).alias("members"),
        _at("v", "$.axes.leads", "array<variant>").alias("lead_items"),
        _at("v", "$.axes.beats", "array<variant>").alias("beat_items"),
        F.coalesce(leads, none).alias("leads"),
        F.coalesce(beats, none).alias("beat_ids"),
        _at("v", "$.acquisition.sample_count", "bigint").alias("sample_count"),
        (_at("v", "$.acquisition.input_mode", "string") == "limited").alias("limited"),
    )
    # a row for each field, in one pass; what holds for the whole document is told with the first, or alone
    group = lambda name, fields: F.struct(name.alias("grp"), fields.isNotNull().alias("there"), F.try_variant_get(fields, "$", _MAP).alias("fields"))
    measured = F.transform(F.map_entries(F.coalesce(F.try_variant_get(F.col("members")["measurements"], "$", _MAP), empty)), lambda e: group(e["key"], e["value"]))
    first = let(F.try_variant_get(F.col("members")["delineation"], "$", _MAP), lambda d: group(F.lit("fiducials"), d["fiducials"]))
    whole = whole.withColumns({"lead_names": F.transform("lead_items", lambda x: F.try_variant_get(x, "$", "string")), "beat_names": F.transform("beat_items", lambda x: F.try_variant_get(x, "$.id", "string")), "provenance": F.to_json(F.col("members")["provenance"]), "groups": F.concat(F.array(first), measured)} | {f"_{m}": F.col("members")[m] for m in MEMBERS if m not in ("delineation", "measurements")})
    whole = whole.withColumn("fiducials", F.get("groups", F.lit(0))["fields"])
    whole = whole.withColumns({f"values_{n}": _at(F.col("fiducials")[n], "$.values") for c in CHAINS for n in c} | {f"dense_{n}": F.to_json(_at(F.col("fiducials")[n], "$.axes")) == '["beat","lead"]' for c in CHAINS for n in c})
    whole = whole.withColumns({f"rows_{n}": F.coalesce(_whole_rows(F.col(f"values_{n}"), F.schema_of_variant(f"values_{n}")), _at(f"values_{n}", "$", "array<array<bigint>>")) for c in CHAINS for n in c})
    place = lambda g: F.when(g == "fiducials", "/delineation/fiducials").otherwise(F.concat(F.lit("/measurements/"), escape_token(g)))
    group_rules = lambda g: _broken(
        (g["grp"].isin("fiducials", "intervals", "amplitudes", "areas", "flags", "global"), "unknown measurement group; use extensions", place(g["grp"])),
        (~g["there"] & (g["grp"] == "fiducials") | g["fields"].isNotNull(), "group must be an object", place(g["grp"])),
    )
    members = lambda g: F.transform(F.map_entries(F.coalesce(g["fields"], empty)), lambda e: F.struct(g["grp"].alias("grp"), e["key"].alias("name"), e["value"].alias("field")))
    readable = F.col("members").isNotNull()
    parts = F.concat(_fiducial_order(), _artifact_rules(), F.flatten(F.transform("groups", group_rules)))
    none_found = F.array().cast(_VIOLATIONS)
    told = F.concat("told_cells", _document_rules(), F.when(readable, F.coalesce(parts, none_found)).otherwise(none_found))
    fields = whole.select("_key", "provenance", "leads", "beat_ids", "sample_count", "limited", told.alias("told"), F.posexplode_outer(F.when(readable, F.flatten(F.transform("groups", members)))).alias("pos", "f"))
    fields = fields.select("*", "f.grp", "f.name", "f.field", F.concat(place(F.col("f.grp")), F.lit("/"), escape_token(F.col("f.name"))).alias("pointer"), F.try_variant_get("f.field", "$", _MAP).alias("wrapper")).drop("f")
    fields = fields.withColumns({"values": F.col("wrapper")["values"], "absence": F.col("wrapper")["absence"], "axes": F.to_json(F.col("wrapper")["axes"]), "backed": F.col("wrapper")["sidecar"].isNotNull()})
    fields = fields.withColumns({"type_of_values": F.schema_of_variant("values"), "states": F.try_variant_get("absence", "$", _MAP)})
    fields = fields.withColumns({"shape": F.regexp_extract("type_of_values", "^[A-Z]+", 0), "whole": _whole_rows(F.col("values"), F.col("type_of_values"))} | {k: F.try_variant_get(F.col("states")[k], "$", _MAP) for k in ABSENT})
    sizes = F.transform(_at("values", "$", "array<variant>"), lambda r: F.size(F.try_variant_get(r, "$", "array<variant>")))
    fields = fields.withColumn("row_sizes", F.when(F.col("whole").isNotNull(), F.transform("whole", lambda r: F.size(r))).otherwise(sizes))
    if registry is None:
        fields = fields.withColumn("ceiling", F.lit(None).cast("string"))
    else:
        fields = fields.join(F.broadcast(registry.select("pointer", "ceiling")), "pointer", "left")
    own = F.concat(*(F.coalesce(x, none_found) for x in (_axis_rules(F.col("pointer")), _absence_rules(F.col("pointer")), _cell_rules(), _named_rules())))
    found = F.concat(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("told")).otherwise(none_found), F.when(F.col("pos").isNotNull(), own).otherwise(none_found))
    return fields.select("_key", F.explode(found).alias("x")).select(F.col("_key").alias(key), "x.code", "x.pointer", "x.message")


def _out_of_order(chain: tuple[str, ...]) -> Column:
    """The cells of a chain of bounds that don't stand in order."""
    rows = [F.col(f"rows_{n}") for n in chain]
    places = [f"c{k}" for k in range(len(chain))]

    def bad_leads(x: Column, i: Column) -> Column:
        def broken(c: Column, j: Column) -> Column:
            # some bound lies behind a later one; nulls between them say nothing
            apart = [F.coalesce(c[p] > c[q], F.lit(False)) for k, p in enumerate(places) for q in places[k + 1 :]]
            return F.when(reduce(lambda a, b: a | b, apart), F.struct(F.lit(CONTRACT).alias("code"), F.concat(F.lit(f"/delineation/fiducials/{chain[0]}/values/"), i, F.lit("/"), j).alias("pointer"), F.lit("/".join(chain) + ": fiducial order violated").alias("message")))

        return F.array_compact(F.transform(F.arrays_zip(*(x[p].alias(p) for p in places)), broken))

    usable = F.lit(True)
    for n in chain:
        usable = usable & F.col(f"dense_{n}")
    none = F.array().cast(_VIOLATIONS)
    # a chain with a field that is no matrix is null, and has none
    return F.when(usable, F.coalesce(F.flatten(F.transform(F.arrays_zip(*(r.alias(p) for p, r in zip(places, rows, strict=True))), bad_leads)).cast(_VIOLATIONS), none)).otherwise(none)


def _fiducial_order() -> Column:
    """Bounds of one wave stand in order in every beat and lead; nulls between them are left out."""
    return F.concat(*map(_out_of_order, CHAINS))


def _artifact_rules() -> Column:
    """What holds for artifacts: a locator, a media type and a digest each; the dense one names its record, shape and fields."""
    made = F.coalesce(F.filter(F.map_entries(_at("_artifacts", "$", _MAP)), lambda e: kind_of(e["value"]) != "VOID"), F.array())
    said = lambda e, p: F.try_variant_get(e["value"], p, "string")
    bad = F.transform(made, lambda e: _broken(
        (kind_of(e["value"]) == "OBJECT", "artifact must be an object or null", F.concat(F.lit("/artifacts/"), escape_token(e["key"]))),
        (said(e, "$.uri").isNotNull() & said(e, "$.media_type").isNotNull(), "artifact requires uri and media_type", F.concat(F.lit("/artifacts/"), escape_token(e["key"]))),
        (F.regexp_like(said(e, "$.sha256"), F.lit("^sha256:[0-9a-f]{64}$")), "artifact requires SHA-256 digest", F.concat(F.lit("/artifacts/"), escape_token(e["key"]))),
    ))
    d, where = "$.dense_measurements", "/artifacts/dense_measurements"
    has_sidecar = lambda _, f: F.try_variant_get(f, "$.sidecar", "variant").isNotNull()
    pointers = lambda g, where: F.transform(F.map_keys(F.map_filter(F.coalesce(g["fields"], F.create_map().cast(_MAP)), has_sidecar)), lambda n: F.concat(where, F.lit("/"), escape_token(n)))
    dense_groups = F.filter(F.slice("groups", 2, 1 << 30), lambda g: g["grp"].isin("intervals", "amplitudes", "areas"))
    backed = F.concat(pointers(F.get("groups", F.lit(0)), F.lit("/delineation/fiducials")), F.flatten(F.transform(dense_groups, lambda g: pointers(g, F.concat(F.lit("/measurements/"), g["grp"])))))
    has = kind_of(_at("_artifacts", d)) == "OBJECT"
    size = F.concat(F.lit("["), F.size("beat_ids").cast("string"), F.lit(","), F.size("leads").cast("string"), F.lit("]"))
    dense = _broken(
        (_at("_artifacts", f"{d}.media_type", "string") == MEDIA_TYPE, "dense_measurements has another media type", where, SIDECAR),
        (F.regexp_like(_at("_artifacts", f"{d}.uri", "string"), F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]*\.cells$")), "sidecar uri must be a plain relative name", where, "invalid_sidecar_uri"),
        (_at("_artifacts", f"{d}.record_id", "string") == _at("_record_id", "$", "string"), "sidecar descriptor names another record", where, "sidecar_identity"),
        (_at("_artifacts", f"{d}.schema_version", "string") == _at("_schema_version", "$", "string"), "sidecar schema version disagrees", where, "sidecar_identity"),
        ((F.to_json(_at("_artifacts", f"{d}.shape")) == size) & (F.to_json(_at("_artifacts", f"{d}.axes")) == '["beat","lead"]'), "sidecar shape disagrees with record axes", where, SIDECAR),
        (F.array_sort(F.array_distinct(_at("_artifacts", f"{d}.fields", "array<string>"))) == F.array_sort(backed), "sidecar field list disagrees with sidecar-backed fields", where, SIDECAR),
    )
    alone = _broken((F.size(backed) == 0, "sidecar-backed fields require a dense artifact", where, SIDECAR))
    return F.concat(F.flatten(bad).cast(_VIOLATIONS), F.when(has, dense).otherwise(alone))


# ---------------------------------------------------------------- dense cells beside the document


def _dense(docs: DataFrame) -> list[tuple[str, str, str]]:
    """pointer, path and name of every dense field in the document's type."""
    doc = docs.schema["doc"].dataType
    groups = [("/delineation/fiducials", "delineation.fiducials", doc["delineation"].dataType["fiducials"].dataType)]
    groups += [(f"/measurements/{f.name}", f"measurements.{f.name}", f.dataType) for f in doc["measurements"].dataType if f.name in UNITS]
    return sorted((f"{where}/{f.name}", f"{path}.{f.name}", f.name) for where, path, kind in groups for f in kind)


def _of(path: str) -> Column:
    return F.col(f"doc.{path}")


def _states(field: Column, values: Column, coordinates: Column) -> Column:
    """The state of each cell, in order: a value, or what the field's absence says of a null."""
    a = field["absence"]
    code = lambda kind: F.when(kind == "not_applicable", STATES["not_applicable"]).otherwise(STATES["unmeasurable"])
    holds = lambda m, c: F.coalesce(F.map_contains_key(m, c), F.lit(False))
    null = lambda c: F.when(a["kind"].isNotNull(), code(a["kind"])).when(holds(a["unmeasurable"], c), STATES["unmeasurable"]).when(holds(a["not_applicable"], c), STATES["not_applicable"]).when(a["default"].isNotNull(), code(a["default"]["kind"])).otherwise(STATES["null"])
    of_null = lambda other: F.transform(values, lambda v: F.when(v.isNotNull(), STATES["measured"]).otherwise(other))
    # cells are looked up by name only where those named may have another state than the rest
    rest = F.coalesce(a["kind"], F.when(F.coalesce(F.size(a["not_applicable"]), F.lit(0)) <= 0, a["default"]["kind"]))
    alike = (rest == "unmeasurable") | a["kind"].isNotNull()
    return F.when(alike, let(code(rest), of_null)).otherwise(F.zip_with(values, coordinates, lambda v, c: F.when(v.isNotNull(), STATES["measured"]).otherwise(null(c))))


def _rebuilt(docs: DataFrame, fields: dict[str, Column], artifacts: Column) -> Column:
    """The document with other dense fields (by path) and artifacts. Written out member by member, since each nested withField() holds all before it several times."""
    kind = docs.schema["doc"].dataType

    def group(path: str, fields_of) -> Column:
        return F.struct(*((fields[f"{path}.{f.name}"] if f"{path}.{f.name}" in fields else _of(f"{path}.{f.name}")).alias(f.name) for f in fields_of)).alias(path.split(".")[1])

    def member(name: str) -> Column:
        if name == "artifacts":
            return artifacts.alias(name)
        if name in ("delineation", "measurements"):
            return F.struct(*(group(f"{name}.{g.name}", g.dataType) for g in kind[name].dataType)).alias(name)
        return _of(name).alias(name)

    return F.struct(*map(member, kind.fieldNames()))


def _coordinates() -> Column:
    return F.flatten(F.transform(_of("axes.beats"), lambda b: F.transform(_of("axes.leads"), lambda x: F.concat(b["id"], F.lit("|"), x))))


def _swapped(h: Column) -> Column:
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def int32_bytes(values: Column) -> Column:
    """Whole numbers as little-endian 32-bit ones; one that needs more bits is an error."""
    fits = lambda v: F.when(v.between(-(2**31), 2**31 - 1), v).otherwise(F.raise_error(F.lit("a dense cell needs more than 32 bits")).cast("long"))
    return F.unhex(F.array_join(F.transform(values, lambda v: let(F.lpad(F.hex(fits(v).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"), _swapped)), ""))


def int32_values(data: Column) -> Column:
    signed = lambda u: F.when(u >= 2**31, u - 2**32).otherwise(u)
    # bytes are cut out of the binary itself: a place in a text is found by counting from its start
    one = lambda b, k: let(F.hex(F.substr(b, k * 4 + 1, F.lit(4))), lambda h: let(F.conv(_swapped(h), 16, 10).cast("long"), signed))
    at = lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / 4).cast("int") - 1), lambda k: one(b, k))
    return F.when(F.length(data) > 0, let(data, at)).otherwise(F.array().cast("array<bigint>"))


def state_bytes(states: Column) -> Column:
    return F.unhex(F.array_join(F.transform(states, lambda s: F.lpad(F.hex(s), 2, "0")), ""))


def _packed(rows: pa.Array, kind: str) -> pa.Array:
    """Each row's whole numbers as bytes of that type, nulls as zero; null where the row is. One that needs more bits is an error."""
    flat, sizes = pc.fill_null(rows.flatten(), 0).to_numpy(zero_copy_only=False), pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)
    packed = flat.astype(kind)
    if (packed != flat).any():
        raise ValueError(f"a dense cell needs more than {8 * packed.itemsize} bits")
    raw, ends = packed.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * packed.itemsize
    there = rows.is_valid().to_pylist()
    return pa.array([raw[i:j] if ok else None for i, j, ok in zip(ends.tolist(), ends[1:].tolist(), there)], pa.binary())


def with_parts(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns, parts (structs of pointer, data, states; one a dense field) and sha256. The bytes are written in Arrow batches: text made of each cell is what took the time."""
    fields = _dense(docs)
    flat = [F.flatten(_of(f"{path}.values")) for _, path, _ in fields]
    arrays = docs.withColumn("coordinates", _coordinates()).select(*kept, *(v.alias(f"data{k}") for k, v in enumerate(flat)), *(_states(_of(path), flat[k], F.col("coordinates")).alias(f"states{k}") for k, (_, path, _) in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = [_packed(batch.column(f"{c}{k}"), kind) for c, kind in (("data", "<i4"), ("states", "u1")) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *dense], names=batch.schema.names)

    kinds = StructType([StructField(f.name, BinaryType() if k >= len(kept) else f.dataType) for k, f in enumerate(arrays.schema)])
    parts = F.array(*(F.struct(F.lit(p).alias("pointer"), F.col(f"data{k}").alias("data"), F.col(f"states{k}").alias("states")) for k, (p, _, _) in enumerate(fields)))
    made = arrays.mapInArrow(run, kinds).select(*kept, parts.alias("parts"))
    return made.withColumn("sha256", _digest(F.col("record_id"), F.col("parts")))


def _digest(record_id: Column, parts: Column) -> Column:
    """SHA-256 of the record's identity and its arrays (structs of pointer, data, states) in order of their pointers."""
    said = F.transform(F.array_sort(parts), lambda p: F.concat_ws("\n", p["pointer"], F.hex(p["data"]), F.hex(p["states"])))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", F.concat(record_id, F.lit("@" + VERSION)), F.array_join(said, "\n")).cast("binary"), 256))


def split_dense(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents without their dense values, and those as a table: record_id, sha256, pointer, data (32-bit numbers), states (a byte a cell).

    The table is addressed by the digest of a record's arrays, which the document's
    artifact names with shape and fields. The document stays the authority on units,
    axes and reasons. Nothing is shuffled.
    """
    fields = _dense(docs)
    # each takes what it needs alone: a document that goes along with its cells is work
    cells = with_parts(docs, "record_id").select("record_id", "sha256", F.explode("parts").alias("x")).select("record_id", "sha256", "x.pointer", "x.data", "x.states")
    made = with_parts(docs, "record_id", "doc")
    beside = {}
    for p, path, _ in fields:
        key = p.strip("/").replace("/", ".")
        backed = F.struct(F.lit(key).alias("array_key"), F.lit("int32").alias("dtype"), F.lit(key + ".state").alias("state_key"))
        beside[path] = _of(path).withField("values", F.lit(None).cast("array<array<bigint>>")).withField("sidecar", backed)
    descriptor = F.struct(
        F.array(F.lit("beat"), F.lit("lead")).alias("axes"),
        F.array(*(F.lit(p) for p, _, _ in fields)).alias("fields"),
        F.lit(MEDIA_TYPE).alias("media_type"),
        F.col("record_id"),
        F.lit(VERSION).alias("schema_version"),
        "sha256",
        F.array(F.size("doc.axes.beats"), F.size("doc.axes.leads")).alias("shape"),
        F.struct(*(F.lit(v).alias(k) for k, v in STATES.items())).alias("state_codes"),
        F.concat(F.substring("sha256", 8, 64), F.lit(".cells")).alias("uri"),
    )
    return made.select("record_id", _rebuilt(docs, beside, F.struct(descriptor.alias("dense_measurements"))).alias("doc")), cells


def join_dense(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """record_id, doc, code: documents of split_dense with their values back, or null and why they are refused.

    sidecar_missing: no arrays under the document's digest; sidecar_digest: their bytes
    give another; sidecar_identity: the artifact names another record; invalid_sidecar:
    other fields or sizes than the document tells; sidecar_state: a state that the
    document's absence contradicts. One shuffle by record; neither side is ever broadcast,
    since Spark takes cells for far fewer bytes than they are.
    """
    fields = _dense(docs)
    kept = spread(cells, "record_id", "sha256").groupBy("record_id", "sha256").agg(F.array_sort(F.collect_list(F.struct("pointer", "data", "states"))).alias("parts"))
    d = _of("artifacts.dense_measurements")
    x = spread(docs.withColumn("sha256", d["sha256"]), "record_id", "sha256").withColumn("coordinates", _coordinates()).join(kept.hint("shuffle_hash"), ["record_id", "sha256"], "left")
    part = lambda p: F.get(F.filter("parts", lambda y: y["pointer"] == p), F.lit(0))
    values = lambda p: let(int32_values(part(p)["data"]), lambda v: let(part(p)["states"], lambda s: F.transform(v, lambda a, k: F.when(F.substr(s, k + 1, F.lit(1)) == F.lit(b"\0"), a))))
    for k, (p, _, _) in enumerate(fields):
        x = x.withColumn(f"v{k}", values(p))
    n = F.size("coordinates")
    sizes = F.transform("parts", lambda y: F.struct((F.length(y["data"]) == 4 * n).alias("a"), (F.length(y["states"]) == n).alias("b")))
    whole = (F.transform("parts", lambda y: y["pointer"]) == F.array(*(F.lit(p) for p, _, _ in fields))) & F.forall(sizes, lambda s: s["a"] & s["b"])
    agree = F.lit(True)
    for k, (p, path, _) in enumerate(fields):
        agree = agree & (state_bytes(_states(_of(path), F.col(f"v{k}"), F.col("coordinates"))) == part(p)["states"])
    code = (
        F.when((d["record_id"] != F.col("record_id")) | (d["schema_version"] != VERSION), "sidecar_identity")
        .when(F.col("parts").isNull(), "sidecar_missing")
        .when(_digest(F.col("record_id"), F.col("parts")) != F.col("sha256"), "sidecar_digest")
        .when(~whole, SIDECAR)
        .when(~F.coalesce(agree, F.lit(False)), "sidecar_state")
    )
    inline = {path: _of(path).withField("values", _rowed(f"v{k}")).dropFields("sidecar") for k, (_, path, _) in enumerate(fields)}
    doc = _rebuilt(docs, inline, F.create_map().cast("map<string,string>"))
    return x.withColumn("code", code).select("record_id", F.when(F.col("code").isNull(), doc).alias("doc"), "code")


def fingerprint() -> Column:
    """SHA-256 of the JSON text of ``doc``: what is compared across a shuffle in its place; null for none."""
    return F.sha2(F.to_json("doc").cast("binary"), 256)


def _rowed(flat: str) -> Column:
    leads = F.size("doc.axes.leads")
    return F.transform(F.sequence(F.lit(0), F.size("doc.axes.beats") - 1), lambda i: F.slice(flat, i * leads + 1, leads))

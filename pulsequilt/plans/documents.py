"""Record documents of customers: their orders are beats, line numbers leads, and what a line holds gives bounds, intervals and amplitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import LEADS, spread
from pulsequilt.operators import documents as R
from pulsequilt.operators import records as D
from pulsequilt.plans.registry import query
from pulsequilt.sources.adapters import stored, table

GROUPS = {"fiducials": ["p_onset", "p_offset", "qrs_onset", "r_peak", "qrs_offset"], "intervals": ["p_duration_ms", "pr_interval_ms", "qrs_duration_ms"], "amplitudes": ["t_amplitude_uv"]}
FIELDS = [f for g in GROUPS.values() for f in g]
#: What enforce() calls the fields.
SHORT = {"p_onset": "p_on", "p_offset": "p_off", "qrs_onset": "qrs_on", "r_peak": "r_peak", "qrs_offset": "qrs_off", "p_duration_ms": "p_dur", "pr_interval_ms": "pr", "qrs_duration_ms": "qrs_dur"}
SAMPLES = 4000


def lines(spark, sf) -> DataFrame:
    """record_id, beat, beat_id, r_sample, lead_no, lead, the fields and why they are null: the least line of each customer's order and line number."""
    ordered = Window.partitionBy("record_id").orderBy("l_orderkey")
    least = Window.partitionBy("record_id", "l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("record_id"))
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").join(o, "l_orderkey")
    # in this order one sort serves both windows, and the documents are built where the rows lie
    x = spread(x, "record_id").withColumn("k", F.row_number().over(least)).where("k = 1").withColumn("beat", F.dense_rank().over(ordered) - 1)
    base, seen = F.col("beat").cast("long") * 400, F.col("l_discount") >= 0.02
    p_on, p_off = (F.when(seen, v) for v in (base + F.col("l_partkey") % 60, base + 30 + F.col("l_suppkey") % 60))
    qrs_on, r, qrs_off = base + 100 + F.col("l_quantity").cast("long") % 50, base + 130 + F.col("l_partkey") % 23, base + 135 + F.col("l_suppkey") % 40
    t = F.when(F.col("l_tax") < 0.07, F.floor(F.col("l_extendedprice") / 100))
    values = dict(zip(FIELDS, (p_on, p_off, qrs_on, r, qrs_off, 2 * (p_off - p_on), 2 * (qrs_on - p_on), 2 * (qrs_off - qrs_on), t), strict=True))
    low = F.when(~seen, "low_confidence")
    whys = {f: F.when(F.col("l_tax") >= 0.07, "low_amplitude") if f == "t_amplitude_uv" else low if f.startswith("p") else F.lit(None).cast("string") for f in FIELDS}
    lead = F.get(F.array(*map(F.lit, LEADS)), F.col("l_linenumber") - 1)
    return x.select("record_id", "beat", F.concat(F.lit("b"), F.col("l_orderkey").cast("string")).alias("beat_id"), (base + 150).cast("int").alias("r_sample"), F.col("l_linenumber").alias("lead_no"), lead.alias("lead"), *(v.cast("long").alias(f) for f, v in values.items()), *(w.alias(f"{f}_why") for f, w in whys.items()))


def acquisition(spark, sf, clean: bool) -> DataFrame:
    k = F.col("c_custkey")
    odd = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good) if not clean else F.lit(good)
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("record_id"), odd(23, 0.0, 500.0).alias("sample_rate_hz"), F.lit(10**9 if clean else SAMPLES).alias("sample_count"), odd(19, "mono", "limited").alias("input_mode"), odd(17, "volt", "mV").alias("amplitude_unit"))


def published(spark, sf) -> DataFrame:
    """lines without what contradicts itself."""
    x = lines(spark, sf)
    kept = D.enforce(x.withColumnsRenamed(SHORT))
    why = lambda s: F.get(F.transform(F.filter("withheld", lambda w: w.startswith(f"{s}:")), lambda w: F.substring_index(w, ":", -1)), F.lit(0))
    kept = kept.withColumnsRenamed({s: f for f, s in SHORT.items()})
    return kept.withColumns({f"{f}_why": F.coalesce(why(s), F.col(f"{f}_why")) for f, s in SHORT.items()}).drop("withheld")


def spread_out(docs: DataFrame) -> DataFrame:
    """docs in as many tasks as there are cores or shuffle partitions: they are few bytes and much work, and adaptive execution goes by bytes."""
    return spread(docs, "record_id")


def clean_documents(spark, sf) -> DataFrame:
    """Published documents as a table, as users of documents have them."""
    return stored(R.documents(published(spark, sf), acquisition(spark, sf, clean=True), GROUPS))


_ON = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LEADS[:7], 1))
LINES_SQL = f"""WITH l AS (SELECT 'c' || o_custkey AS record_id, o_custkey AS custkey, li.*, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS beat, row_number() OVER (PARTITION BY o_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS k FROM lineitem li JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT record_id, custkey, beat, 'b' || l_orderkey AS beat_id, l_linenumber AS lead_no, CASE l_linenumber {_ON} END AS lead, beat * 400 + 150 AS r_sample, l_discount >= 0.02 AS seen, CASE WHEN l_discount >= 0.02 THEN beat * 400 + l_partkey % 60 END AS p_onset, CASE WHEN l_discount >= 0.02 THEN beat * 400 + 30 + l_suppkey % 60 END AS p_offset,
  beat * 400 + 100 + CAST(l_quantity AS BIGINT) % 50 AS qrs_onset, beat * 400 + 130 + l_partkey % 23 AS r_peak, beat * 400 + 135 + l_suppkey % 40 AS qrs_offset, CASE WHEN l_tax < 0.07 THEN CAST(floor(l_extendedprice / 100) AS BIGINT) END AS t_amplitude_uv FROM l WHERE k = 1),
w AS (SELECT *, 2 * (p_offset - p_onset) AS p_duration_ms, 2 * (qrs_onset - p_onset) AS pr_interval_ms, 2 * (qrs_offset - qrs_onset) AS qrs_duration_ms, coalesce(p_onset > p_offset, false) AS pb, qrs_onset > qrs_offset AS inv, qrs_onset <= qrs_offset AND (r_peak < qrs_onset OR r_peak > qrs_offset) AS outside FROM v),
leads AS (SELECT record_id, lead_no, lead, row_number() OVER (PARTITION BY record_id ORDER BY lead_no) - 1 AS j FROM (SELECT DISTINCT record_id, lead_no, lead FROM v)),
beats AS (SELECT DISTINCT record_id, custkey, beat, beat_id, r_sample FROM v)"""
_WITHHELD = {"p_onset": "pb", "p_offset": "pb", "p_duration_ms": "pb", "qrs_onset": "inv OR outside", "qrs_offset": "inv OR outside", "qrs_duration_ms": "inv OR outside", "r_peak": "outside"}


def _field_sql(f: str) -> str:
    bad, low = _WITHHELD.get(f, "false"), "NOT seen" if f.startswith("p") else "false"
    group = next(g for g, fields in GROUPS.items() if f in fields)
    negative = f"{f} < 0" if f.endswith("_ms") else "false"
    return f"SELECT record_id, beat, lead_no, '{group}' AS grp, '{f}' AS field, CASE WHEN NOT ({bad}) AND NOT coalesce({negative}, false) THEN {f} END AS value, CASE WHEN {f} IS NOT NULL AND ({bad}) THEN 'violates_fiducial_order' WHEN {negative} THEN 'negative_duration' WHEN {low} THEN 'low_confidence' {'WHEN t_amplitude_uv IS NULL THEN ' + chr(39) + 'low_amplitude' + chr(39) if f == 't_amplitude_uv' else ''} END AS why FROM w"


CLEAN_SQL = LINES_SQL + f""", c AS ({" UNION ALL ".join(map(_field_sql, FIELDS))}),
names AS (SELECT DISTINCT grp, field FROM c),
cells AS (SELECT b.record_id, n.grp, n.field, b.beat, b.beat_id, x.j, x.lead, c.value, CASE WHEN c.value IS NULL THEN coalesce(c.why, 'measurement_unavailable') END AS why FROM beats b JOIN leads x USING (record_id), names n LEFT JOIN c ON c.record_id = b.record_id AND c.beat = b.beat AND c.lead_no = x.lead_no AND c.field = n.field)
"""


@query(CLEAN_SQL + """, rows AS (SELECT record_id, grp, field, beat, '[' || string_agg(coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY j) || ']' AS r FROM cells GROUP BY ALL),
mm AS (SELECT record_id, field, why, count(*) AS n FROM cells WHERE why IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY record_id, field) AS missing, count(*) OVER (PARTITION BY record_id, field) AS reasons, row_number() OVER (PARTITION BY record_id, field ORDER BY n DESC, why) AS k FROM mm),
s AS (SELECT record_id, field, count(*) AS n_cells FROM cells GROUP BY ALL),
d AS (SELECT record_id, field, why, missing = n_cells AND reasons = 1 AS whole FROM m JOIN s USING (record_id, field) WHERE k = 1),
e AS (SELECT record_id, field, string_agg(beat_id || '|' || lead || '=' || cells.why, ',' ORDER BY beat, j) AS exceptions FROM cells JOIN d USING (record_id, field) WHERE cells.why <> d.why GROUP BY ALL)
SELECT record_id, grp || '/' || field AS field, '[' || string_agg(r, ',' ORDER BY beat) || ']' AS matrix, any_value(d.why) AS default_reason, coalesce(any_value(whole), false) AS whole, any_value(exceptions) AS exceptions FROM rows LEFT JOIN d USING (record_id, field) LEFT JOIN e USING (record_id, field) GROUP BY record_id, grp, field""")
def record_document(spark, sf):
    """Every dense field of every published document: its matrix, and how it tells why cells are null."""
    docs = clean_documents(spark, sf)

    def shown(group: str, f: str):
        x = F.col(f"doc.{'delineation' if group == 'fiducials' else 'measurements'}.{group}.{f}")
        a = x["absence"]
        exceptions = F.array_join(F.transform(F.map_entries(a["unmeasurable"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        return F.struct(F.lit(f"{group}/{f}").alias("field"), F.to_json(x["values"]).alias("matrix"), F.coalesce(a["reason"], a["default"]["reason"]).alias("default_reason"), F.coalesce(a["kind"].isNotNull(), F.lit(False)).alias("whole"), exceptions.alias("exceptions"))

    return docs.select("record_id", F.explode(F.array(*(shown(g, f) for g, fields in GROUPS.items() for f in fields))).alias("x")).select("record_id", "x.*")


def _error_sql(rows: str, pointer: str, message: str) -> str:
    return f"SELECT record_id, 'invalid_record_contract' AS code, {pointer} AS pointer, '{message}' AS message FROM {rows}"


_CELL = "w JOIN leads USING (record_id, lead_no)"
_PLACE = lambda g, f: f"'/{'delineation' if g == 'fiducials' else 'measurements'}/{g}/{f}/values/' || beat || '/' || j"


@query(LINES_SQL + ", r AS (SELECT DISTINCT record_id, custkey FROM v) " + " UNION ALL ".join([
    _error_sql("r WHERE custkey % 23 = 0", "'/acquisition/sample_rate_hz'", "invalid sample_rate_hz"),
    _error_sql("r WHERE custkey % 19 = 0", "'/acquisition/input_mode'", "invalid acquisition input mode"),
    _error_sql("r WHERE custkey % 19 = 0", "'/axes/leads'", "standard_12 requires all canonical leads"),
    _error_sql("r WHERE custkey % 17 = 0", "'/acquisition/amplitude_unit'", "invalid acquisition amplitude unit"),
    _error_sql(f"(SELECT DISTINCT record_id FROM beats WHERE r_sample >= {SAMPLES})", "'/axes/beats'", "beat sample outside acquisition"),
    *(_error_sql(f"{_CELL} WHERE {f} >= {SAMPLES}", _PLACE("fiducials", f), "sample outside acquisition") for f in GROUPS["fiducials"]),
    *(_error_sql(f"{_CELL} WHERE {f} < 0", _PLACE("intervals", f), "negative interval") for f in GROUPS["intervals"]),
    _error_sql(f"{_CELL} WHERE pb", _PLACE("fiducials", "p_onset"), "p_onset/p_offset: fiducial order violated"),
    _error_sql(f"{_CELL} WHERE r_peak < qrs_onset OR r_peak > qrs_offset", _PLACE("fiducials", "qrs_onset"), "qrs_onset/r_peak/qrs_offset: fiducial order violated"),
]))
def document_errors(spark, sf):
    """Every rule that documents of unpublished lines break."""
    return R.violations(spread_out(stored(R.as_json(R.documents(lines(spark, sf), acquisition(spark, sf, clean=False), GROUPS)))))


_HEX = "lpad(to_hex(coalesce(value, 0) & 4294967295), 8, '0')"


@query(CLEAN_SQL + f""", h AS (SELECT record_id, '/' || CASE grp WHEN 'fiducials' THEN 'delineation' ELSE 'measurements' END || '/' || grp || '/' || field AS pointer, beat, j, value, CASE WHEN value IS NULL THEN '02' ELSE '00' END AS state, {_HEX} AS x FROM cells),
p AS (SELECT record_id, pointer, count(*) AS n, upper(string_agg(substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2), '' ORDER BY beat, j)) AS data, string_agg(state, '' ORDER BY beat, j) AS states FROM h GROUP BY ALL)
SELECT record_id, 'sha256:' || sha256(record_id || '@1.0.0' || chr(10) || string_agg(pointer || chr(10) || data || chr(10) || states, chr(10) ORDER BY pointer)) AS sha256, count(*) AS fields, CAST(sum(5 * n) AS BIGINT) AS bytes FROM p GROUP BY record_id""")
def sidecar_digest(spark, sf):
    """The digest that binds each published document to its dense cells."""
    _, cells = R.split_dense(clean_documents(spark, sf))
    return cells.groupBy("record_id", "sha256").agg(F.count(F.lit(1)).alias("fields"), F.sum(F.length("data") + F.length("states")).alias("bytes"))


@query("SELECT DISTINCT 'c' || o_custkey AS record_id, CASE WHEN o_custkey % 5 = 0 THEN 'sidecar_missing' WHEN o_custkey % 7 = 0 THEN 'sidecar_digest' END AS code, o_custkey % 5 <> 0 AND o_custkey % 7 <> 0 AS restored FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def sidecar_round_trip(spark, sf):
    """Dense cells put back into their documents; those of every fifth record are lost and those of every seventh altered."""
    whole = clean_documents(spark, sf)
    docs, cells = R.split_dense(whole)
    k = F.substring("record_id", 2, 20).cast("long")
    cells = cells.where(k % 5 != 0).withColumn("data", F.when((k % 7 == 0) & F.col("pointer").endswith("r_peak"), F.unhex(F.concat(F.lit("FF"), F.substring(F.hex("data"), 3, 1 << 30)))).otherwise(F.col("data")))
    back = R.join_dense(docs, cells)
    # hashed by record: a broadcast would hold a row of every record in the driver
    x = back.select("record_id", "code", R.fingerprint().alias("back")).join(whole.select("record_id", R.fingerprint().alias("was")).hint("shuffle_hash"), "record_id")
    return x.select("record_id", "code", F.coalesce(F.col("back") == F.col("was"), F.lit(False)).alias("restored"))

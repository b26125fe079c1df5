"""Record queries: cells over ``events`` and ``lineitem``, pointers and addresses over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import escape_token, half_even, listed, median, unescape_token
from pulsequilt.operators import records as D
from pulsequilt.plans.registry import query
from pulsequilt.sources.adapters import MARKS_SQL, beats, table

FIELDS = {"view": "p_amplitude_uv", "click": "t_amplitude_uv", "error": "u_amplitude_uv", "signup": "qt_interval_ms", "purchase": "qrs_duration_ms"}
FIELD_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIELDS.items()) + " END"


def cells(spark, sf) -> DataFrame:
    """record_id, grp, field, unit, beat_id, lead, value, reason: six beats a record and day part, leads of mark numbers."""
    field = F.create_map(*(F.lit(v) for kv in FIELDS.items() for v in kv))[F.col("kind")]
    b = beats(spark, sf).select("record_id", (F.col("beat_id") % 6).alias("beat_id"), (F.col("mark") % 4).alias("lead"), field.alias("field"), "amp", "conf")
    g = b.groupBy("record_id", "field", "beat_id", "lead").agg(median("amp").alias("m"), F.max("conf").alias("c"))
    reason = F.when(F.col("c") < 0.2, "low_confidence").when(F.col("m") < 10, "low_amplitude").when(F.col("m") > 120, "out_of_range")
    unit = F.when(F.col("field").endswith("_uv"), "uV").otherwise("ms")
    grp = F.when(F.col("field").endswith("_uv"), "amplitudes").otherwise("intervals")
    return g.select("record_id", grp.alias("grp"), "field", unit.alias("unit"), "beat_id", "lead", F.when(reason.isNull(), half_even(F.col("m"))).alias("value"), reason.alias("reason"))


CELLS_SQL = MARKS_SQL + f""", g AS (SELECT record_id, beat_id % 6 AS beat_id, mark % 4 AS lead, {FIELD_SQL} AS field, median(amp) AS m, max(conf) AS c FROM beats GROUP BY ALL),
r AS (SELECT *, CASE WHEN c < 0.2 THEN 'low_confidence' WHEN m < 10 THEN 'low_amplitude' WHEN m > 120 THEN 'out_of_range' END AS reason FROM g),
cells AS (SELECT record_id, CASE WHEN field LIKE '%/_uv' ESCAPE '/' THEN 'amplitudes' ELSE 'intervals' END AS grp, field, CASE WHEN field LIKE '%/_uv' ESCAPE '/' THEN 'uV' ELSE 'ms' END AS unit, beat_id, lead, CASE WHEN reason IS NULL THEN CAST(round_even(m, 0) AS BIGINT) END AS value, reason FROM r)
"""


@query(CELLS_SQL + ", b AS (SELECT DISTINCT record_id, beat_id FROM cells), l AS (SELECT DISTINCT record_id, lead FROM cells) SELECT b.record_id, b.beat_id, l.lead, c.value FROM b JOIN l ON b.record_id = l.record_id LEFT JOIN cells c ON c.record_id = b.record_id AND c.beat_id = b.beat_id AND c.lead = l.lead AND c.field = 'qt_interval_ms'")
def cells_grid(spark, sf):
    c = cells(spark, sf)
    values = c.where("field = 'qt_interval_ms'").select("record_id", "beat_id", "lead", "value")
    return D.grid(c.select("record_id", "beat_id").distinct(), c.select("record_id", "lead").distinct(), values)


@query(CELLS_SQL + """, m AS (SELECT record_id, field, coalesce(reason, 'unavailable') AS reason, count(*) AS n FROM cells WHERE value IS NULL GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY record_id, field) AS total, count(*) OVER (PARTITION BY record_id, field) AS nr, row_number() OVER (PARTITION BY record_id, field ORDER BY n DESC, reason) AS k FROM m),
s AS (SELECT record_id, field, count(*) AS n_cells FROM cells GROUP BY ALL)
SELECT s.record_id, s.field, n_cells, CAST(coalesce(total, 0) AS BIGINT) AS n_missing, reason AS default_reason, coalesce(total = n_cells AND nr = 1, false) AS whole, CAST(coalesce(total - n, 0) AS BIGINT) AS n_exceptions FROM s LEFT JOIN d ON s.record_id = d.record_id AND s.field = d.field AND k = 1""")
def absence_encode(spark, sf):
    return D.absence(cells(spark, sf))


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber AS lead, l_partkey % 40 AS p_on, l_suppkey % 40 AS p_off, CAST(l_quantity AS BIGINT) AS qrs_on, CAST(l_quantity AS BIGINT) + l_partkey % 11 - 3 AS r_peak, CAST(l_quantity AS BIGINT) + l_suppkey % 13 - 2 AS qrs_off, l_extendedprice AS x FROM lineitem),
f AS (SELECT *, p_on > p_off AS pb, qrs_on > qrs_off AS inv, qrs_on <= qrs_off AND (r_peak < qrs_on OR r_peak > qrs_off) AS outside, p_off - p_on AS p_dur, qrs_off - qrs_on AS qrs_dur, qrs_on - p_on AS pr FROM w)
SELECT k AS record_id, lead, x, CASE WHEN NOT pb THEN p_on END AS p_on, CASE WHEN NOT pb THEN p_off END AS p_off, CASE WHEN NOT (inv OR outside) THEN qrs_on END AS qrs_on, CASE WHEN NOT (inv OR outside) THEN qrs_off END AS qrs_off, CASE WHEN NOT outside THEN r_peak END AS r_peak, CASE WHEN NOT pb AND p_dur >= 0 THEN p_dur END AS p_dur, CASE WHEN NOT (inv OR outside) AND qrs_dur >= 0 THEN qrs_dur END AS qrs_dur, CASE WHEN pr >= 0 THEN pr END AS pr,
  concat_ws(',', CASE WHEN pb THEN 'p_dur:violates_fiducial_order,p_off:violates_fiducial_order,p_on:violates_fiducial_order' END, CASE WHEN pr < 0 THEN 'pr:negative_duration' END, CASE WHEN inv OR outside THEN 'qrs_dur:violates_fiducial_order,qrs_off:violates_fiducial_order,qrs_on:violates_fiducial_order' END, CASE WHEN outside THEN 'r_peak:violates_fiducial_order' END) AS withheld FROM f""")
def invariants(spark, sf):
    q = F.col("l_quantity").cast("long")
    w = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("lead"), F.col("l_extendedprice").alias("x"), (F.col("l_partkey") % 40).alias("p_on"), (F.col("l_suppkey") % 40).alias("p_off"), q.alias("qrs_on"), (q + F.col("l_partkey") % 11 - 3).alias("r_peak"), (q + F.col("l_suppkey") % 13 - 2).alias("qrs_off"))
    w = w.withColumns({"p_dur": F.col("p_off") - F.col("p_on"), "qrs_dur": F.col("qrs_off") - F.col("qrs_on"), "pr": F.col("qrs_on") - F.col("p_on")})
    return D.enforce(w).withColumn("withheld", listed(F.col("withheld")))


@query(CELLS_SQL + "SELECT p.profile, field, count(*) AS n, count(value) AS n_measured FROM cells, (VALUES ('summary'), ('all'), ('debug')) p(profile) WHERE p.profile <> 'summary' OR field <> 'u_amplitude_uv' GROUP BY ALL")
def profile_projection(spark, sf):
    c = cells(spark, sf).select("field", "value")
    out = [D.profile(c, p).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_measured")).select(F.lit(p).alias("profile"), "*") for p in D.PROFILES]
    return out[0].unionByName(out[1]).unionByName(out[2])


POINTER_SQL = "'/measurements/' || grp || '/' || field || '/values/' || beat_id || '/' || lead"
ADDRESS_SQL = f"'ecg-record:' || record_id || '@1.0.0#' || {POINTER_SQL}"


@query(CELLS_SQL + f"SELECT record_id, field, beat_id, lead, value, unit, CASE WHEN value IS NULL THEN 'unmeasurable' ELSE 'measured' END AS state, reason, {ADDRESS_SQL} AS address FROM cells WHERE field = 'qt_interval_ms'")
def point_query(spark, sf):
    """All cells of one field."""
    c = cells(spark, sf).where("field = 'qt_interval_ms'")
    q = c.select(F.lit(0).alias("pos"), "record_id", "field", "beat_id", "lead")
    return D.answer(c, q).drop("pos")


@query(CELLS_SQL + f""", q AS (SELECT event_id AS pos, user_id AS record_id, CASE WHEN event_id % 3 = 0 THEN 'qt_interval_ms' WHEN event_id % 3 = 1 THEN 'p_amplitude_uv' ELSE 'no_such_field' END AS field, event_id % 7 AS beat_id, event_id % 4 AS lead FROM events)
SELECT q.pos, q.record_id, q.field, q.beat_id, q.lead, value, unit, CASE WHEN unit IS NULL THEN 'unknown' WHEN value IS NULL THEN 'unmeasurable' ELSE 'measured' END AS state, CASE WHEN unit IS NOT NULL AND value IS NULL THEN coalesce(reason, 'unavailable') END AS reason,
  CASE WHEN unit IS NOT NULL THEN 'ecg-record:' || q.record_id || '@1.0.0#/measurements/' || grp || '/' || q.field || '/values/' || q.beat_id || '/' || q.lead END AS address
FROM q LEFT JOIN cells c ON q.record_id = c.record_id AND q.field = c.field AND q.beat_id = c.beat_id AND q.lead = c.lead""")
def bulk_query(spark, sf):
    k = F.col("event_id")
    q = table(spark, sf, "events").select(k.alias("pos"), F.col("user_id").alias("record_id"), F.when(k % 3 == 0, "qt_interval_ms").when(k % 3 == 1, "p_amplitude_uv").otherwise("no_such_field").alias("field"), (k % 7).alias("beat_id"), (k % 4).alias("lead"))
    return D.answer(cells(spark, sf), q)


@query(CELLS_SQL + f"SELECT record_id, field, beat_id, lead, {ADDRESS_SQL} AS address FROM cells")
def address_make(spark, sf):
    where = D.pointer(F.lit("measurements"), F.col("grp"), F.col("field"), F.lit("values"), F.col("beat_id"), F.col("lead"))
    return cells(spark, sf).select("record_id", "field", "beat_id", "lead", D.address(F.col("record_id"), where).alias("address"))


@query(r"""WITH a AS (SELECT page_id, 'ecg-record:' || CASE WHEN page_id % 5 = 0 THEN '' ELSE 'rec-' || page_id END || '@' || CASE WHEN page_id % 7 = 0 THEN '1.0' ELSE '1.0.' || page_id % 3 END || '#/' || replace(CASE WHEN page_id % 11 = 0 THEN '~2' ELSE '' END || replace(url, '~', '~0'), '/', '~1') || '/x' AS address FROM pages),
p AS (SELECT *, regexp_matches(address, '^ecg-record:([^@#]+)@([0-9]+\.[0-9]+\.[0-9]+)#((?:/(?:[^~/]|~[01])*)*)$') AS ok FROM a)
SELECT page_id, ok AS valid, CASE WHEN ok THEN regexp_extract(address, '^ecg-record:([^@#]+)@', 1) END AS record_id, CASE WHEN ok THEN regexp_extract(address, '@([0-9]+\.[0-9]+\.[0-9]+)#', 1) END AS version, CASE WHEN ok THEN replace(replace(split_part(regexp_extract(address, '#(.*)$', 1), '/', 2), '~1', '/'), '~0', '~') END AS first_token FROM p""")
def address_parse(spark, sf):
    k = F.col("page_id")
    body = F.replace(F.concat(F.when(k % 11 == 0, "~2").otherwise(""), F.replace(F.col("url"), F.lit("~"), F.lit("~0"))), F.lit("/"), F.lit("~1"))
    a = F.concat(F.lit("ecg-record:"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("rec-"), k.cast("string"))), F.lit("@"), F.when(k % 7 == 0, "1.0").otherwise(F.concat(F.lit("1.0."), (k % 3).cast("string"))), F.lit("#/"), body, F.lit("/x"))
    x = table(spark, sf, "pages").select("page_id", D.parse_address(a).alias("p"))
    return x.select("page_id", F.col("p").isNotNull().alias("valid"), "p.record_id", "p.version", F.get(D.tokens(F.col("p.pointer")), F.lit(0)).alias("first_token"))


@query("SELECT page_id, replace(replace(url || '~' || page_id, '~', '~0'), '/', '~1') AS escaped, url || '~' || page_id AS unescaped FROM pages")
def pointer_escape(spark, sf):
    x = table(spark, sf, "pages").select("page_id", escape_token(F.concat("url", F.lit("~"), F.col("page_id").cast("string"))).alias("escaped"))
    return x.withColumn("unescaped", unescape_token(F.col("escaped")))


@query("SELECT event_id, json_extract_string(props, '/k') AS resolved, json_exists(props, '/k') AS present, json_exists(props, '/missing') AS present_missing FROM events")
def pointer_resolve(spark, sf):
    """Values at pointers of a JSON column, and whether there is one (JSON null counts)."""
    j = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.variant_get(j, "$.k", "string").alias("resolved"), F.variant_get(j, "$.k", "variant").isNotNull().alias("present"), F.variant_get(j, "$.missing", "variant").isNotNull().alias("present_missing"))


RANK_SQL = "list_position(['unvalidated', 'internal', 'benchmarked', 'clinically_validated'], {0})"


@query(f"""WITH t AS (SELECT ['unvalidated', 'internal', 'benchmarked', 'clinically_validated'] AS t), c AS (SELECT doc_id AS name, t[1 + (doc_id % 3 + quality) % 4] AS tier FROM labels, t), r AS (SELECT doc_id AS name, t[1 + (n_chars % 4)] AS ceiling FROM documents, t WHERE doc_id % 10 <> 3)
SELECT c.name, tier, ceiling, CASE WHEN ceiling IS NULL THEN 'no_registry_entry' ELSE 'above_ceiling' END AS violation FROM c LEFT JOIN r USING (name) WHERE ceiling IS NULL OR {RANK_SQL.format('tier')} > {RANK_SQL.format('ceiling')}""")
def registry_ceiling(spark, sf):
    tier = lambda i: F.element_at(F.array(*(F.lit(t) for t in D.TIERS)), (i + 1).cast("int"))
    claims = table(spark, sf, "labels").select(F.col("doc_id").alias("name"), tier((F.col("doc_id") % 3 + F.col("quality")) % 4).alias("tier"))
    registry = table(spark, sf, "documents").where("doc_id % 10 <> 3").select(F.col("doc_id").alias("name"), tier(F.col("n_chars") % 4).alias("ceiling"))
    return D.above_ceiling(claims, registry)


@query("""SELECT event_id, sha256('{"algorithm":"rr","event_type":' || to_json(event_type) || ',"user_id":' || user_id || ',"version":1}') AS fingerprint FROM events""")
def canonical_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", D.fingerprint(("user_id", F.col("user_id")), ("event_type", F.col("event_type")), ("algorithm", F.lit("rr")), ("version", F.lit(1))).alias("fingerprint"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 3")
def top_n_hash(spark, sf):
    return D.first_by_hash(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3).select("source", "doc_id", "rank")


@query("""WITH b AS (SELECT '/orders/' || o_orderkey || '/status' AS pointer, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT '/orders/' || o_orderkey || '/status' AS pointer, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.pointer, b.pointer) AS pointer, CASE WHEN a.pointer IS NULL THEN 'removed' WHEN b.pointer IS NULL THEN 'added' ELSE 'changed' END AS change, b.v AS before, a.v AS after FROM b FULL JOIN a ON a.pointer = b.pointer WHERE a.pointer IS NULL OR b.pointer IS NULL OR a.v IS DISTINCT FROM b.v""")
def pointer_diff(spark, sf):
    o = table(spark, sf, "orders")
    leaf = D.pointer(F.lit("orders"), F.col("o_orderkey"), F.lit("status")).alias("pointer")
    before = o.where("o_orderkey % 7 <> 0").select(leaf, F.col("o_orderstatus").alias("value"))
    after = o.where("o_orderkey % 11 <> 0").select(leaf, F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("value"))
    return D.leaf_diff(before, after)


@query("SELECT l_orderkey AS record_id, l_linenumber AS lead, CAST(round_even(l_extendedprice / 1000.0 * 1000.0, 0) AS BIGINT) AS price_uv, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half_quantity FROM lineitem")
def half_even_units(spark, sf):
    """Whole published units, halves to even."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("lead"), D.microvolts(F.col("l_extendedprice") / 1000.0).alias("price_uv"), half_even(F.col("l_quantity") / 2).alias("half_quantity"))

"""The record document as tables: cells with absence, invariants, profiles, addresses, pointers and queries.

``cells``: record_id, grp, field, unit, beat_id, lead, value (whole numbers in
the field's unit), reason (why a value is missing). One row a cell; a point
query is a filter that Parquet can push down, a bulk query a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import escape_token, half_even, unescape_token

#: Profiles in order, each of which holds the ones before it; fields that only the later ones hold.
PROFILES = ("summary", "all", "debug")
LATER_FIELDS = ("jt_interval_ms", "u_amplitude_uv", "qtc_bazett_ms", "qrs_wide_ms")
TIERS = ("unvalidated", "internal", "benchmarked", "clinically_validated")
ORDER, NEGATIVE, UNAVAILABLE = "violates_fiducial_order", "negative_duration", "unavailable"
SCHEME, VERSION = "ecg-record", "1.0.0"


def grid(beats: DataFrame, leads: DataFrame, values: DataFrame) -> DataFrame:
    """A cell for each beat (record_id, beat_id) and lead of the record (record_id, lead), null where values (record_id, beat_id, lead, value) have none."""
    return beats.join(leads, "record_id").join(values, ["record_id", "beat_id", "lead"], "left")


def microvolts(mv: Column) -> Column:
    return half_even(mv * 1000.0)


def absence(cells: DataFrame) -> DataFrame:
    """Compact absence of each field (record_id, field): the most frequent reason of its missing cells (ties by name) is the default, ``whole`` if it is that of every cell; others are exceptions."""
    missing = cells.where("value is null").groupBy("record_id", "field", F.coalesce("reason", F.lit(UNAVAILABLE)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    best = missing.groupBy("record_id", "field").agg(F.min(F.struct((-F.col("n")).alias("k"), "reason")).alias("b"), F.sum("n").alias("n_missing"), F.count(F.lit(1)).alias("n_reasons"))
    size = cells.groupBy("record_id", "field").agg(F.count(F.lit(1)).alias("n_cells"))
    x = size.join(best, ["record_id", "field"], "left")
    return x.select("record_id", "field", "n_cells", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.col("b.reason").alias("default_reason"), F.coalesce((F.col("n_missing") == F.col("n_cells")) & (F.col("n_reasons") == 1), F.lit(False)).alias("whole"), F.coalesce(F.col("n_missing") + F.col("b.k"), F.lit(0)).alias("n_exceptions"))


def enforce(wide: DataFrame) -> DataFrame:
    """Withholds what contradicts itself: p_on, p_off, qrs_on, r_peak, qrs_off (samples), p_dur, qrs_dur, pr (ms) of a cell, with the fields withheld and why.

    An onset after its offset, or a peak outside, withholds these bounds and
    their duration; a negative duration is withheld; the first reason stays.
    """
    c = F.col
    p_bad = F.coalesce(c("p_on") > c("p_off"), F.lit(False))
    inverted = F.coalesce(c("qrs_on") > c("qrs_off"), F.lit(False))
    outside = ~inverted & F.coalesce((c("r_peak") < c("qrs_on")), F.lit(False)) | ~inverted & F.coalesce(c("r_peak") > c("qrs_off"), F.lit(False))
    bad = {"p_on": p_bad, "p_off": p_bad, "p_dur": p_bad, "qrs_on": inverted | outside, "qrs_off": inverted | outside, "qrs_dur": inverted | outside, "r_peak": outside, "pr": F.lit(False)}
    why = {k: F.when(b & c(k).isNotNull(), ORDER).when(F.lit(k in ("p_dur", "qrs_dur", "pr")) & (c(k) < 0), NEGATIVE) for k, b in bad.items()}
    listed = F.array_compact(F.array(*(F.when(w.isNotNull(), F.concat(F.lit(f"{k}:"), w)) for k, w in sorted(why.items()))))
    kept = {k: F.when(w.isNull(), c(k)).alias(k) for k, w in why.items()}
    others = [x for x in wide.columns if x not in kept]
    return wide.select(*others, *kept.values(), listed.alias("withheld"))


def profile(cells: DataFrame, name: str) -> DataFrame:
    """The cells that a profile holds."""
    rank = PROFILES.index(name)
    return cells if rank else cells.where(~F.col("field").isin(*LATER_FIELDS))


def pointer(*tokens: Column) -> Column:
    """A JSON pointer of tokens."""
    return F.concat(*(F.concat(F.lit("/"), escape_token(t.cast("string"))) for t in tokens))


def address(record_id: Column, pointer: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}:"), record_id.cast("string"), F.lit(f"@{VERSION}#"), pointer)


def parse_address(x: Column) -> Column:
    """struct(record_id, version, pointer) of an address; null if it is none."""
    pattern = rf"^{SCHEME}:([^@#]+)@([0-9]+\.[0-9]+\.[0-9]+)#((?:/(?:[^~/]|~[01])*)*)$"
    part = lambda k: F.regexp_extract(x, pattern, k)
    return F.when(F.regexp_like(x, F.lit(pattern)), F.struct(part(1).alias("record_id"), part(2).alias("version"), part(3).alias("pointer")))


def tokens(pointer: Column) -> Column:
    """The unescaped tokens of a pointer; an empty array for the whole document."""
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(F.transform(F.slice(F.split(pointer, "/"), F.lit(2), F.size(F.split(pointer, "/")) - 1), unescape_token))


def answer(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """Bulk query: queries (pos, record_id, field, beat_id, lead) with value, unit, state (measured or unmeasurable; unknown if there is no such cell), reason and address, in the order of pos when sorted by it."""
    found = queries.join(cells, ["record_id", "field", "beat_id", "lead"], "left")
    state = F.when(F.col("unit").isNull(), "unknown").when(F.col("value").isNull(), "unmeasurable").otherwise("measured")
    where = pointer(F.lit("measurements"), F.col("grp"), F.col("field"), F.lit("values"), F.col("beat_id"), F.col("lead"))
    return found.select("pos", "record_id", "field", "beat_id", "lead", "value", "unit", state.alias("state"), F.when(state == "unmeasurable", F.coalesce("reason", F.lit(UNAVAILABLE))).alias("reason"), F.when(state != "unknown", address(F.col("record_id"), where)).alias("address"))


def above_ceiling(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims (name, tier) whose tier is above their ceiling in the registry (name, ceiling); names without an entry are above any."""
    rank = lambda c: F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col(c))
    x = claims.join(registry, "name", "left")
    return x.withColumn("violation", F.when(F.col("ceiling").isNull(), "no_registry_entry").when(rank("tier") > rank("ceiling"), "above_ceiling")).where("violation is not null")


def fingerprint(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted names, nulls included."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields, key=lambda f: f[0]))), {"ignoreNullFields": "false"}), 256)


def leaf_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves (pointer, value) that changed, went (removed) or came (added)."""
    b = before.select("pointer", F.col("value").alias("before"), F.lit(1).alias("_b"))
    a = after.select("pointer", F.col("value").alias("after"), F.lit(1).alias("_a"))
    x = b.join(a, "pointer", "full_outer")
    kind = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return x.select("pointer", kind.alias("change"), "before", "after").where("change is not null")


def first_by_hash(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of each group whose keys have the least SHA-256; partial ranking keeps no more than n a group and task before the shuffle."""
    w = Window.partitionBy(by).orderBy("hash", key)
    return rows.withColumn("hash", F.sha2(F.col(key).cast("string"), 256)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)

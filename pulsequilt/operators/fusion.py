"""Fusion of boundaries across leads: percentile consensus, order statistics, capped weights, peak anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import let, median, spread


def supported_percentile(x: str, p: float) -> Column:
    """The percentile of four values or more, the median of two or three, or the only value."""
    return F.when(F.count(x) >= 4, F.percentile(x, F.lit(p))).otherwise(median(x))


def beat_consensus(cells: DataFrame, paced: Column) -> DataFrame:
    """Per beat the onset (P10), offset (P75; the median if paced or of under six leads) and wide offset (P90; P75 if paced) of lead cells record_id, beat_id, onset, offset, paced; whole samples, cut towards zero."""
    g = cells.groupBy("record_id", "beat_id").agg(F.count(F.lit(1)).alias("n_leads"), F.bool_or(paced).alias("paced"), supported_percentile("onset", 0.10).alias("on"), median("offset").alias("mid"), supported_percentile("offset", 0.75).alias("late"), supported_percentile("offset", 0.90).alias("wide"))
    off = F.when(F.col("paced") | (F.col("n_leads") < 6), F.col("mid")).otherwise(F.col("late"))
    wide = F.when(F.col("paced"), F.col("late")).otherwise(F.col("wide"))
    return g.select("record_id", "beat_id", "n_leads", F.col("on").cast("long").alias("qrs_on"), off.cast("long").alias("qrs_off"), wide.cast("long").alias("qrs_off_wide"))


def gated_order_stat(cells: DataFrame, boundary: str) -> DataFrame:
    """Per beat the second earliest onset (or second latest offset) of four eligible values or more, else the rounded median of all. cells: record_id, beat_id, value, eligible."""
    low = boundary == "onset"
    e = F.sort_array(F.collect_list(F.when(F.col("eligible"), F.col("value"))), asc=low)
    g = cells.groupBy("record_id", "beat_id").agg(e.alias("e"), median("value").alias("m"))
    enough = F.size("e") >= 4
    name = "confidence_gated_second_earliest" if low else "confidence_gated_second_latest"
    return g.select("record_id", "beat_id", F.when(enough, F.get("e", F.lit(1))).otherwise(F.bround("m", 0)).cast("long").alias("boundary"), F.when(enough, name).otherwise("cluster_median").alias("method"))


def capped_weights(rows: DataFrame, *by: str) -> DataFrame:
    """rows with weight: confidence / max(sigma, 4), scaled down where those of a lead group add up to more than one. rows: confidence, sigma, lead_group."""
    raw = F.col("confidence") / F.greatest(F.coalesce("sigma", F.lit(20.0)), F.lit(4.0))
    x = rows.withColumn("_raw", raw).withColumn("_total", F.sum("_raw").over(Window.partitionBy(*by, "lead_group")))
    return x.withColumn("weight", F.when(F.col("_total") > 1.0, F.col("_raw") / F.col("_total")).otherwise(F.col("_raw"))).drop("_raw", "_total")


def peak_anchor(candidates: DataFrame, radius: float, power: float = 1.0, alone: float = 0.5) -> DataFrame:
    """Per beat the weighted mean of the best cluster of peak candidates, and how many leads support it.

    Every candidate is tried as a centre; a cluster has each lead's heaviest
    candidate within the radius; its score is the summed weight times the
    number of leads to ``power`` (times ``alone`` for one lead); the first best
    centre wins. candidates: record_id, beat_id, lead, peak, weight. A beat's
    candidates (of equal leads and peaks the heaviest) are held together; one
    shuffle by record.
    """
    keys, lead_type = ["record_id", "beat_id"], dict(candidates.dtypes)["lead"]
    known = candidates.where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, "peak")))
    heaviest = spread(known, "record_id").groupBy(*keys, "lead", "peak").agg(F.max("weight").alias("weight"))
    # heaviest first, then the lowest peak; no weight comes last
    item = F.struct(F.col("weight").isNull().alias("no"), (-F.col("weight")).alias("light"), "peak", F.struct("lead").alias("lead"), "weight")
    beats = heaviest.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def joined(s: Column, v: Column) -> Column:
        add = lambda total, x: F.when(x.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + x)
        more = F.struct(F.concat(s["leads"], F.array(v["lead"])).alias("leads"), add(s["w"], v["weight"].cast("double")).alias("w"), add(s["wp"], (v["weight"] * v["peak"]).cast("double")).alias("wp"))
        return F.when(F.array_contains(s["leads"], v["lead"]), s).otherwise(more)

    none = F.struct(F.array().cast(f"array<struct<lead:{lead_type}>>").alias("leads"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("wp"))

    def told(s: Column, centre: Column) -> Column:
        n = F.size(s["leads"]).cast("long")
        score = F.round(s["w"] * F.when(n > 1, F.pow(n.cast("double"), F.lit(power))).otherwise(F.lit(alone)), 9)
        return F.struct(score.alias("score"), (-centre).alias("first"), s["w"].alias("w"), s["wp"].alias("wp"), n.alias("n_leads"))

    def tried(centre: Column) -> Column:
        near = F.filter("all", lambda v: F.abs(v["peak"] - centre) <= radius)
        return let(F.aggregate(near, none, joined), lambda s: told(s, centre))

    centres = F.array_distinct(F.transform("all", lambda v: v["peak"]))
    top = beats.select(*keys, F.array_max(F.transform(centres, tried)).alias("b"))
    return top.select(*keys, (F.col("b.wp") / F.col("b.w")).alias("anchor"), F.col("b.n_leads").alias("n_leads"))


def cap_to_raw(leads: DataFrame, slack: float = 12.0) -> DataFrame:
    """Consensus values over the record's raw maximum (of three at least) and slack become that maximum. leads: record_id, raw, consensus."""
    w = Window.partitionBy("record_id")
    x = leads.withColumns({"n_raw": F.count("raw").over(w), "raw_max": F.max("raw").over(w)})
    return x.withColumn("capped", F.when((F.col("n_raw") >= 3) & (F.col("consensus") > F.col("raw_max") + slack), F.col("raw_max")).otherwise(F.col("consensus")))


def t_fusion_summary(members: DataFrame) -> DataFrame:
    """Support, scaled scatter and reliability of fused T ends per beat: record_id, beat_id, value, lead_group."""
    w = Window.partitionBy("record_id", "beat_id")
    x = members.withColumn("dev", F.abs(F.col("value") - median("value").over(w)))
    g = x.groupBy("record_id", "beat_id").agg(F.count(F.lit(1)).alias("support"), median("value").alias("fused"), (median("dev") * 1.4826).alias("mad"), F.count_distinct("lead_group").alias("n_groups"))
    return g.withColumn("reliable", (F.col("support") >= 4) & (F.col("mad") <= 20.0) & (F.col("n_groups") >= 2))

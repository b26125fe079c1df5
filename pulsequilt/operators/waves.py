"""Beat windows: normalization, areas, correlation, families' medoids and pointwise medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import centred, dot, let, median, total, unit


def zscore(xs: Column) -> Column:
    """Population z-scores; zeros for a constant window."""
    return let(centred(xs), lambda c: let(F.sqrt(dot(c, c) / F.size(c)), lambda sd: F.transform(c, lambda v: F.when(sd > 1e-12, v / sd).otherwise(0.0))))


def trapezoid(xs: Column) -> Column:
    """Area by the trapezoid rule, one sample a step."""
    return total(xs) - (F.get(xs, F.lit(0)) + F.get(xs, F.size(xs) - 1)) / 2.0


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two windows; null if one is constant."""
    return dot(unit(a), unit(b))


def with_units(waves: DataFrame) -> DataFrame:
    return waves.withColumn("u", unit(F.col("samples"))).where("u is not null")


def medoids(waves: DataFrame) -> DataFrame:
    """Each group's window of greatest mean correlation with the others of its group; ties go to the first beat.

    The mean over a group is the dot product with the group's summed unit
    vector, so the group is summed once instead of being paired with itself.
    """
    x = with_units(waves).select("group_id", "beat_id", "u")
    sums = x.select("group_id", F.posexplode("u")).groupBy("group_id", "pos").agg(F.sum("col").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sum"), F.max("n").alias("n"))
    # a group's sum is one row: the windows stream by it
    mean = F.when(F.col("n") > 1, F.round((dot(F.col("u"), F.col("sum")) - 1.0) / (F.col("n") - 1), 9)).otherwise(0.0)
    scored = x.join(sums, "group_id").select("group_id", "beat_id", "n", mean.alias("mean_r"))
    return scored.groupBy("group_id").agg(F.max(F.struct("mean_r", (-F.col("beat_id")).alias("first"), "n")).alias("b")).select("group_id", (-F.col("b.first")).alias("beat_id"), F.col("b.n").alias("n_members"), F.col("b.mean_r").alias("mean_r"))


def median_beats(waves: DataFrame) -> DataFrame:
    """The pointwise median of a group's windows: a row for each group and offset."""
    return waves.select("group_id", F.posexplode("samples").alias("offset", "x")).groupBy("group_id", "offset").agg(median("x").alias("value"), F.count(F.lit(1)).alias("n"))


def adjacent(waves: DataFrame) -> DataFrame:
    """Correlation of each window with the next of its group."""
    w = Window.partitionBy("group_id").orderBy("beat_id")
    x = with_units(waves).withColumns({"next_id": F.lead("beat_id").over(w), "v": F.lead("u").over(w)}).where("next_id is not null")
    return x.select("group_id", "beat_id", "next_id", dot(F.col("u"), F.col("v")).alias("r"))


def extremum(waves: DataFrame) -> DataFrame:
    """Index and signed deviation of each window's sample farthest from its median; the first of equal ones."""
    s = F.col("samples")
    ordered = F.array_sort(s)
    mid = (F.get(ordered, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size(s) / 2).cast("int"))) / 2.0
    best = let(mid, lambda m: F.array_max(F.transform(s, lambda v, i: F.struct(F.round(F.abs(v - m), 9).alias("size"), (-i).alias("first"), (v - m).alias("deviation")))))
    return waves.withColumn("b", best).select("beat_id", "group_id", (-F.col("b.first")).alias("peak"), F.col("b.deviation").alias("deviation"))


def turning_points(waves: DataFrame, k: int = 3) -> DataFrame:
    """The k largest turning points of each window by size, then from left to right."""
    s = F.col("samples")
    inner = F.filter(F.transform(s, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: (p["i"] > 0) & (p["i"] < F.size(s) - 1) & (((p["v"] > F.get(s, p["i"] - 1)) & (p["v"] >= F.get(s, p["i"] + 1))) | ((p["v"] < F.get(s, p["i"] - 1)) & (p["v"] <= F.get(s, p["i"] + 1)))))
    ranked = F.slice(F.array_sort(F.transform(inner, lambda p: F.struct((-F.abs(p["v"])).alias("a"), p["i"].alias("i"), p["v"].alias("v")))), 1, k)
    return waves.select("beat_id", F.posexplode(ranked).alias("rank", "p")).select("beat_id", "rank", F.col("p.i").alias("sample"), F.col("p.v").alias("amp"))

"""Connected components of an edge table, in the shared folder, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, stored

#: Each node's edges are dealt to so many tasks, since any may be a hub.
TASKS = 16


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge (a, b; both long). No edges give no rows.

    Each round points neighbours at the least node they see: larger neighbours
    first, then smaller ones. Stars stay stars, so it ends when a round changes
    nothing; a component of diameter d needs about log d rounds. Rows of hubs are
    dealt to many tasks.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = dealt_join(both, both.groupBy("a").agg(F.min("b").alias("m")), ["a"], F.lit(True), F.xxhash64("b"), tasks=TASKS)
        # larger neighbours, and the node itself, point to the least node of the neighbourhood
        down = seen.select(F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = dealt_join(down, down.groupBy("a").agg(F.min("b").alias("m")), ["a"], F.lit(True), F.xxhash64("b"), tasks=TASKS)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        e = stored(small.distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))

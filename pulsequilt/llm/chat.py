"""Chat formatting after a collapse of cumulative snapshots.

A log often holds each state of a growing conversation. Rolling hashes of turn
prefixes (128 bits: two exclusive-or sums of position-salted hashes of role
and text) tell which logged conversations are prefixes of longer ones; an
anti-join keeps the maximal ones, one (of the least conv_id) of equal ones,
and these are rendered.

Turns go by turn, then role, then text; positions count from one, whatever the
turn numbers are. Null roles and texts are empty. Rows of a null conv_id form
a conversation. Everything is DataFrame code; the prefix sums of a very long
conversation are split by blocks of turn numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turn numbers in a block of the prefix sums.
TURNS = 256


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turn, role, text, position (from one), h1, h2 (of the prefix up to this turn)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / TURNS))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    rows = rows.withColumn("row", F.row_number().over(inside)).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "turn", "role", "text", (F.col("row") + F.col("skipped")).alias("position"))
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.xxhash64(F.lit(k), "position", "role", F.lit("\x00"), "text"))
    by_block = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    by_block = by_block.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"s{k}") for k in (1, 2)))
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"r{k}": F.bit_xor(f"x{k}").over(running) for k in (1, 2)})
    rows = rows.join(by_block, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return rows.select("conv_id", "block", "turn", "role", "text", "position", *(F.col(f"r{k}").bitwiseXOR(F.col(f"s{k}")).alias(f"h{k}") for k in (1, 2)))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no proper prefix of another; of equal ones the least conv_id (null counts as least)."""
    last = hashes.groupBy("conv_id").agg(F.max_by(F.struct("position", "h1", "h2"), "position").alias("x")).select("conv_id", "x.*")
    whole = last.groupBy("position", "h1", "h2").agg(F.min(F.struct("conv_id")).alias("x")).select("position", "h1", "h2", "x.conv_id")
    ends = last.select(F.col("conv_id").alias("c"), F.col("position").alias("end"))
    inner = hashes.select("conv_id", "position", "h1", "h2").join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") < F.col("end")), "left_semi").select("position", "h1", "h2").distinct()
    return whole.join(inner, ["position", "h1", "h2"], "left_anti").select("conv_id", F.col("position").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: maximal conversations with each turn as a header line with its role, its text and an end mark."""
    hashes = stored(prefix_hashes(conversations))
    keep = maximal(hashes)
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    turns = hashes.select("conv_id", "position", turn.alias("turn")).join(keep.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return turns.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "turn"))), lambda t: t["turn"]), "").alias("text"))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS turn
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list(sha256(turn) ORDER BY position) AS turns, string_agg(turn, '' ORDER BY position) AS text FROM t GROUP BY conv_id),
f AS (SELECT conv_id, n_turns, text, turns, turns[1] AS head FROM c)
SELECT conv_id, n_turns, text FROM f
WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.head = f.head AND (o.n_turns > f.n_turns OR (o.n_turns = f.n_turns AND o.conv_id < f.conv_id)) AND o.turns[1:f.n_turns] = f.turns)
"""

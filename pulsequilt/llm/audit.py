"""Filter interaction audit: what five filters remove in every order they could run in.

Each document's failures are worked out once, as bits of one number. The
replay crosses these numbers with the 120 orders (a fixed table, broadcast),
takes the first step that each order fails at, explodes the five steps and adds
up by part, order and step; partial sums combine before the shuffle, so a part
with a third of all rows moves 600 rows a task like any other.

A null text is empty (and fails A alone, or E too where a smaller doc_id is
empty); a null or empty ``lang`` makes the part "". Repeated rows count each;
filter E asks for a smaller doc_id, so equal ids and null ids don't fail each
other, and a null id fails nothing and is failed by nothing. A document is good
or toxic if any of its label rows says so; without one it is neither. No
documents give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, dealt_join, hot_values, stored

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_SPACE = r"[\x20\x09-\x0D]+"
#: Rows are numbered round by so many salts when they are stored; rows of one hot key are dealt by them.
SALTS = 128


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A to D."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = {"A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, "C": 100 * capitals > MOST_CAPITALS * F.length(text), "D": text.rlike("[#$%&*|]")}
    out = F.lit(0)
    for f, fails in tests.items():
        out = out + F.when(fails, BIT[f]).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of FILTERS), good, toxic: one row a document. Texts are read once; what is shuffled are their digests."""
    text = F.coalesce("text", F.lit(""))
    own = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("fails"), F.sha2(text.cast("binary"), 256).alias("blob"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")))
    copies = stored(own.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
    hot = hot_values(copies, "blob", of=own.count())
    whole = dealt_join(own, copies.select("blob", "least"), ["blob"], among("blob", hot), F.col("salt"), "left")
    whole = whole.withColumn("fails", F.col("fails") + F.when(F.col("doc_id") > F.col("least"), BIT["E"]).otherwise(0))
    # rows without an id meet no label: they are dealt by their stored salt instead of meeting in one task
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    whole = whole.withColumn("salt", F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(0).cast("long"))
    return whole.join(marks, ["doc_id", "salt"], "left").select("doc_id", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order and the bits b1 to b5 of its filters: the 120 orders, whatever the input."""
    rows = [("".join(p), *(BIT[f] for f in p)) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{k} int" for k in range(1, 6)))


def replay(marked: DataFrame) -> DataFrame:
    """Every order replayed on the rows of ``failures``: one row for each part, order and step."""
    fails = lambda bit: F.col("fails").bitwiseAND(bit) != 0
    first = F.coalesce(*(F.when(fails(F.col(f"b{k}")), k) for k in range(1, 6)), F.lit(6))
    crossed = marked.crossJoin(F.broadcast(orders(marked.sparkSession))).withColumn("first", first)
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", "first", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in range(1, 6)))).alias("s")).select("*", "s.step", "s.bit")
    here = F.col("first") == F.col("step")
    count = lambda when: F.sum(F.when(when, 1).otherwise(0).cast("long"))
    counted = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(here).alias("removed"),
        count(fails(F.col("bit")) & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(here & (F.col("good") == 1)).alias("good_lost"),
        count(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    # at most 600 rows a part from here on
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    counted = counted.withColumn("letter", letter)
    shares = counted.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "letter"]).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return replay(failures(docs, labels))


#: The same rows by each step's own condition, without masks or first failures.
SQL = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  MAP {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > least.least, false)} AS fail
  FROM w JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, k AS step, filter_order[k] AS letter, good, toxic, fail[filter_order[k]] AS fails,
  (k > 1 AND fail[filter_order[1]]) OR (k > 2 AND fail[filter_order[2]]) OR (k > 3 AND fail[filter_order[3]]) OR (k > 4 AND fail[filter_order[4]]) AS gone,
  len(list_filter(map_values(fail), lambda v: v)) AS n FROM f, o, (VALUES (1), (2), (3), (4), (5)) k(k)),
g AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
  count(*) FILTER (fails AND n = 1) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g"""

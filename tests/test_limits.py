"""Quantiles at a limit are to the last bit those of the SQL."""

import json
import math
import random

import duckdb
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import fused
from pulsequilt.plans import intervals
from pulsequilt.plans.registry import SQL


def test_products_and_sums_are_rounded_once(spark):
    r = random.Random(5)
    rows = [tuple(round(r.uniform(-900, 900), 2) for _ in range(2)) for _ in range(2000)]
    rows = [(a, b, -a * b) if k % 2 else (a, b, a * 0.7) for k, (a, b) in enumerate(rows)] + [(1e300, 1.0, 2.0), (0.0, 3.0, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("*", fused(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert all(g.x == math.fma(g.a, g.b, g.c) for g in got)


def at_limit(spark, tmp_path, late: bool) -> str:
    """Records with two leads away from the rest, which lie as far from the quantile as the limit asks, in exact numbers."""
    r, rows = random.Random(3), []
    while len(rows) < 3000:
        n = r.choice([7, 8, 9])
        d = (n - 1) % 10 / 10
        a, b = sorted(round(r.uniform(1, 5), 2) for _ in range(2))
        rest = a * (1 - d) + b * d + 20 if late else None
        if not late:
            a, b, d = a + 50, b + 50, ((n - 1) * 9 % 10) / 10
            rest = a * (1 - d) + b * d - 35
        if abs(rest - round(rest, 2)) < 1e-9:
            record = len(rows)
            rows += [(100 * record + k, 7 * k, record, "view", v, json.dumps({"k": 50})) for k, v in enumerate([a, b] + [round(rest, 2)] * (n - 2))]
    x = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    x.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def told_apart(spark, tmp_path, name, late):
    sf = at_limit(spark, tmp_path, late)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    want = sorted(con.execute(SQL[name]).fetchall())
    got = getattr(intervals, name)(spark, sf)
    assert 0 < len(want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_late_cluster_at_its_limit(spark, tmp_path):
    told_apart(spark, tmp_path, "qt_late_cluster", True)


def test_raw_core_at_its_limit(spark, tmp_path):
    told_apart(spark, tmp_path, "qt_raw_core", False)

"""Streaming operators as queries: a stream over the stored events is run to its end and what it wrote is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import rounded
from pulsequilt.plans.registry import query
from pulsequilt.sources.adapters import swept_folder, table
from pulsequilt.streaming import online


def _drained(spark: SparkSession, sf: str, make, latest: str) -> DataFrame:
    """The last row of each record and window that make(stream) gives, after everything stored so far.

    Each micro-batch writes what it changed, under its own number (so a batch that is
    run again writes the same); state behind the watermark is dropped. The row with the
    greatest ``latest`` is the last. Executors write below the shared folder.
    """
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf)
    beats = stream.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("mark"), F.col("ts").cast("timestamp").alias("ts"))
    root = swept_folder(spark)
    out = make(beats)
    q = out.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/rows/batch={k}")).outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{root}/rows")
    keys = [c for c in ("record_id", "window") if c in out.columns]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in out.columns if c not in keys)), latest).alias("x")).select(*keys, "x.*")


@query("SELECT user_id AS record_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_beats FROM events GROUP BY ALL")
def stream_daily_beats(spark, sf):
    """Beats a record and day by a windowed streaming aggregate with a watermark. Windows are of UTC days, as are the session's days where it keeps to UTC."""
    x = _drained(spark, sf, online.windowed_counts, "n_beats")
    return x.select("record_id", F.date_format("first", "yyyy-MM-dd").alias("day"), "n_beats")


@query("""WITH r AS (SELECT user_id AS record_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 30000000.0 AS rr FROM events)
SELECT record_id, count(rr) AS n_rr, round(coalesce(avg(rr), 0), 4) + 0.0 AS mean_rr_ms, round(stddev_samp(rr), 4) + 0.0 AS sd_rr_ms FROM r GROUP BY record_id""")
def stream_intervals(spark, sf):
    """Intervals a record by keyed state that runs on over micro-batches."""
    x = _drained(spark, sf, lambda beats: online.running_intervals(beats, us_per_ms=3e7), "n_rr")
    return x.select("record_id", F.col("n_rr"), rounded(F.col("mean_rr_ms"), 4).alias("mean_rr_ms"), rounded(F.col("sd_rr_ms"), 4).alias("sd_rr_ms"))

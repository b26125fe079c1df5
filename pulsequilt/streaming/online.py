"""Online rhythm: windowed statistics and stateful intervals over a stream of beats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def beat_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """record_id, mark, ts (timestamp) from Parquet files of events as they come."""
    s = spark.readStream.schema(schema).parquet(folder)
    return s.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("mark"), F.col("ts").cast("timestamp").alias("ts"))


def windowed_counts(beats: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Beats of each record in tumbling windows; what comes later than the watermark is dropped."""
    return beats.withWatermark("ts", late).groupBy(F.window("ts", width), "record_id").agg(F.count(F.lit(1)).alias("n_beats"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def sessions(beats: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Runs of beats without a pause longer than the gap."""
    return beats.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "record_id").agg(F.count(F.lit(1)).alias("n_beats"))


def running_intervals(beats: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000, us_per_ms: float = 1000.0) -> DataFrame:
    """Per micro-batch and record the count, mean and sum of squared deviations of all intervals so far, by Welford's update; the state is four numbers a record.

    A beat that is not later than one already counted is left out, so no
    interval is negative. The state of a record goes when the watermark (``late``
    behind the newest beat) is ``idle_ms`` past its last beat.
    ``us_per_ms``: microseconds of a millisecond, for tables whose time is scaled.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n, mean, m2 = state.get if state.exists else (None, 0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "mark"])
        for t in rows["ts"].astype("datetime64[us]").astype("int64").tolist():
            if last is not None and t <= last:
                continue
            if last is not None:
                rr = (t - last) / us_per_ms
                n += 1
                delta = rr - mean
                mean += delta / n
                m2 += delta * (rr - mean)
            last = t
        state.update((last, n, mean, m2))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"record_id": [key[0]], "n_rr": [n], "mean_rr_ms": [mean], "sd_rr_ms": [(m2 / (n - 1)) ** 0.5 if n > 1 else float("nan")]})

    timed = beats.withWatermark("ts", late)
    return timed.groupBy("record_id").applyInPandasWithState(step, "record_id long, n_rr long, mean_rr_ms double, sd_rr_ms double", "last long, n long, mean double, m2 double", "update", GroupStateTimeout.EventTimeTimeout)

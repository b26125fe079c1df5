import statistics
import uuid

from pyspark.sql import functions as F

from pulsequilt.streaming import online


def feed(spark, tmp_path, make, mode):
    rows = [(k % 3, k, f"2024-01-01 00:{k // 2:02d}:{30 * (k % 2):02d}") for k in range(60)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    for k, part in enumerate((df.where("event_id < 30"), df.where("event_id >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    s = online.beat_stream(spark, str(tmp_path), "user_id long, event_id long, ts timestamp")
    name = f"s{uuid.uuid4().hex}"
    q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), rows


def test_running_intervals_follow_the_whole_stream(spark, tmp_path):
    got, rows = feed(spark, tmp_path, lambda s: online.running_intervals(s, us_per_ms=3e7), "update")
    last = max((r for r in got if r.record_id == 0), key=lambda r: r.n_rr)
    assert last.n_rr == 19
    rr = [3.0 * 1000 / 1000 for _ in range(19)]
    assert abs(last.mean_rr_ms - statistics.mean(rr)) < 1e-6


def test_windows_count_every_beat(spark, tmp_path):
    got, rows = feed(spark, tmp_path, lambda s: online.windowed_counts(s, "10 minutes"), "complete")
    assert sum(r.n_beats for r in got) == len(rows)


def test_sessions_split_at_pauses(spark, tmp_path):
    got, rows = feed(spark, tmp_path, lambda s: online.sessions(s, "5 minutes"), "complete")
    assert sorted(r.n_beats for r in got) == [20, 20, 20]

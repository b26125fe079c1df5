"""The engine's tables from the relational test tables.

``events`` stands in for beats: a record is a user, two milliseconds stand for
a minute, ``value`` is an amplitude, ``event_type`` a lead or a wave class and
``props.k`` (0 to 99) a confidence in hundredths.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsequilt.functions.expressions import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below that of spark.checkpoint.dir, which the driver and all executors share. Without that setting a temporary folder serves where all run in one process, and nothing does elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pulsequilt-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders of tables that this process stored; they go when Python ends.
_stored: list[str] = []


@atexit.register
def _sweep() -> None:
    from pyarrow import fs

    for path in _stored:
        store, local = fs.FileSystem.from_uri(path)
        if store.get_file_info(local).type == fs.FileType.Directory:
            store.delete_dir(local)


def swept_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that is deleted when Python ends."""
    _stored.append(shared_folder(spark))
    return _stored[-1]


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there, and it is there when an executor is lost."""
    path = swept_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, mark (unique), kind, amp, conf, us: the events without an order."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("mark"), F.col("event_type").alias("kind"), F.col("value").alias("amp"), (k / F.lit(100.0)).alias("conf"), micros("ts").alias("us"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """marks with beat_id (from zero in time order), rr_prev and rr_next in ms: one shuffle by record."""
    w = Window.partitionBy("record_id").orderBy("us", "mark")
    gap = lambda a, b: (a - b) / F.lit(3e7)
    return marks(spark, sf_dir).select("*", (F.row_number().over(w) - 1).cast("long").alias("beat_id"), gap(F.col("us"), F.lag("us").over(w)).alias("rr_prev"), gap(F.lead("us").over(w), F.col("us")).alias("rr_next"))


#: The same in DuckDB, to begin a query with.
MARKS_SQL = """WITH marks AS (SELECT user_id AS record_id, event_id AS mark, event_type AS kind, value AS amp, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0 AS conf, epoch_us(ts) AS us FROM events),
beats AS (SELECT *, row_number() OVER w - 1 AS beat_id, (us - lag(us) OVER w) / 3e7 AS rr_prev, (lead(us) OVER w - us) / 3e7 AS rr_next FROM marks WINDOW w AS (PARTITION BY record_id ORDER BY us, mark))
"""


#: Vectors whose labels make groups of their own.
GROUP_RANGE = 1000


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beat_id, group_id, samples (array of double): embeddings as beat windows of 64 samples; groups are labels within ranges of vec_id, so they grow in number with the table, not in size."""
    group = F.col("label") + 10 * F.floor(F.col("vec_id") / GROUP_RANGE)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("beat_id"), group.cast("long").alias("group_id"), F.col("embedding").cast("array<double>").alias("samples"))


WAVES_SQL = f"""WITH waves AS (SELECT vec_id AS beat_id, CAST(label + 10 * (vec_id // {GROUP_RANGE}) AS BIGINT) AS group_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS samples FROM embeddings)
"""

"""Helpers shared by the training-data operators.

Tables cut lineage as Parquet in the folder that ``spark.checkpoint.dir``
names, which the driver and all executors share. Only where that setting is
absent and Spark runs in one process (tests, notebooks) a temporary folder
takes its place; on a cluster its absence is an error.

Tables that a result is read from must outlive the call that returns it. Those
made within ``sweeping`` are deleted at its end, all others when Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One Arrow batch holds at most this many bytes, whatever the length of its texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process made, without those deleted since.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pulsequilt-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def made(path: str) -> str:
    """path, from now on among the folders to delete."""
    _made.append(path)
    return path


def _delete(paths: list[str]) -> None:
    from pyarrow import fs

    for path in paths:
        store, local = fs.FileSystem.from_uri(path)
        if store.get_file_info(local).type == fs.FileType.Directory:
            store.delete_dir(local)


@contextmanager
def sweeping() -> Iterator[Callable[[str], None]]:
    """Deletes the folders made within, however it ends, but for those given to the function it yields."""
    before, kept = len(_made), set()
    try:
        yield kept.add
    finally:
        gone = [x for x in _made[before:] if x not in kept]
        _made[before:] = [x for x in _made[before:] if x in kept]
        _delete(gone)


@atexit.register
def _sweep() -> None:
    _delete(_made)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: written once, read as often as needed, and there when an executor is lost."""
    spark = df.sparkSession
    path = made(shared_dir(spark))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a stored table; what make stored on its way is deleted once that is written."""
    with sweeping() as keep:
        df = stored(make())
        keep(_made[-1])
    return df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run within; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: A value that more than one in HOT rows hold is hot: its rows are dealt to HOT tasks.
HOT = 128


def hot_values(counts: DataFrame, value: str, n: str = "n", of: int | None = None) -> list:
    """The values of more than one in HOT of all rows (fewer than HOT of them), from a table with a row for each value and its number of rows n; ``of`` is the number of all rows, where it is known."""
    total = counts.agg(F.sum(n)).first()[0] or 0 if of is None else of
    return [r[0] for r in counts.where(F.col(n) * HOT > total).select(value).collect()]


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never sent whole through the driver: for rows that come of exploding or of a Python function, whose number Spark takes for that of the rows they come of."""
    return df.hint("merge")


def dealt_join(many: DataFrame, few: DataFrame, on: list[str], hot: Column, salt: Column, how: str = "inner", tasks: int = HOT) -> DataFrame:
    """many joined with few, which has one row for each ``on``: where ``hot`` (a condition on columns of ``on``) holds, many's rows go to ``tasks`` tasks by ``salt``, and few's row to each of them."""
    name = "dealt_" + uuid.uuid4().hex[:8]
    many = many.withColumn(name, F.when(hot, F.pmod(salt.cast("long"), F.lit(tasks))).otherwise(F.lit(0).cast("long")))
    few = few.withColumn(name, F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return many.join(shuffled(few), [*on, name], how).drop(name)


def among(column: str, values: list) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory that its task freed back to the system when it ends: Spark keeps workers for later tasks, and idle ones would hold it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def by_batch(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with lists in place of Arrow arrays. make() runs once a task and returns the function of a batch's columns."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(released(run), target)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text alone (a null text is empty), under the names doc_id and text; other columns, whatever their names, are gone."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

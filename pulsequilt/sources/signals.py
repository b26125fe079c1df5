"""Signals: a generator in Spark expressions, and readers of array and waveform-database files."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsequilt.functions.expressions import ANGLES

#: Fixed values of the generated beat: offset from R and width in s, amplitude in mV, frontal direction in degrees.
WAVES = ((-0.160, 0.022, 0.15, 50.0), (-0.028, 0.008, -0.10, 40.0), (0.0, 0.011, 1.30, 58.0), (0.030, 0.010, -0.30, 80.0), (0.300, 0.050, 0.35, 45.0))
FIRST_R = 0.5


def generated(records: DataFrame, fs: int = 250, seconds: int = 10) -> DataFrame:
    """record_id, lead, fs, samples (array of double, mV) of limb leads I and II for records (record_id, rr_s): noise-free beats every rr_s from 0.5 s on, without Python."""

    def value(t: Column, rr: Column, angle: float) -> Column:
        phase = F.pmod(t - FIRST_R, rr)
        out = F.lit(0.0)
        for offset, width, amp, direction in WAVES:
            for shift in (F.lit(0.0), rr):
                z = (phase - shift - offset) / width
                out = out + amp * float(np.cos(np.radians(direction - angle))) * F.exp(-0.5 * z * z)
        return out

    n = fs * seconds
    records = records.repartition(records.sparkSession.sparkContext.defaultParallelism, "record_id")  # rows are small and each is much work
    made = [records.select("record_id", F.lit(lead).alias("lead"), F.lit(float(fs)).alias("fs"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: value(i / F.lit(float(fs)), F.col("rr_s"), ANGLES[lead])).alias("samples")) for lead in ("I", "II")]  # noqa: B023
    return made[0].unionByName(made[1])


def disturbed(signals: DataFrame) -> DataFrame:
    """signals with what recordings have besides beats, by record: drift, mains hum in every third, noise in every second, and a flat second in every seventh. Each sample's noise follows from its record and place, so a lost task makes the same again."""
    k = F.col("record_id")

    def value(x: Column, i: Column) -> Column:
        t = i / F.col("fs")
        noise = F.pmod(F.xxhash64(k, "lead", i), F.lit(2001)) / 1000.0 - 1.0
        y = x + F.sin(t * (2 * np.pi * 0.25) + k) * 0.08 + F.when(k % 3 == 0, F.sin(t * (2 * np.pi * 50.0)) * 0.05).otherwise(0.0) + F.when(k % 2 == 0, noise * 0.03).otherwise(0.0)
        return F.when((k % 7 == 0) & (t >= 4.0) & (t < 5.0), 0.0).otherwise(y)

    return signals.withColumn("samples", F.transform("samples", value))


def limb_leads(pairs: DataFrame) -> DataFrame:
    """All six limb leads of records with I and II (record_id, fs, one, two: arrays): III = II - I, aVR = -(I + II) / 2, aVL = I - II / 2, aVF = II - I / 2."""
    one, two = F.col("one"), F.col("two")
    both = lambda f: F.zip_with(one, two, f)
    leads = F.create_map(F.lit("I"), one, F.lit("II"), two, F.lit("III"), both(lambda a, b: b - a), F.lit("aVR"), both(lambda a, b: -(a + b) / 2.0), F.lit("aVL"), both(lambda a, b: a - b / 2.0), F.lit("aVF"), both(lambda a, b: b - a / 2.0))
    return pairs.select("record_id", "fs", F.explode(leads).alias("lead", "samples"))


def pairs_of(signals: DataFrame) -> DataFrame:
    """One row a record with leads I and II side by side."""
    pick = lambda lead: F.max(F.when(F.col("lead") == lead, F.col("samples")))
    return signals.groupBy("record_id").agg(F.max("fs").alias("fs"), pick("I").alias("one"), pick("II").alias("two"))


def scaled(signals: DataFrame, unit: Column) -> DataFrame:
    """Samples in mV whatever their unit (mV, uV or V); null for others."""
    factor = F.when(unit == "mV", 1.0).when(unit == "uV", 1e-3).when(unit == "V", 1e3)
    return signals.withColumn("samples", F.when(factor.isNotNull(), F.transform("samples", lambda x: x * factor)))


def checked(signals: DataFrame, least_fs: float = 100.0, least_s: float = 1.0) -> DataFrame:
    """signals with error_code: the first rule a row breaks, else null."""
    n = F.size("samples")
    bad = F.when(F.col("fs").isNull() | (F.col("fs") < least_fs), "sampling_rate_too_low").when(F.col("samples").isNull() | (n == 0), "empty_signal").when(n < F.col("fs") * least_s, "too_short").when(F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(F.col("lead").contains("|"), "lead_name")
    return signals.withColumn("error_code", bad)


# ---------------------------------------------------------------- files


def read_arrays(spark: SparkSession, path: str, fs: float, leads: list[str]) -> DataFrame:
    """Signals of .npy files (leads by samples; no pickles), one record a file, read where Spark's file listing puts them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                record = name.rsplit("/", 1)[-1].removesuffix(".npy")
                yield pa.RecordBatch.from_arrays([pa.array([record] * len(x)), pa.array(leads[: len(x)]), pa.array([float(fs)] * len(x)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["record_id", "lead", "fs", "samples"])

    return files.mapInArrow(run, "record_id string, lead string, fs double, samples array<double>")


HEADER = re.compile(r"^(\S+)\s+(\d+)\s+([0-9.]+)\S*\s+(\d+)")
SIGNAL = re.compile(r"^(\S+)\s+(\d+)(?:x(\d+))?(?::(\d+))?(?:\+(\d+))?\s+([0-9.]+)(?:\((-?\d+)\))?(?:/(\S+))?\s+(\d+)\s+(-?\d+)(?:\s+(-?\d+)\s+(-?\d+)\s+(\d+))?(?:\s+(.*))?$")
#: How a format's samples lie in a file: type, what zero is written as, and the number that marks a missing sample.
FORMATS = {16: ("<i2", 0, -(1 << 15)), 32: ("<i4", 0, -(1 << 31)), 61: (">i2", 0, -(1 << 15)), 80: ("u1", 128, -128)}
UNITS = {"mV": 1.0, "uV": 1e-3, "V": 1e3}


def parse_header(text: str) -> dict:
    """A single-segment waveform-database header: rate, samples and per signal its file, format, byte offset, gain, baseline, unit and name. What the reader can't decode (other formats, several samples a frame, skew, unknown units) is a ValueError."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    body = [x for x in lines if not x.startswith("#")]
    m = HEADER.match(body[0]) if body else None
    if not m:
        raise ValueError("header line")
    signals = []
    for line in body[1 : 1 + int(m[2])]:
        s = SIGNAL.match(line)
        if not s:
            raise ValueError(f"signal line: {line}")
        if int(s[2]) not in FORMATS or int(s[3] or 1) != 1 or int(s[4] or 0) or (s[8] or "mV") not in UNITS:
            raise ValueError(f"signal line of an unsupported kind: {line}")
        zero = int(s[10])
        signals.append({"file": s[1], "format": int(s[2]), "offset": int(s[5] or 0), "gain": float(s[6]) or 200.0, "baseline": int(s[7]) if s[7] else zero, "unit": s[8] or "mV", "lead": (s[14] or "").strip() or str(len(signals))})
    if len({s["lead"] for s in signals}) != len(signals) or len(signals) != int(m[2]):
        raise ValueError("lead names")
    comments = dict(x.lstrip("# ").split(":", 1) for x in lines if x.startswith("#") and ":" in x)
    return {"record_id": m[1], "fs": float(m[3]), "n_samples": int(m[4]), "signals": signals, "comments": {k.strip(): v.strip() for k, v in comments.items()}}


def decode_file(content: bytes, signals: list[dict], n_samples: int) -> np.ndarray:
    """The samples (signals by time, in mV; missing ones nan) of the signals that share a file, whose samples take turns in it from the byte offset on. An .mat file of 16-bit integers, signals by time, is such a file behind its 24 bytes of head."""
    kinds = {(s["format"], s["offset"]) for s in signals}
    if len(kinds) != 1:
        raise ValueError("signals of one file differ in format or offset")
    [(kind, offset)] = kinds
    dtype, zero, missing = FORMATS[kind]
    raw = np.frombuffer(content, dtype, offset=offset).astype(np.int64) - zero
    if n_samples and raw.size < n_samples * len(signals) or raw.size % len(signals):
        raise ValueError(f"{raw.size} samples in a file of {len(signals)} signals of {n_samples}")
    raw = raw.reshape(-1, len(signals)).T[:, : n_samples or None]
    x = np.where(raw == missing, np.nan, raw.astype(float))
    column = lambda f: np.array([f(s) for s in signals], float)[:, None]
    return (x - column(lambda s: s["baseline"])) / column(lambda s: s["gain"]) * column(lambda s: UNITS[s["unit"]])


#: Bytes of files that one partition reads, about.
PARTITION_BYTES = 64 << 20


class WaveformReader(DataSourceReader):
    """Signals of the files that headers name; a partition is a number of records, by the bytes of the files that share their names."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        files = [x for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File]
        sizes: dict[str, int] = {}
        for x in files:
            stem = x.path.rsplit(".", 1)[0]
            sizes[stem] = sizes.get(stem, 0) + (x.size or 0)
        groups, held = [], PARTITION_BYTES
        for x in sorted(x.path for x in files if x.path.endswith(".hea")):
            if held >= PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(x)
            held += sizes[x.removesuffix(".hea")]
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.value:
            yield from self.record(store, path)

    def record(self, store, path: str) -> Iterator[tuple]:
        """The signals of one header."""
        with store.open_input_file(path) as f:
            head = parse_header(f.read().decode())
        folder = path.rsplit("/", 1)[0]
        for name in dict.fromkeys(s["file"] for s in head["signals"]):
            own = [s for s in head["signals"] if s["file"] == name]
            with store.open_input_file(f"{folder}/{name}") as f:
                rows = decode_file(f.read(), own, head["n_samples"])
            for s, row in zip(own, rows, strict=True):
                yield head["record_id"], s["lead"], head["fs"], row.tolist()


class WaveformSource(DataSource):
    """spark.read.format("waveform_db").load(folder), after spark.dataSource.register(WaveformSource)."""

    @classmethod
    def name(cls) -> str:
        return "waveform_db"

    def schema(self) -> str:
        return "record_id string, lead string, fs double, samples array<double>"

    def reader(self, schema) -> DataSourceReader:
        return WaveformReader(self.options)

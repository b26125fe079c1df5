"""Signal kernels as Spark operators: one Arrow batch row holds a record's leads, so records spread over all tasks and nothing else is grouped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsequilt.functions import dsp, quality


def records(signals: DataFrame) -> DataFrame:
    """record_id, fs, leads (array of names), samples (array of arrays), leads in a fixed order: one shuffle by record."""
    g = signals.groupBy("record_id").agg(F.max("fs").alias("fs"), F.sort_array(F.collect_list(F.struct("lead", "samples"))).alias("x"))
    return g.select("record_id", "fs", F.col("x.lead").alias("leads"), F.col("x.samples").alias("samples"))


#: Rows of results that are sent on together.
ROWS_TOGETHER = 512


def matrices(samples: pa.ListArray) -> Iterator[np.ndarray]:
    """The leads-by-samples matrix of each row of an array of arrays, without boxing any sample."""
    inner = samples.values
    flat = inner.values.to_numpy(zero_copy_only=False)
    outer, bounds = samples.offsets.to_numpy(), inner.offsets.to_numpy()
    for a, b in zip(outer, outer[1:], strict=False):
        yield np.array([flat[bounds[k] : bounds[k + 1]] for k in range(a, b)], float)


def per_record(rows: DataFrame, kernel: Callable[..., list[dict]], schema: str) -> DataFrame:
    """The rows that kernel(record_id, fs, leads, matrix) makes of each record. Spark ends an Arrow batch by its bytes (spark.sql.execution.arrow.maxBytesPerBatch), so a batch is a few recordings however many records a table has."""
    target = rows.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[dict] = []
            for record_id, fs, leads, x in zip(*(batch.column(c).to_pylist() for c in ("record_id", "fs", "leads")), matrices(batch.column("samples")), strict=True):
                made += kernel(record_id, fs, leads, x)
                if len(made) >= ROWS_TOGETHER:
                    yield pa.RecordBatch.from_pylist(made, arrow)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)

    return rows.mapInArrow(run, target)


def filtered(signals: DataFrame, low: float = 0.5, high: float = 40.0, mains: float = 50.0) -> DataFrame:
    """record_id, lead, samples: zero-phase band-pass and notch of each lead."""

    def kernel(record_id, fs, leads, x):
        y = dsp.notch(dsp.bandpass(x, fs, low, high), fs, mains)
        return [{"record_id": record_id, "lead": lead, "samples": row.tolist()} for lead, row in zip(leads, y, strict=True)]

    return per_record(records(signals), kernel, "record_id long, lead string, samples array<double>")


def detected(signals: DataFrame) -> DataFrame:
    """record_id, beat_id, r_sample, time_s."""

    def kernel(record_id, fs, leads, x):
        return [{"record_id": record_id, "beat_id": k, "r_sample": int(r), "time_s": round(float(r / fs), 6)} for k, r in enumerate(dsp.qrs_peaks(x, fs))]

    return per_record(records(signals), kernel, "record_id long, beat_id long, r_sample long, time_s double")


def delineated(signals: DataFrame) -> DataFrame:
    """A row a beat and lead: r_peak, qrs_on, qrs_off, p_on, p_off, t_off (samples), r_amp, t_amp, st80 (mV), and the intervals in ms."""

    def kernel(record_id, fs, leads, x):
        r_at, out = dsp.qrs_peaks(x, fs), []
        for lead, row in zip(leads, x, strict=True):
            for k, b in enumerate(dsp.delineate(row, fs, r_at)):
                gap = lambda a, z: None if b[a] is None or b[z] is None else round((b[z] - b[a]) * 1000 / fs)  # noqa: B023, E731
                out.append({"record_id": record_id, "beat_id": k, "lead": lead, **b, "pr_ms": gap("p_on", "qrs_on"), "qrs_ms": gap("qrs_on", "qrs_off"), "qt_ms": gap("qrs_on", "t_off")})
        return out

    return per_record(records(signals), kernel, "record_id long, beat_id long, lead string, r_peak long, qrs_on long, qrs_off long, p_on long, p_off long, t_off long, r_amp double, t_amp double, st80 double, pr_ms long, qrs_ms long, qt_ms long")


def signal_quality(signals: DataFrame, mains: float = 50.0) -> DataFrame:
    """Spectral shares of each lead and the flags they raise."""

    def kernel(record_id, fs, leads, x):
        out = []
        for lead, row in zip(leads, x, strict=True):
            q = dsp.spectral_quality(row, fs, mains)
            flags = [n for n, bad in (("baseline_wander", q["drift"] > 0.30), ("mains", q["mains"] > 0.15), ("muscle", q["muscle"] > 0.40), ("psqi_out_of_range", not 0.40 <= q["psqi"] <= 0.90), ("flat", float(np.ptp(row)) < 0.05)) if bad]
            out.append({"record_id": record_id, "lead": lead, **q, "flags": flags})
        return out

    return per_record(records(signals), kernel, "record_id long, lead string, drift double, muscle double, mains double, psqi double, flags array<string>")


def lead_scores(signals: DataFrame, mains: float = 50.0, full_scale_mv: float | None = None) -> DataFrame:
    """record_id, lead and all quality scores of each lead; lead by lead, so nothing is shuffled."""
    names = ("baseline_wander", "muscle_noise", "powerline", "clipping", "flat_std", "flat_fraction", "saturation_fraction", "p_sqi", "k_sqi", "b_sqi")
    rows = signals.select("record_id", "fs", F.array("lead").alias("leads"), F.array(F.col("samples").cast("array<double>")).alias("samples")).where(F.size(F.element_at("samples", 1)) > 1)

    def kernel(record_id, fs, leads, x):
        return [{"record_id": record_id, "lead": leads[0], **quality.scores(x[0], fs, mains, full_scale_mv)}]

    return per_record(rows, kernel, "record_id long, lead string, " + ", ".join(f"{n} double" for n in names))


def mains_frequency(signals: DataFrame) -> DataFrame:
    """record_id, mains_hz: 50 or 60, whichever has more power (the median over leads of what lies within 1 Hz); 50 where the rate can't tell (122 Hz or less) or both are alike."""

    def kernel(record_id, fs, leads, x):
        if fs <= 122:
            return [{"record_id": record_id, "mains_hz": 50}]
        f, p = np.fft.rfftfreq(x.shape[1], 1 / fs), np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2
        near = {hz: float(np.median(p[:, np.abs(f - hz) <= 1.0].sum(axis=1))) for hz in (50, 60)}
        return [{"record_id": record_id, "mains_hz": max(near, key=near.get)}]

    return per_record(records(signals), kernel, "record_id long, mains_hz int")


def clustered(waves: DataFrame) -> DataFrame:
    """beat_id, group: online clustering of each record's windows in beat order, groups by falling size; waves: record_id, beat_id, samples. Windows stream through a task, which holds a record's prototypes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, protos = None, []
        for batch in batches:
            raw = []
            for r, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != record:
                    record, protos = r, []
                raw.append(dsp.join_cluster(protos, np.array(w, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.int64())], names=["record_id", "beat_id", "raw"])

    rows = waves.select(F.col("record_id").cast("long").alias("record_id"), F.col("beat_id").cast("long").alias("beat_id"), "samples")
    raw = rows.repartition("record_id").sortWithinPartitions("record_id", "beat_id").mapInArrow(run, "record_id long, beat_id long, raw long")
    sized = raw.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("record_id", "raw")))
    return sized.select("record_id", "beat_id", (F.dense_rank().over(Window.partitionBy("record_id").orderBy(F.desc("n"), "raw")) - 1).cast("long").alias("group"))


def fused_t_ends(members: DataFrame, fs: float) -> DataFrame:
    """One T end a beat of members (record_id, value in samples, weight); the records of an Arrow batch are fused together, since each has a few members."""
    rows = members.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("x")).select(F.col("record_id").cast("long").alias("record_id"), F.col("x.value").cast("array<double>").alias("values"), F.col("x.weight").cast("array<double>").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, weights = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("values", "weights"))
            made = dsp.fuse_all(values, weights, batch.column("values").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), fs)
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), *map(pa.array, made.values())], names=["record_id", *made])

    return rows.mapInArrow(run, "record_id long, boundary long, support long, mad_ms double, ci_ms double")

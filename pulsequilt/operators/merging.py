"""Values and events of a record merged in order: compact clusters around a weighted median, and events of several sources at one place. Rows stream through a task sorted by record; it holds one cluster, or the events within reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_middle(values: list[float], weights: list[float]) -> float:
    """The first of sorted values at which the running weight is half the total."""
    # running weights in plain doubles: sum() would make up for their rounding, and the last of them could miss half of it
    half, run = list(accumulate(weights))[-1] / 2, 0.0
    for v, w in zip(values, weights, strict=True):
        run += w
        if run >= half:
            return v
    return values[-1]


class Compact:
    """Clusters of rising values: a value joins if it is within the radius of the weighted median and the cluster no longer than two radii."""

    def __init__(self, radius: float):
        self.radius = radius
        self.number, self.values, self.weights = -1, [], []

    def join(self, value: float, weight: float) -> int:
        if self.values:
            away = abs(value - weighted_middle(self.values, self.weights))
            if away <= self.radius and max(self.values[-1] - self.values[0], away) <= 2 * self.radius:
                self.values.append(value)
                self.weights.append(weight)
                return self.number
        self.number, self.values, self.weights = self.number + 1, [value], [weight]
        return self.number


class Merged:
    """Events in order of their samples; one within reach of an earlier one merges with it: one that belongs to a complex wins over a blocked one, else the earlier; the greater confidence and all leads stay."""

    def __init__(self, reach: int):
        self.reach = reach
        self.held: list[dict] = []

    def add(self, event: dict) -> list[dict]:
        """Takes an event, gives those that no later one can reach."""
        done = [e for e in self.held if e["sample"] < event["sample"] - self.reach]
        self.held = [e for e in self.held if e["sample"] >= event["sample"] - self.reach]
        for k, e in enumerate(self.held):
            if abs(e["sample"] - event["sample"]) <= self.reach:
                win, lose = (event, e) if event["association"] != "blocked" and e["association"] == "blocked" else (e, event)
                self.held[k] = win | {"confidence": max(win["confidence"], lose["confidence"]), "leads": sorted({*win["leads"], *lose["leads"]})}
                break
        else:
            self.held.append(event | {"leads": sorted(set(event["leads"]))})
        return done


def _streamed(rows: DataFrame, order: list[str], make: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """The rows that add(row) and end() give; make() gives both anew for each record."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, add, end = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if add is None or row["record_id"] != record:
                    out += end() if end else []
                    record, (add, end) = row["record_id"], make()
                out += add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if end and (out := end()):
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.repartition("record_id").sortWithinPartitions("record_id", *order).mapInArrow(run, target)


def compact_clusters(values: DataFrame, radius: float) -> DataFrame:
    """record_id, value, weight, cluster (from 0, in order of values); null values and weights are left out."""

    def make():
        c = Compact(radius)
        return (lambda r: [r | {"cluster": c.join(r["value"], r["weight"])}]), (lambda: [])

    x = values.select(F.col("record_id").cast("long").alias("record_id"), F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight")).where("value is not null and weight is not null")
    return _streamed(x, ["value", "weight"], make, "record_id long, value double, weight double, cluster long")


def merged_events(events: DataFrame, reach: int) -> DataFrame:
    """record_id, sample, time_ms, confidence, association, leads of events merged within reach samples; nulls: a missing association is blocked, a missing confidence 0, missing leads none, and an event without a sample is left out."""

    def make():
        m = Merged(reach)

        def end():
            out, m.held = m.held, []
            return out

        return m.add, end

    x = events.select(F.col("record_id").cast("long").alias("record_id"), F.col("sample").cast("long").alias("sample"), F.col("time_ms").cast("double").alias("time_ms"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce("association", F.lit("blocked")).alias("association"), F.coalesce("leads", F.array().cast("array<string>")).alias("leads")).where("sample is not null")
    return _streamed(x, ["sample", "time_ms", "association"], make, "record_id long, sample long, time_ms double, confidence double, association string, leads array<string>")

"""Means at a limit, and ratios by zero."""

import json

from pyspark.sql import functions as F

from pulsequilt.operators import quality as Q
from pulsequilt.plans.intervals import lead_values
from pulsequilt.plans.leads import chest_and_limb
from pulsequilt.plans.quality import lead_quality


def events(spark, tmp_path, ks):
    """Marks of one lead of a record with these hundredths of confidence, stored the last first."""
    rows = [(12 * i, i, 7, "view", 40.0, json.dumps({"k": k})) for i, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").coalesce(1).sortWithinPartitions(F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_means_are_added_up_in_order_of_marks(spark, tmp_path):
    """Four confidences of mean 0.5: in order of their marks they add up to 2, in the order of the file to less."""
    ks = [43, 83, 45, 29]
    assert ((0.43 + 0.83) + 0.45 + 0.29) / 4 == 0.5 > ((0.29 + 0.45) + 0.83 + 0.43) / 4
    sf = events(spark, tmp_path, ks)
    assert chest_and_limb(spark, sf).first().reliable
    assert lead_values(spark, sf).first().conf == 0.5
    assert lead_quality(spark, sf).first().for_p


def test_family_whose_median_is_zero(spark):
    """Spans of zero in most leads of a family fail no query: all its leads are outliers, as IEEE division has it."""
    x = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 2, 0.0), (1, 0, 4, 3.0), (1, 1, 1, 2.0), (1, 1, 3, 2.0), (1, 1, 5, 9.0), (2, 0, 0, None)], "record_id long, family int, lead int, span double")
    got = {(r.record_id, r.lead): r.outlier for r in Q.outliers_in_family(x, "span", 0.3, 2.5).collect()}
    assert got == {(1, 0): True, (1, 2): True, (1, 4): True, (1, 1): False, (1, 3): False, (1, 5): True, (2, 0): False}

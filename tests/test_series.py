"""Golden cases of series operators, with nulls, ties and edges."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import timeseries as ts
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def series(spark, values, step=3600):
    data = [("k", T0 + timedelta(seconds=i * step), i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, ts timestamp, i int, v double")


def by_i(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_interpolate_golden(spark):
    df = series(spark, [None, 1, None, None, None, None, None, None, 8, None, None])
    assert by_i(ts.interpolate(df, ["k"], [F.col("i")], "v", 5), "v") == [None, 1, 2, 3, 4, 5, 6, None, 8, 8, 8]


def test_interpolate_all_null_and_single(spark):
    assert by_i(ts.interpolate(series(spark, [None, None]), ["k"], [F.col("i")], "v"), "v") == [None, None]
    assert by_i(ts.interpolate(series(spark, [3]), ["k"], [F.col("i")], "v"), "v") == [3]


def test_rolling_golden(spark):
    out = ts.rolling(series(spark, [1, None, 3, 4]), ["k"], [F.col("i")], "v", 2, ("mean", "std", "sum", "count"))
    assert by_i(out, "v_mean") == [1, 1, 3, 3.5]
    assert by_i(out, "v_std")[:3] == [None, None, None] and by_i(out, "v_std")[3] == pytest.approx(math.sqrt(0.5))
    empty = ts.rolling(series(spark, [None, None]), ["k"], [F.col("i")], "v", 2, ("sum", "count"))
    assert by_i(empty, "v_sum") == [None, None] and by_i(empty, "v_count") == [0, 0]


def test_change_golden(spark):
    out = ts.change(series(spark, [1, None, 2, 0, 5]), ["k"], [F.col("i")], "v")
    assert by_i(out, "pct_change") == [None, 0, 1, -1, None]
    assert by_i(out, "diff") == [None, None, None, -2, 5]


def test_resample_has_empty_buckets(spark):
    df = series(spark, [1, 2, 3], step=2 * 3600 + 60)
    means = ts.resample(df, ["k"], "v", 3600).orderBy("ts").collect()
    assert [r["value"] for r in means] == [1, None, 2, None, 3]
    sums = ts.resample(df, ["k"], "v", 3600, "sum").orderBy("ts").collect()
    assert [r["value"] for r in sums] == [1, 0, 2, 0, 3]
    assert [r["value"] for r in ts.resample(df, ["k"], "v", 86400, "median").collect()] == [2]


def test_fill_gaps_step_and_lost_rows(spark):
    data = [("k", T0 + timedelta(minutes=m), float(v)) for m, v in ((0, 0), (10, 1), (20, 2), (25, 9), (60, 6))]
    df = spark.createDataFrame(data, "k string, ts timestamp, v double")
    filled, lost = ts.fill_gaps(df, ["k"], "v", 1800)
    # deltas 10, 10, 5, 35 minutes: the median step is 10, the row at 25 is off the grid
    assert [r["v"] for r in filled.orderBy("ts").collect()] == pytest.approx([0, 1, 2, 3, 4, 5, 6])
    assert [r["v"] for r in lost.collect()] == [9]


def test_fill_gaps_two_rows_and_one(spark):
    two, _ = ts.fill_gaps(series(spark, [1, 2]), ["k"], "v", 3600)
    assert two.count() == 2
    one, _ = ts.fill_gaps(series(spark, [1]), ["k"], "v", 3600)
    assert one.count() == 1


def test_fill_gaps_respects_the_limit(spark):
    df = series(spark, [0, 1, 2, 3]).unionByName(
        spark.createDataFrame([("k", T0 + timedelta(hours=8), 8, 8.0)], "k string, ts timestamp, i int, v double")
    )
    filled, _ = ts.fill_gaps(df, ["k"], "v", 2 * 3600)
    assert [r["v"] for r in filled.orderBy("ts").collect()] == [0, 1, 2, 3, 4, 5, None, None, 8]


def test_anomalies_strict_and_default_threshold(spark):
    df = series(spark, [1.0] * 20 + [100.0])
    assert [r["v"] for r in ts.anomalies_z(df, ["k"], "v", 0).collect()] == [100.0]
    assert ts.anomalies_z(series(spark, [5, 5, 5]), ["k"], "v").count() == 0
    assert [r["v"] for r in ts.anomalies_iqr(df, ["k"], "v").collect()] == [100.0]
    assert [r["v"] for r in ts.anomalies_z(df, [], "v").collect()] == [100.0]


def test_anomaly_summary_of_nulls(spark):
    row = ts.anomaly_summary(series(spark, [None, None]), ["k"], "v").first()
    assert row["total_points"] == 0 and row["anomaly_rate"] is None


def test_dedupe(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, 1), (3, "b", 2)], "id int, k string, o int")
    assert rows(ts.dedupe_keep(df, ["k"], ["o", "id"], "first"), "id") == [(2,), (3,)]
    assert rows(ts.dedupe_keep(df, ["k"], ["o", "id"], "last"), "id") == [(1,), (3,)]
    assert rows(ts.dedupe_keep(df, ["k"], ["o", "id"], False), "id") == [(3,)]

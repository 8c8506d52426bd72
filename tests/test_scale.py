"""Both ways of ordered work, the plain window and the chunked one, give the same rows."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import aggregates, causal, joins, robust, scale, scores, timeseries, windows
from tests.conftest import rows



@pytest.fixture(scope="module")
def obs(tables):
    # one variable holds most rows, some values are null, many values repeat
    e = tables.observations
    v = F.when(F.col("event_id") % 3 != 0, F.round("value", 0))
    return e.select(
        "event_id", F.when(F.col("event_id") % 4 != 0, "hot").otherwise(F.col("variable")).alias("variable"), "ts", v.alias("value")
    ).cache()


def order():
    return [F.col("ts"), F.col("event_id")]


def both(make):
    plain, chunked = make(None), make(100)
    assert plain.columns == chunked.columns
    return rows(plain), rows(chunked)


def same(make):
    a, b = both(make)
    assert len(a) > 0 and len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1e-9) if all(isinstance(v, (int, float)) for v in x) else x == y


def test_position(obs):
    same(lambda h: scale.with_position(obs, ["variable"], order(), hot_rows=h).select("event_id", "_pos"))


def test_position_without_keys(obs):
    same(lambda h: scale.with_position(obs, [], order(), hot_rows=h).select("event_id", "_pos"))


def test_carry_forward(obs):
    same(lambda h: scale.carry_forward(obs, ["variable"], order(), {"x": F.col("value")}, hot_rows=h).select("event_id", "x"))
    same(lambda h: scale.carry_forward(obs, ["variable"], order(), {"x": F.col("value")}, False, h).select("event_id", "x"))


def test_running_sums(obs):
    same(lambda h: scale.running_sums(obs, ["variable"], order(), {"x": F.col("event_id")}, hot_rows=h).select("event_id", "x"))


@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles(obs, discrete):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    same(lambda h: scale.quantiles(obs, ["variable"], "value", probs, h, discrete).select(*probs))


def test_rolling_change_and_lags(obs):
    key = ["variable"]
    same(lambda h: timeseries.rolling(obs, key, order(), "value", 7, ("mean", "median", "count"), h).select("event_id", "value_mean", "value_median", "value_count"))
    same(lambda h: timeseries.change(obs, key, order(), "value", 2, h).select("event_id", "pct_change", "diff"))
    same(lambda h: windows.lags(obs, key, order(), ["value"], 3, h).select("event_id", "value_lag3"))


def test_interpolate_and_gaps(obs, tables):
    same(lambda h: timeseries.interpolate(obs, ["variable"], order(), "value", 2, h).select("event_id", "value"))
    same(lambda h: timeseries.fill_gaps(tables.gappy, ["variable"], "value", 7200, hot_rows=h)[0])


def test_samples_smoothing_sessions(obs):
    key = ["variable"]
    same(lambda h: windows.training_samples(obs, key, order(), "value", 4, 2, h).select("event_id", F.to_json(F.struct("inputs", "targets")).alias("s")))
    same(lambda h: windows.smooth(obs, key, order(), "value", 5, h).select("event_id", "smoothed"))
    same(lambda h: windows.sessions(obs, key, "ts", "event_id", 1800, h).select("event_id", "session"))


def test_rank_based(obs, tables):
    key = ["variable"]
    same(lambda h: aggregates.gini(obs, key, "value", h).select(F.round("gini", 9).alias("g"), "n"))
    same(lambda h: robust.trimmed_mean(obs, key, 0.2, "value", h).select(F.round("value", 9).alias("v")))
    same(lambda h: scores.percent_rank(obs, key, "value", "p", h).select("event_id", "p"))


def test_nearest_and_asof(tables):
    t = tables.treatment.withColumn("s", F.round("balance", -2))
    a, b = t.where("treated = 1"), t.where("treated = 0").withColumnRenamed("unit", "match")
    same(lambda h: joins.join_nearest(a, b, "unit", "match", "s", h))
    labels = tables.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("label"), F.col("o_orderdate").alias("at"))
    same(lambda h: joins.join_asof(labels, tables.features, ["entity"], ["price", "state"], feature_seq="seq", hot_rows=h))


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, None), ("a", 3, 2.0)], "k string, o int, v double")
    out = scale.quantiles(df, ["k"], "v", {"m": 0.5}, hot_rows=1)
    assert rows(out) == rows(scale.quantiles(df, ["k"], "v", {"m": 0.5}))
    z = timeseries.anomaly_summary(df, ["k"], "v")
    assert z.count() == 2


def test_small_input_needs_no_count_job(obs, tables):
    assert scale.estimated_bytes(tables.events) < scale.SMALL_BYTES
    assert scale.chunk_count(tables.events, ["event_type"], None) == 0
    assert scale.chunk_count(obs, ["variable"], 10) > 1


def test_asof_join_in_chunks_keeps_label_columns(spark):
    from datetime import datetime

    from fieldloom.operators.joins import join_asof

    d = [datetime(2024, 1, i) for i in range(1, 9)]
    history = spark.createDataFrame([(1, d[0], 1.0), (1, d[2], None), (1, d[4], 5.0), (2, d[1], 2.0)], "e long, ts timestamp, a double")
    labels = spark.createDataFrame([(1, d[3], "x"), (1, d[6], "y"), (2, d[0], "z")], "e long, at timestamp, l string")
    plain = rows(join_asof(labels, history, ["e"], ["a"]), "l", "a")
    assert plain == rows(join_asof(labels, history, ["e"], ["a"], hot_rows=2), "l", "a") == [("x", 1.0), ("y", 5.0), ("z", None)]

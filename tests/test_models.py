"""Evaluation, feature store, robust aggregation, rasters, text and user callables."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import stats
from fieldloom.operators import callables, evaluate, features, raster, robust, text
from tests.conftest import plan_of, rows


def frame(spark, true, pred):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(true, pred)], "y_true double, y_pred double")


def test_regression_cases(spark):
    r = evaluate.regression(frame(spark, [1, 2, 3, 4], [1.1, 2.2, 2.8, 4.1])).first()
    assert r["rmse"] == pytest.approx(math.sqrt(0.025)) and 0 < r["rmse"] < 0.3
    same = evaluate.regression(frame(spark, [1, 2, 3], [1, 2, 3])).first()
    assert same["mae"] == 0 and same["r2"] == 1
    assert evaluate.regression(frame(spark, [1, 2, 3], [3, 1, 2])).first()["r2"] < 0.5
    flat = evaluate.regression(frame(spark, [2, 2], [1, 2])).first()
    assert flat["r2"] == 0.0
    empty = evaluate.regression(frame(spark, [], [])).first()
    assert (empty["rmse"], empty["r2"], empty["n"]) == (0.0, 0.0, 0)
    assert evaluate.regression(frame(spark, [0, 2], [1, 1])).first()["mape"] == 50.0


def test_classification_cases(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 1], [0, 1, 1, 0, 0])), "y_true int, y_pred int")
    r = evaluate.classification(df, 2).first()
    assert r["accuracy"] == 0.8
    p, q = (2 / 3 + 1) / 2, (1 + 2 / 3) / 2
    assert r["f1"] == pytest.approx(2 * p * q / (p + q))
    assert evaluate.classification(df, 4).first()["precision"] == pytest.approx(p / 2)
    scores = spark.createDataFrame([(1, [0.1, 0.7, 0.7])], "y_true int, y_pred array<double>")
    assert evaluate.evaluate(scores, "classification", 3).first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        evaluate.evaluate(df, "other")


def test_forecast_cases(spark):
    df = frame(spark, [1, 2, 3], [1, 2, 3]).withColumn("y_std", F.lit(1.0))
    r = evaluate.forecast(df).first()
    assert r["coverage"] == 1.0 and r["skill"] == 0.0 and r["sharpness"] == 1.0
    assert r["crps"] == pytest.approx((math.sqrt(2) - 1) / math.sqrt(math.pi), abs=1e-6)


def test_distributions(spark):
    xs = [-2.5, -0.3, 0.0, 0.7, 3.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erf(F.col("x")).alias("e"), stats.norm_ppf(stats.norm_cdf(F.col("x"))).alias("z"))
    for r in df.collect():
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=2e-7) and r["z"] == pytest.approx(r["x"], abs=1e-3)
    ends = spark.range(1).select(stats.norm_ppf(F.lit(0.0)), stats.norm_ppf(F.lit(1.0)), stats.norm_ppf(F.lit(0.5))).first()
    assert tuple(ends) == (-6.0, 6.0, 0.0)
    assert stats.f_upper_p(spark, 3.3158, 2, 30) == pytest.approx(0.05, abs=1e-4)
    p = spark.range(1).select(stats.t_two_sided_p(F.lit(2.0423), F.lit(30.0))).first()[0]
    assert p == pytest.approx(0.05, abs=2e-3)


def test_early_stop(spark):
    loss = [5, 4, 3, 3, 3.5, 2.9, 4, 4, 4, 1]
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(loss)], "run string, step int, loss double")
    r = evaluate.best_epochs(df, "run", "step", "loss", 3).first()
    assert (r["best_step"], r["best_loss"], r["stop_step"]) == (5, 2.9, 8)
    assert evaluate.best_epochs(df, "run", "step", "loss", 2).first()["stop_step"] == 4
    assert evaluate.best_epochs(df, "run", "step", "loss", 50).first()["best_step"] == 9


def test_feature_store(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path))
    store.register("s", "e", "ts", ["a", "b"])
    d = [datetime(2024, 1, i) for i in range(1, 5)]
    schema = "e long, ts timestamp, a double, b string"
    store.ingest("s", spark.createDataFrame([(1, d[0], 1.0, "x"), (1, d[1], None, "y"), (2, d[2], 5.0, None)], schema))
    store.ingest("s", spark.createDataFrame([(1, d[3], 9.0, None), (3, None, 7.0, "n")], schema), now=d[1])
    assert rows(store.get("s", d[1])) == [(1, 1.0, "y"), (3, 7.0, "n")]
    assert rows(store.get("s", d[3], [1])) == [(1, 9.0, "y")]
    labels = spark.createDataFrame([(1, d[2], "l1"), (2, d[0], "l2")], "e long, at timestamp, l string")
    assert rows(store.training_at(labels, "s", "at"), "l", "a", "b") == [("l1", 1.0, "y"), ("l2", None, None)]
    assert store.training(["s"], d[1], d[2]).count() == 3
    assert dict(rows(store.online("s")))["features:s:1"] == '{"a":9.0,"b":"y"}'
    # only the folders of the asked dates are read
    read = store.rows("s", d[2], d[3])[0].select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("event_date=")[1].split("/")[0] for r in read} == {"2024-01-03", "2024-01-04"}
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(store.rows("s", d[2], d[3])[0])
    with pytest.raises(KeyError):
        store.describe("unknown")


def test_sets_merged_along_time(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path), "month")
    store.register("s", "e", "ts", ["a"], seq="n")
    store.register("other", "who", "ts", ["a", "b"])
    d = [datetime(2024, 1, i) for i in range(1, 8)]
    store.ingest("s", spark.createDataFrame([(1, d[0], 2, 1.0), (1, d[0], 1, 9.0), (1, d[4], 0, 5.0), (None, d[1], 0, 3.0)], "e long, ts timestamp, n int, a double"))
    store.ingest("other", spark.createDataFrame([(1, d[2], 7.0, "x"), (1, d[4], None, "y"), (2, d[1], 2.0, None)], "who long, ts timestamp, a double, b string"))
    labels = spark.createDataFrame([(1, d[1], 0.5), (1, d[3], 0.6), (1, d[6], 0.7), (2, d[1], 0.8), (3, d[1], 0.9), (None, d[1], 0.1)], "who long, at timestamp, a double")
    for hot in (None, 2):
        got = store.training_at(labels, ["s", "other"], "at", entity="who", hot_rows=hot)
        assert got.columns == ["who", "at", "a", "a_s", "a_other", "b"]
        assert rows(got, "who", "a", "a_s", "a_other", "b") == sorted([
            (1, 0.5, 1.0, None, None), (1, 0.6, 1.0, 7.0, "x"), (1, 0.7, 5.0, 7.0, "y"), (2, 0.8, None, 2.0, None), (3, 0.9, None, None, None), (None, 0.1, 3.0, None, None)], key=repr)
        line = store.timeline(["s", "other"], d[1], d[5], hot_rows=hot)
        assert rows(line.where("e = 1"), "valid_from", "valid_to", "a", "a_other", "b") == [(d[1], d[2], 1.0, None, None), (d[2], d[4], 1.0, 7.0, "x"), (d[4], d[5], 5.0, 7.0, "y")]
        assert rows(line.where("e = 2"), "valid_from", "valid_to", "a_other") == [(d[1], d[5], 2.0)]
    # an entity with many rows in every set gives as many rows as the sets have, not their product
    many = spark.range(400).select((F.lit(5)).cast("long").alias("e"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), F.lit(0).alias("n"), F.col("id").cast("double").alias("a"))
    store.ingest("s", many)
    store.ingest("other", many.select(F.col("e").alias("who"), (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"), "a", F.lit("z").alias("b")))
    assert store.timeline(["s", "other"], "2024-01-01", "2024-02-01").where("e = 5").count() == 800


def test_robust_edges(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0), ("b", 0, 2.0, 0), ("c", 0, 3.0, 0), ("d", 0, 4.0, 0)], "client string, idx int, value double, num_samples long")
    assert robust.weighted_mean(df, ["idx"]).first()["value"] == 2.5
    assert robust.median(df, ["idx"]).first()["value"] == 2.0
    assert robust.trimmed_mean(df, ["idx"], 0.25).first()["value"] == 2.5
    with pytest.raises(ValueError):
        robust.trimmed_mean(df, ["idx"], 0.5)


def test_privacy(spark):
    df = spark.createDataFrame([("u", "x", 3.0), ("u", "y", 4.0), ("v", "x", 0.5)], "who string, k string, value double")
    sums = {r["k"]: r for r in robust.private_sums(df, "who", "k", "value", 1.0, 1.0, 1e-5, 3).collect()}
    assert sums["x"]["clipped_sum"] == pytest.approx(0.6 + 0.5) and sums["y"]["clipped_sum"] == pytest.approx(0.8)
    again = {r["k"]: r["noisy_sum"] for r in robust.private_sums(df.repartition(3), "who", "k", "value", 1.0, 1.0, 1e-5, 3).collect()}
    assert again["x"] == sums["x"]["noisy_sum"] != sums["x"]["clipped_sum"]
    wide = spark.range(4000).select(F.col("id").alias("who"), F.col("id").alias("k"), F.lit(0.0).alias("value"))
    noise = robust.private_sums(wide, "who", "k", "value", 1.0, 1.0, 1e-5, 3).agg(F.avg("noisy_sum"), F.stddev("noisy_sum")).first()
    std = robust.noise_std(1.0, 1e-5, 1.0)
    assert abs(noise[0]) < 0.3 and noise[1] == pytest.approx(std, rel=0.05)
    rounds = spark.createDataFrame([("a", 2.0, 1.0)] * 5 + [("b", 2.0, 0.1)] * 5, "k string, s double, q double")
    got = {r["k"]: r["epsilon"] for r in robust.privacy_spent(rounds, ["k"], "s", "q", 1e-5, 10.0).collect()}
    want = min(5 * a / 8 + math.log(1e5) / (a - 1) for a in robust.RDP_ORDERS)
    assert got["a"] == pytest.approx(want) and got["b"] < got["a"]


def test_raster_resize_and_mask(spark):
    grid = np.arange(12, dtype=float).reshape(3, 4)
    df = spark.createDataFrame([(0, 3, r, k, float(grid[r, k])) for r in range(3) for k in range(4)], "raster_id int, band int, row int, col int, value double")
    out = {(r["row"], r["col"]): r["value"] for r in raster.resize_bilinear(df, 3, 4, 5, 7).collect()}
    assert len(out) == 35
    for (r, k), v in out.items():
        y, x = r * 2 / 4, k * 3 / 6
        assert v == pytest.approx(y * 4 + x)
    nan = df.withColumn("value", F.when(F.col("col") == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    s = raster.stats(nan, -9999.0).first()
    assert s["nodata"] == 3 and s["valid"] == 9 and s["median"] == np.median(grid[:, 1:])


def test_vector_topk_is_exact(spark, tables):
    e = tables.embeddings
    q = e.where("vec_id IN (1, 7)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = text.vector_topk(e.repartition(5), q, 5).collect()
    data = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in e.collect()}
    for qid in (1, 7):
        cos = {k: float(v @ data[qid] / np.linalg.norm(v) / np.linalg.norm(data[qid])) for k, v in data.items()}
        want = sorted(cos, key=lambda k: (-cos[k], k))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])] == want
    near = {r["vec_id"] for r in text.vector_topk_lsh(e, list(data[7]), 5, width=2.0).collect()}
    assert 7 in near


def test_route_and_evidence(spark):
    df = spark.createDataFrame([("Crop yield and soil under drought",), ("hello",)], "t string")
    got = [r[0] for r in df.select(text.route(F.col("t"))).collect()]
    assert got[0][:2] == ["food_security", "climate"] and got[1] == list(text.DOMAIN_KEYWORDS)


def test_batch_score(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("x"))
    out = callables.batch_score(df, "id", ["x"], lambda: (lambda x: x[:, 0] * 2), batch=7)
    assert out.where("y_pred <> id * 2").count() == 0 and out.count() == 200

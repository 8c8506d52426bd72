import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.stats import f_upper_p, t_p_driver
from fieldloom.operators import bootstrap
from fieldloom.operators import causal as c
from tests.conftest import rows


@pytest.fixture(scope="module")
def chain(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=400)
    y = 0.8 * x + 0.2 * rng.normal(size=400)
    z = 0.5 * y + 0.3 * rng.normal(size=400)
    data = np.column_stack([x, y, z])
    return data, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "i long, x double, y double, z double")


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(1)
    n = 600
    a, b = rng.normal(50, 10, n), rng.normal(size=n)
    t = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.05 * (a - 50) + 0.8 * b)))).astype(float)
    y = 2.0 * t + 0.3 * a + b + rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(t, y, a, b))], "u long, t double, y double, a double, b double")
    return (t, y, np.column_stack([a, b])), df


def rss(y, x):
    x = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ beta) ** 2).sum())


def test_moments_skip_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, float("nan")), (5.0, 4.0)], "a double, b double")
    m = c.moments(df, {"both": ["a", "b"], "a": ["a"]})
    assert m["both"].n == 2 and list(m["both"].mean) == [3.0, 3.0] and m["both"].cross[0, 1] == pytest.approx(4.0)
    assert m["a"].n == 4 and m["a"].cross[0, 0] == pytest.approx(np.var([1, 2, 3, 5]) * 4)


def test_granger_against_numpy(chain, spark):
    data, df = chain
    names, edges = ["x", "y", "z"], {}
    shifted = df.withColumn("y", F.coalesce(F.expr("lag(x, 1) over (order by i)"), F.lit(0.0)) + F.col("y") * 0.5)
    d = np.array([list(r) for r in shifted.orderBy("i").select(*names).collect()])
    for a, b in itertools.permutations(range(3), 2):
        best = (1.0, 0, 0.0)
        for lag in range(1, 4):
            y = d[lag:, b]
            own = np.column_stack([d[lag - i:len(d) - i, b] for i in range(1, lag + 1)])
            full = np.column_stack([own] + [d[lag - i:len(d) - i, a] for i in range(1, lag + 1)])
            df2 = len(y) - 2 * lag - 1
            f = ((rss(y, own) - rss(y, full)) / lag) / (rss(y, full) / df2)
            p = f_upper_p(spark, f, lag, df2)
            if p < best[0]:
                best = (p, lag, f)
        if best[0] < 0.05:
            edges[(names[a], names[b])] = (best[1], best[2])
    got = {(r["cause"], r["effect"]): (r["lag"], r["strength"]) for r in c.granger(shifted, names, [F.col("i")], 3).collect()}
    assert set(got) == set(edges) and ("x", "y") in got
    for k in edges:
        assert got[k][0] == edges[k][0] and got[k][1] == pytest.approx(edges[k][1], abs=1e-3)


def test_pc_against_numpy(chain, spark):
    data, df = chain

    def p(i, j, given):
        if given:
            zz = data[:, given]
            ri, rj = (data[:, k] - zz @ np.linalg.lstsq(zz, data[:, k], rcond=None)[0] for k in (i, j))
        else:
            ri, rj = data[:, i], data[:, j]
        r = np.corrcoef(ri, rj)[0, 1]
        return t_p_driver(spark, r * math.sqrt((len(data) - 2) / (1 - r * r)), len(data) - 2)

    got = {(r["cause"], r["effect"]): r["strength"] for r in c.pc_skeleton(df, ["x", "y", "z"]).collect()}
    want = {("x", "y"), ("y", "z")} | ({("x", "z")} if p(0, 2, [1]) <= 0.05 else set())
    assert set(got) == want and got[("x", "y")] == pytest.approx(abs(np.corrcoef(data[:, 0], data[:, 1])[0, 1]), abs=1e-4)


def newton(t, x):
    z = (x - x.mean(0)) / x.std(0)
    one = np.column_stack([np.ones(len(t)), z])
    beta, penalty = np.zeros(one.shape[1]), np.diag([0.0] + [1.0] * z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-one @ beta))
        beta = beta + np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + penalty, one.T @ (t - p) - penalty @ beta)
    return 1 / (1 + np.exp(-one @ beta))


def test_iptw_and_matching_against_numpy(study):
    (t, y, x), df = study
    ps = newton(t, x)
    p = np.clip(ps, 0.01, 0.99)
    r = c.iptw(df, "t", "y", ["a", "b"]).first()
    assert r["ate"] == pytest.approx((t / p * y).sum() / (t / p).sum() - ((1 - t) / (1 - p) * y).sum() / ((1 - t) / (1 - p)).sum(), abs=1e-8)
    odds = (1 - t) * p / (1 - p)
    assert r["att"] == pytest.approx(y[t == 1].mean() - (odds * y).sum() / odds.sum(), abs=1e-8)
    a, b = np.where(t == 1)[0], np.where(t == 0)[0]
    te = np.array([y[i] - y[b[np.argmin(abs(ps[b] - ps[i]))]] for i in a])
    tc = np.array([y[a[np.argmin(abs(ps[a] - ps[j]))]] - y[j] for j in b])
    m = c.matching(df, "u", "t", "y", ["a", "b"]).first()
    assert m["att"] == pytest.approx(te.mean(), abs=1e-6) and m["ate"] == pytest.approx((te.sum() + tc.sum()) / len(t), abs=1e-6)


def test_regression_effect(study):
    (t, y, x), df = study
    r = c.regression_effect(df, "t", "y", ["a", "b"]).first()
    one = np.column_stack([np.ones(len(t)), t, x])
    beta = np.linalg.lstsq(one, y, rcond=None)[0]
    s2 = ((y - one @ beta) ** 2).sum() / (len(y) - 4)
    assert r["ate"] == pytest.approx(beta[1]) and r["se"] == pytest.approx(math.sqrt(s2 * np.linalg.inv(one.T @ one)[1, 1]))


def test_bootstrap(study):
    (t, y, _), df = study
    r = bootstrap.bootstrap_diff(df, "u", "t", "y", 200).first()
    again = bootstrap.bootstrap_diff(df.repartition(7), "u", "t", "y", 200).first()
    diff = y[t == 1].mean() - y[t == 0].mean()
    se = math.sqrt(y[t == 1].var(ddof=1) / (t == 1).sum() + y[t == 0].var(ddof=1) / (t == 0).sum())
    assert r["lower"] < diff < r["upper"] and r["se"] == pytest.approx(se, rel=0.2) and r["replicates"] == 200
    assert tuple(r) == pytest.approx(tuple(again))


def test_bootstrap_weights_are_poisson_and_the_same_in_sql(spark):
    import duckdb

    digits = spark.range(3000).select("id", bootstrap.weight_digits(F.col("id"), 20, 7).alias("d")).orderBy("id").collect()
    u = np.array([np.frombuffer(r["d"], ">u2")[:20] for r in digits])
    w = np.searchsorted(np.array(bootstrap.STEPS), u, side="right")
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.05)
    assert abs(np.corrcoef(w[:, 0], w[:, 9])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 3], w[1:, 3])[0, 1]) < 0.06
    sql = f"SELECT {bootstrap.weight_sql('id', 'b', 7)} FROM (SELECT unnest(range(3000)) AS id), (SELECT unnest(range(20)) AS b) ORDER BY id, b"
    assert [r[0] for r in duckdb.execute(sql).fetchall()] == w.ravel().tolist()


def test_intervals_of_adjusted_effects(study):
    (t, y, x), df = study
    got = {r["estimate"]: r for r in bootstrap.bootstrap_effects(df, "u", "t", "y", ["a", "b"], 100).collect()}
    assert got["regression"]["value"] == pytest.approx(c.regression_effect(df, "t", "y", ["a", "b"]).first()["ate"])
    assert got["weighting"]["value"] == pytest.approx(c.iptw(df, "t", "y", ["a", "b"]).first()["ate"])
    assert got["regression"]["se"] == pytest.approx(c.regression_effect(df, "t", "y", ["a", "b"]).first()["se"], rel=0.35)
    assert all(r["lower"] < r["value"] < r["upper"] for r in got.values())


def test_counterfactual_interval_refits_the_model(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=2000)
    b = 2 * a + rng.normal(size=2000)
    y = 3 * b + rng.normal(size=2000)
    y[::10] = np.nan
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), None if np.isnan(y[i]) else float(y[i])) for i in range(2000)], "u long, a double, b double, y double")
    r = bootstrap.counterfactual_intervals(df, "u", [("a", "b"), ("b", "y")], {"a": 1.0}, ["y", "a"], 100).collect()
    assert r[0]["lower"] < 6 < r[0]["upper"] and r[0]["upper"] - r[0]["lower"] < 1 and r[0]["p_value"] < 0.05
    model = c.fit_structure(df, [("a", "b"), ("b", "y")])
    assert r[0]["counterfactual"] == pytest.approx(model.propagate({"a": 1.0})["y"])
    assert r[1]["counterfactual"] == 1.0


def test_dose_response_merges_equal_edges(spark):
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate([1, 1, 1, 2, 3, 4, 5, 6])], "d double, y double")
    got = c.dose_response(df, "d", "y", bins=4).orderBy("bin").collect()
    # quartile edges 1, 1, 2.5, 4.25, 6: three bins, the lowest value included
    assert [r["n"] for r in got] == [4, 2, 2] and [r["dose"] for r in got] == [1.25, 3.5, 5.5]


def test_structure_effects_and_shapley(chain, spark):
    data, df = chain
    model = c.fit_structure(df, [("x", "y"), ("y", "z")])
    sxy = np.polyfit(data[:, 0], data[:, 1], 1)
    syz = np.polyfit(data[:, 1], data[:, 2], 1)
    got = c.counterfactual(spark, model, {"x": 2.0}, ["z"]).first()
    assert got["counterfactual"] == pytest.approx(np.polyval(syz, np.polyval(sxy, 2.0))) and got["factual"] == pytest.approx(data[:, 2].mean())
    curve = c.policy_curve(spark, model, "x", [-1.0, 0.0, 1.0], "z").collect()
    assert [r["best"] for r in curve] == [False, False, True]
    sh = {r["factor"]: r["value"] for r in c.shapley(spark, model, {"x": 2.0, "y": 3.0}, "z").collect()}
    assert sum(sh.values()) == pytest.approx(model.propagate({"x": 2.0, "y": 3.0})["z"] - model.propagate({})["z"])
    per_row = c.counterfactual_rows(df, model, {"x": F.col("x") + 1}, "z").agg(F.avg(F.col("counterfactual") - F.col("z"))).first()[0]
    assert per_row == pytest.approx(sxy[0] * syz[0])


def test_far_without_overlap(spark):
    e = spark.createDataFrame([("v", 10.0), ("v", 12.0)], "k string, x double")
    b = spark.createDataFrame([("v", 1.0), ("v", 2.0)], "k string, x double")
    r = c.attributable_risk(e, b, "k", "x").first()
    assert r["far"] == 1.0 and r["p_baseline"] == 0.0


def test_health_burden_truncates(spark):
    df = spark.createDataFrame([(1000, 25.0, 80.0, 0.5), (1000, None, None, None)], "n long, pm double, o double, w double")
    r = c.health_burden(df, "n", "pm", "o", "w").collect()
    rr = 1.062**2
    assert r[0]["deaths"] == int((rr - 1) / rr * 8) and r[0]["cases"] == 20 + 10 + int(0.006 * 1000) + 25 and r[1]["cases"] == 0

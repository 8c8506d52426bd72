"""User aggregates over keys of any size: states instead of rows, merged in order where the order counts."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import mergeable
from fieldloom.operators.mergeable import Aggregate, aggregate, fit_apply
from tests.conftest import plan_of

TOTAL = Aggregate(lambda: 0.0, lambda s, rows: s + float(rows["v"].sum()), lambda a, b: a + b, lambda s: [s])


def runs() -> Aggregate:
    """Number of runs of equal signs along the order, which no unordered merge could tell: (first, last, runs)."""

    def update(state, rows: pd.DataFrame):
        sign = (rows["v"] > 0).tolist()
        return merge(state, (sign[0], sign[-1], 1 + sum(a != b for a, b in zip(sign, sign[1:], strict=False))))

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0], b[1], a[2] + b[2] - (a[1] == b[0])

    return Aggregate(lambda: None, update, merge, lambda s: [s[2]])


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(mergeable, "HELD", 3)
    monkeypatch.setattr(mergeable, "FAN", 2)


def table(spark, n=4000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(key.alias("k"), "id", (F.col("id") * 7919 % 1000 - 500).cast("double").alias("v"))


def test_sums_and_null_keys(spark, small):
    df = table(spark).repartition(40)
    got = {r.k: r.total for r in aggregate(df, ["k"], ["v"], TOTAL, "total double").collect()}
    want = {r.k: r.total for r in df.groupBy("k").agg(F.sum("v").alias("total")).collect()}
    assert got == want and None in got


def test_merges_follow_the_order(spark, small):
    df = table(spark)
    got = {r.k: r.n for r in aggregate(df.repartition(16), ["k"], ["v"], runs(), "n long", ["id"]).collect()}
    want = {}
    last = {}
    for r in df.orderBy("id").collect():
        sign = r.v > 0
        want[r.k] = want.get(r.k, 0) + (last.get(r.k) is not sign)
        last[r.k] = sign
    assert got == want


def test_no_keys_empty_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1, 1.0), (float("nan"), 2, 2.0), (None, 1, 4.0)], "a double, b int, v double").repartition(3)
    assert [r.total for r in aggregate(df, [], ["v"], TOTAL, "total double").collect()] == [7.0]
    got = aggregate(df, ["a"], ["v"], TOTAL, "total double").collect()
    assert sorted((r.a is None, r.a is not None and math.isnan(r.a), r.total) for r in got) == [(False, True, 3.0), (True, False, 4.0)]
    assert len(aggregate(df, ["a", "b"], ["v"], TOTAL, "total double").collect()) == 3
    assert aggregate(df.limit(0), ["a"], ["v"], TOTAL, "total double").collect() == []


def test_a_fit_meets_all_rows_of_its_key(spark, small):
    df = table(spark)

    def share(key, fitted, rows):
        return pd.DataFrame({"id": rows["id"], "share": rows["v"] / fitted[0], "hot": key == ("hot",)})

    got = fit_apply(df, ["k"], ["v"], TOTAL, "total double", share, "id long, share double, hot boolean")
    sums = df.groupBy("k").agg(F.sum("v").alias("s")).collect()
    total = {r.k: r.s for r in sums}
    by_id = {r.id: (r.k, r.v) for r in df.collect()}
    rows = got.collect()
    assert len(rows) == len(by_id)
    for r in rows:
        k, v = by_id[r.id]
        assert (r.share == pytest.approx(v / total[k]) if total[k] else True) and r.hot == (k == "hot")


def test_rows_are_not_gathered_by_key(spark):
    """Rows reach Python where they are; only states are shuffled."""
    plan = plan_of(aggregate(table(spark), ["k"], ["v"], TOTAL, "total double"))
    assert plan.count("MapInArrow") == 3 and "FlatMapGroups" not in plan

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalar
from fieldloom.operators import filters, quality
from fieldloom.schemas import RECORDS, Check, in_range
from tests.conftest import plan_of, rows


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_bbox_valid(spark):
    def v(*box):
        return one(spark, filters.bbox_valid(*[F.lit(float(x)) for x in box]))[0]

    assert v(-122.5, 37.7, -122.3, 37.9)
    assert not v(-200, 0, 0, 0) and not v(0, 0, -10, 10) and not v(0, 50, 10, -50)


def test_sanitise_order(spark):
    text = "  a\x00b " + "x" * 2000
    got = one(spark, quality.sanitize_text(F.lit(text)), quality.sanitize_text(F.lit("hello\x00world")), quality.sanitize_text(F.lit("y" * 500), 100))
    assert got[0] == text[:1000].replace("\x00", "").strip() and got[1] == "helloworld" and len(got[2]) == 100


@pytest.mark.parametrize("text,bad", [
    ("MATCH (n) DETACH DELETE n", True), ("DROP something", True), ("load   csv from x", True), ("call x dbms y", True),
    ("temperature", False), ("San Francisco", False), ("dropped", False),
])
def test_unsafe(spark, text, bad):
    assert one(spark, quality.unsafe_text(F.lit(text)))[0] is bad


def test_gate_names_the_failed_checks(spark):
    checks = RECORDS["air_quality"].checks()
    data = [(1, 10.0, 20.0, 100), (2, 10.0, 95.0, 501), (3, None, None, None)]
    df = spark.createDataFrame(data, "id int, longitude double, latitude double, aqi int").withColumn("ts", F.lit(datetime(2024, 1, 1)))
    good, bad = quality.quality_gate(df, checks)
    assert rows(good, "id") == [(1,)]
    got = {r["id"]: r["reasons"] for r in bad.collect()}
    assert got == {2: ["latitude_range", "aqi_range"], 3: ["aqi_missing"]}


def test_nan_fails_a_range(spark):
    df = spark.createDataFrame([(float("nan"),), (0.5,)], "x double")
    good, bad = quality.quality_gate(df, [in_range("x", 0, 1)])
    assert good.count() == 1 and bad.count() == 1


def test_every_record_schema_parses(spark):
    for name, record in RECORDS.items():
        df = spark.createDataFrame([], record.ddl)
        assert quality.quality_gate(df, record.checks())[0].columns == df.columns, name


def test_swapped_coordinates(spark):
    df = spark.createDataFrame([(1, "120.5", 45.0), (2, "-130", 95.0), (3, "x", -10.0), (4, None, 5.0)], "id int, LAT string, Lng double")
    out = {r["id"]: (r["latitude"], r["longitude"]) for r in quality.normalize_coords(df).collect()}
    assert out == {1: (45.0, 120.5), 2: (90.0, -130.0), 3: (-10.0, None), 4: (5.0, None)}


def test_guarded(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    out, before, after = quality.guarded(df, lambda d: d.where("v > 5"), {"v": "double"}, name="g1")
    out.count()
    with pytest.raises(ValueError):
        quality.assert_not_empty(before, after)
    with pytest.raises(ValueError):
        quality.guarded(df, lambda d: d, {"w": "double"})


def test_props_map_drops_nulls(spark):
    df = spark.createDataFrame([(1, None, (2.0, "x"))], "id int, a string, n struct<p: double, q: string>")
    assert quality.props_map(df, ["id"]).first()["props"] == {"n_p": "2.0", "n_q": "x"}


def test_pagination(spark):
    df = spark.range(95).withColumnRenamed("id", "k")
    page = filters.paginate(df, [F.col("k")], 5, 20).collect()
    assert [r["k"] for r in page] == list(range(80, 95)) and not page[0]["has_next"] and page[0]["total"] == 95
    assert filters.paginate(df, [F.col("k")], 4, 20).first()["has_next"]
    with pytest.raises(ValueError):
        filters.paginate(df, [F.col("k")], 0, 20)


def test_filters_reach_the_scan(tables):
    plan = plan_of(filters.filter_time(filters.filter_attrs(tables.events, {"event_type": "click"}, {"value": 5}), "2024-01-05", "2024-01-08"))
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(event_type,click)" in pushed and "GreaterThanOrEqual(ts" in pushed and "GreaterThanOrEqual(value,5" in pushed


def test_filter_radius_near_the_pole_and_the_antimeridian(spark):
    df = spark.createDataFrame([(1, 179.9, 0.0), (2, -179.9, 0.0), (3, 10.0, 89.9), (4, -170.0, 89.9)], "id int, lon double, lat double")
    assert rows(filters.filter_radius(df, 180.0, 0.0, 50_000, "id"), "id") == [(1,), (2,)]
    assert rows(filters.filter_radius(df, 0.0, 90.0, 50_000, "id"), "id") == [(3,), (4,)]


def test_filter_entities_list_and_frame(spark):
    df = spark.range(5000).withColumnRenamed("id", "entity")
    assert filters.filter_entities(df, [1, 2, 9999]).count() == 2
    assert filters.filter_entities(df, list(range(1500))).count() == 1500


def test_aqi_edges(spark):
    def a(p, v):
        return one(spark, scalar.aqi(F.lit(p), F.lit(float(v))))[0]

    assert [a("pm25", v) for v in (0, 12, 35.4, 55.4, 150.4, 250.4, 1000)] == [0, 50, 100, 150, 200, 300, 500]
    assert a("pm10", 154) == 100 and a("o3", 70) == 100 and a("no2", 400) == 500 and a("no2", -3) == 0


def test_partial_dates(spark):
    texts = ["2024", "2024-06", "2024-06-05T01:02:03Z", "2024-06-05 or so", "June", "2024-13-40"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.partial_date(F.col("t")).alias("d"))
    got = [r["d"] for r in df.collect()]
    assert got[:4] == [datetime(2024, 1, 1), datetime(2024, 6, 1), datetime(2024, 6, 5, 1, 2, 3), datetime(2024, 6, 5)] and got[4:] == [None, None]


def test_softmax_and_scores(spark):
    row = one(spark, scalar.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), scalar.normalised_difference(F.lit(0.0), F.lit(0.0)),
              scalar.rescale(F.lit(5.0), F.lit(2.0), F.lit(2.0)))
    assert row[0] == [0.5, 0.5] and row[1] == 0.0 and row[2] == 0.5

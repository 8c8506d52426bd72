import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators import joins, spatial
from tests.conftest import plan_of, rows

R = 6371008.8


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * R * np.arcsin(np.minimum(np.sqrt(a), 1))


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(5)
    lon = np.concatenate([rng.uniform(-180, 180, 60), rng.uniform(178, 180, 15), rng.uniform(-180, -178, 15), np.full(12, 30.0)])
    lat = np.concatenate([rng.uniform(-90, 90, 60), rng.uniform(-2, 2, 30), np.full(12, 10.0)])
    lat[:6] = [89.9, 89.5, -89.9, 90.0, -90.0, 88.0]
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))]
    return data, spark.createDataFrame(data, "id int, lon double, lat double")


@pytest.mark.parametrize("metres", [50_000.0, 400_000.0, 3_000_000.0, 15_000_000.0])
def test_distance_join_is_brute_force(places, metres):
    data, df = places
    got = rows(spatial.join_distance(df, df, metres, "id", "id", self_join=True), "a", "b")
    want = sorted(((a[0], b[0]) for a in data for b in data if a[0] < b[0] and haversine(a[1], a[2], b[1], b[2]) < metres), key=repr)
    assert got == want


def test_count_near_counts_copies(places):
    data, df = places
    got = dict(rows(spatial.count_near(df, df, 400_000.0, "id")))
    for a in data:
        assert got[a[0]] == sum(haversine(a[1], a[2], b[1], b[2]) < 400_000 for b in data)


def test_no_nested_loops(places, tables):
    _, df = places
    plans = [
        spatial.join_distance(df, df, 400_000.0, "id", "id", True), spatial.join_point_bbox(tables.points, tables.boxes, size=36.0),
        spatial.join_bbox_overlap(tables.boxes, "box", 36.0), spatial.count_near(df, df, 1000.0, "id"),
    ]
    for p in plans:
        text = plan_of(p)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_boxes_touch_at_edges_and_repeat_once(spark):
    boxes = spark.createDataFrame(
        [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 10.0, 20.0, 20.0), (3, -170.0, -80.0, 170.0, 80.0), (4, 50.0, 85.0, 60.0, 90.0)],
        "id int, min_lon double, min_lat double, max_lon double, max_lat double",
    )
    got = rows(spatial.join_bbox_overlap(boxes, "id", 3.0))
    assert got == sorted([(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)], key=repr)


def test_point_in_polygon_left(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (5.0, 8.0)]
    poly = spark.createDataFrame([("t", [{"lon": x, "lat": y} for x, y in ring])], "name string, ring array<struct<lon: double, lat: double>>")
    pts = spark.createDataFrame([(1, 5.0, 2.0), (2, 9.9, 7.0), (3, 50.0, 50.0)], "id int, lon double, lat double")
    assert rows(spatial.join_point_polygon(pts, poly, how="left"), "id", "name") == sorted([(1, "t"), (2, None), (3, None)], key=repr)
    assert rows(spatial.join_point_polygon(pts, poly), "id") == [(1,)]


def test_area_and_bbox_of_a_square(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    r = spark.range(1).select(geo.ring_area_km2(ring).alias("a"), *[c.alias(n) for c, n in zip(geo.ring_bbox(ring), "wsen")]).first()
    assert r["a"] == pytest.approx(12363.7, rel=1e-3) and tuple(r)[1:] == (0.0, 0.0, 1.0, 1.0)


def test_nearest_is_brute_force_with_ties(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, 100.0), (4, 6.0)], "u int, s double")
    b = spark.createDataFrame([(10, 4.0), (11, 6.0), (12, 6.0), (13, 4.0)], "m int, s double")
    for hot in (None, 1):
        got = rows(joins.join_nearest(a, b, "u", "m", "s", hot))
        assert got == [(1, 10, 1.0), (2, 10, 4.0), (3, 11, 94.0), (4, 11, 0.0)]


def test_asof_takes_the_last_known_value_of_each_column(spark):
    f = spark.createDataFrame([(1, 1, 10.0, None), (1, 3, None, "x"), (1, 5, 30.0, "y"), (2, 1, 1.0, "z")], "e int, ts int, p double, q string")
    l = spark.createDataFrame([(1, 0, "a"), (1, 3, "b"), (1, 4, "c"), (1, 9, "d"), (3, 1, "e")], "e int, at int, name string")
    got = {r["name"]: (r["p"], r["q"]) for r in joins.join_asof(l, f, ["e"], ["p", "q"]).collect()}
    assert got == {"a": (None, None), "b": (10.0, "x"), "c": (10.0, "x"), "d": (30.0, "y"), "e": (None, None)}


def test_outer_join_suffix_and_many_to_many(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "e int, v int")
    b = spark.createDataFrame([(1, 7), (1, 8), (4, 9)], "e int, v int")
    out = joins.join_feature_outer({"a": a, "none": None, "b": b}, "e")
    assert out.columns == ["e", "v", "v_b"] and out.count() == 6


def test_optional_join_keeps_the_left(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "f int, t string")
    assert rows(joins.join_optional(a, b, "k", "f"), "k", "t", "matches") == sorted([(1, "x", 2), (1, "y", 2), (2, None, 0)], key=repr)


def test_tile_round_trip(spark):
    df = spark.createDataFrame([(-122.4, 37.8), (0.0, 0.0), (179.99, -85.0), (10.0, 89.0)], "lon double, lat double")
    t = df.withColumn("t", geo.tile_of(F.col("lon"), F.col("lat"), 9))
    w, s, e, n = geo.tile_bounds(F.col("t"))
    for r in t.select("lon", "lat", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")).collect():
        assert r["w"] <= r["lon"] <= r["e"] and (abs(r["lat"]) > 85.05 or r["s"] - 1e-9 <= r["lat"] <= r["n"] + 1e-9)


def test_a_crowded_cell_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "UNIT_ROWS", 16)
    monkeypatch.setattr(spatial, "TASK_PAIRS", 500)
    monkeypatch.setattr(spatial, "PLACE_KEYS", 4)
    rng = np.random.default_rng(8)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(1, 4, 150), rng.uniform(1, 4, 150)))]
    data += [(200 + i, 2.0, 2.0) for i in range(40)] + [(300, 2.0, 2.0), (300, 2.0, 2.0), (None, 2.0, 2.0), (301, None, 2.0)]
    df = spark.createDataFrame(data, "id int, lon double, lat double").coalesce(1)
    boxes = df.select("id", F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"), (F.col("lon") + 0.5).alias("max_lon"), (F.col("lat") + 0.5).alias("max_lat"))
    known = [d for d in data if None not in d]
    pairs = spatial.join_bbox_overlap(boxes, "id", 6.0)
    assert rows(pairs) == sorted(((a[0], b[0]) for a in known for b in known if a[0] != b[0] and abs(a[1] - b[1]) <= 0.5 and abs(a[2] - b[2]) <= 0.5), key=repr)
    near = spatial.join_distance(df, df, 50_000.0, "id", "id", True, digits=1)
    assert rows(near, "a", "b") == sorted(((a[0], b[0]) for a in known for b in known if a[0] < b[0] and haversine(a[1], a[2], b[1], b[2]) < 50_000), key=repr)
    both = rows(spatial.join_distance(df, df.where("id < 250"), 1.0, "id", "id"), "a", "b")
    there = [d for d in data if d[1] is not None]
    assert both == sorted(((a[0], b[0]) for a in there for b in there if b[0] is not None and b[0] < 250 and a[1:] == b[1:]), key=repr)
    for out in (pairs, near):
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(parts) > 3 and max(parts) < sum(parts) / 2

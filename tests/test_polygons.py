import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators.polygons import edge_cells, inner_point, join_polygons, polygon_edges, polygon_rings
from tests.conftest import plan_of, rows

SCHEMA = "id string, rings array<array<struct<lon:double,lat:double>>>"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def table(spark, named):
    data = [(k, None if r is None else [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in r]) for k, r in named]
    return spark.createDataFrame(data, SCHEMA)


A = [
    ("plain", [square(0, 0, 10)]), ("holed", [square(0, 0, 10), square(4, 4, 2)]), ("far", [square(100, 50, 5)]),
    ("null", None), ("line", [[(0, 0), (5, 5)]]), ("notch", [[(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]]),
]
B = [
    ("same", [square(0, 0, 10)]), ("small", [square(1, 1, 1)]), ("plug", [square(4, 4, 2)]), ("inplug", [square(4.5, 4.5, 1)]), ("around", [square(3, 3, 4)]),
    ("ring", [square(3, 3, 4), square(4, 4, 2)]), ("edge", [square(0, 2, 2)]), ("outer", [square(10, 2, 2)]), ("corner", [square(10, 10, 2)]),
    ("over", [square(8, 8, 5)]), ("big", [square(-5, -5, 30)]), ("bridge", [[(1, 9), (9, 9), (9, 9.5), (1, 9.5)]]), ("off", [square(-60, -60, 3)]), ("none", []),
    ("tip", [[(4, 1), (6, 1), (5, 5)]]), ("closed", [[*square(1, 1, 1), (1, 1)]]),
]
INTERSECTS = {
    "plain": "same small plug inplug around ring edge outer corner over big bridge tip closed",
    "holed": "same small plug around ring edge outer corner over big bridge tip closed",
    "notch": "same small plug inplug around ring edge outer corner over big bridge tip closed",
}
CONTAINS = {
    "plain": "same small plug inplug around ring edge bridge tip closed",
    "holed": "small ring edge bridge closed",
    "notch": "small edge tip closed",
}


@pytest.mark.parametrize("size", [1.0, 7.0, 60.0])
def test_relations_by_hand(spark, size):
    a, b = table(spark, A), table(spark, B)
    want = sorted((k, v) for k, vs in INTERSECTS.items() for v in vs.split())
    # the notch leaves out what lies above its tip
    assert rows(join_polygons(a, b, "id", "id", "intersects", size=size)) == want
    want = sorted((k, v) for k, vs in CONTAINS.items() for v in vs.split())
    assert rows(join_polygons(a, b, "id", "id", "contains", size=size)) == want
    assert rows(join_polygons(b, a, "id", "id", "within", size=size)) == sorted((v, k) for k, v in want)


def test_left_keeps_all_and_empty_tables(spark):
    a, b = table(spark, A), table(spark, B)
    got = join_polygons(a, b, "id", "id", "contains", "left")
    assert {r.a for r in got.where("b IS NULL").collect()} == {"far", "null", "line"} and got.count() == sum(len(v.split()) for v in CONTAINS.values()) + 3
    for relation in ("intersects", "contains", "within"):
        assert join_polygons(a.limit(0), b, "id", "id", relation).collect() == []
        assert join_polygons(a, b.limit(0), "id", "id", relation, "left").count() == len(A)


def test_stars_as_brute_force(spark):
    """Random stars in general position: edges cross, or one vertex tells."""
    rng = np.random.default_rng(4)

    def star(k):
        angles = (np.arange(9) + rng.uniform(0, 0.8, 9)) * 2 * np.pi / 9
        x, y, r = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(0.5, 12)
        return [(x + r * d * np.cos(t), y + r * d * np.sin(t)) for t, d in zip(angles, rng.uniform(0.6, 1, 9))]

    shapes = [(f"s{k}", [star(k)]) for k in range(60)]

    def edges(p):
        return list(zip(p, p[1:] + p[:1]))

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def crossing(p, q):
        return any(cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0 for a, b in edges(p) for c, d in edges(q))

    def inside(v, p):
        return sum((a[1] > v[1]) != (b[1] > v[1]) and v[0] < (b[0] - a[0]) * (v[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges(p)) % 2 == 1

    df = table(spark, shapes)
    polys = {k: r[0] for k, r in shapes}
    off = [(a, b) for a in polys for b in polys if a != b]
    meet = sorted((a, b) for a, b in off if crossing(polys[a], polys[b]) or inside(polys[a][0], polys[b]) or inside(polys[b][0], polys[a]))
    hold = sorted((a, b) for a, b in off if not crossing(polys[a], polys[b]) and inside(polys[b][0], polys[a]))
    assert hold and len(meet) > len(hold)
    assert rows(join_polygons(df, df, "id", "id", "intersects", size=5.0).where("a <> b")) == meet
    contained = rows(join_polygons(df, df, "id", "id", "contains", size=5.0))
    assert contained == sorted([*hold, *[(k, k) for k in polys]])  # each contains itself


def test_edges_are_dealt_along_themselves(spark):
    df = table(spark, [("d", [[(-50.0, -50.0), (50.0, 50.0), (50.0, 50.5)]])])
    edges = polygon_edges(polygon_rings(df, "id", "rings"))
    cells = edge_cells(edges.where("edge = 0"), 1.0)
    assert 100 <= cells.count() < 420  # a box of it has 10,000
    plan = plan_of(join_polygons(df, df, "id", "id", "contains"))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan


def test_inner_point_of_a_concave_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 1.0), (0.0, 10.0)]
    p = table(spark, [("c", [ring])]).select(inner_point(F.col("rings")[0]).alias("p")).first().p
    assert p.py == 0.5 and 0 < p.px < 10

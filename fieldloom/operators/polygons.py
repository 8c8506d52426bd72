"""Relations between polygons with holes, as equi joins on grid cells.

A polygon is an array of rings, the outer one first, then its holes; a ring is an array of ``lon, lat`` structs, closed
or not. Everything is planar in degrees and in double precision, without a tolerance; a polygon over the antimeridian
must be cut there first. Null polygons, and rings with fewer than three points, take no part. Keys must be unique.

Edges, not polygons, are dealt to cells, row by row along each edge, so a polygon with a million edges is a million
small rows. Parity of a point is counted from the edges of its polygon in the point's own strip of latitude, so that a
large polygon's edges are spread over strips too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geo import _segments, ring_bbox
from fieldloom.functions.scalar import let
from fieldloom.operators.spatial import BOX, _box_cells, _cell

RELATIONS = ("intersects", "contains", "within")
#: degrees by which an edge's span in a row of cells is widened, against rounding
PAD = 1e-9


def polygon_rings(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """(id, ring, points): the rings that have three points at least; ring 0 is the outer one."""
    each = polygons.select(F.col(key).alias("id"), F.posexplode(rings).alias("ring", "points"))
    return each.where((F.size("points") >= 3) & F.col("id").isNotNull())


def polygon_edges(rings: DataFrame) -> DataFrame:
    """(id, ring, edge, x1, y1, x2, y2) of every edge that has a length."""
    each = rings.select("id", "ring", F.posexplode(_segments(F.col("points"))).alias("edge", "s"))
    ends = [F.col(f"s.{p}.{c}").cast("double").alias(f"{n}{i}") for i, p in ((1, "a"), (2, "b")) for n, c in (("x", "lon"), ("y", "lat"))]
    return each.select("id", "ring", "edge", *ends).where("x1 <> x2 OR y1 <> y2")


def edge_cells(edges: DataFrame, size: float) -> DataFrame:
    """``edges`` once for each cell (cx, cy) that the edge passes: per row of cells, the span that it has there."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(low, -90.0, size), _cell(high, -90.0, size))))

    def at(lat: Column) -> Column:
        clipped = F.least(F.greatest(lat, low), high)
        return F.col("x1") + (clipped - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1"))

    a, b = at(F.col("cy") * size - 90.0 - PAD), at((F.col("cy") + 1) * size - 90.0 + PAD)
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    # a level edge has its whole span; rounding may leave the edge by less than PAD
    start = F.greatest(F.coalesce(F.least(a, b), west) - PAD, west)
    end = F.least(F.coalesce(F.greatest(a, b), east) + PAD, east)
    return rows.withColumn("cx", F.explode(F.sequence(_cell(start, -180.0, size), _cell(F.greatest(start, end), -180.0, size))))


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
    """On which side of the line a-b the point lies: 1, 0 or -1."""
    return F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))


def touching_edges(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of edges that share a point, each once: a_ and b_ columns of both, and the four sides d1 to d4.

    d1 and d2 tell the sides of the b edge's ends to the a edge's line, d3 and d4 those of the a edge's ends.
    """
    names = ("id", "ring", "edge", "x1", "y1", "x2", "y2")
    left = edge_cells(a, size).select(*[F.col(c).alias(f"a_{c}") for c in names], F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"))
    right = edge_cells(b, size).select(*[F.col(c).alias(f"b_{c}") for c in names], F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"))
    meet = (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))
    for c in "xy":
        meet &= F.least(f"a_{c}1", f"a_{c}2") <= F.greatest(f"b_{c}1", f"b_{c}2")
        meet &= F.least(f"b_{c}1", f"b_{c}2") <= F.greatest(f"a_{c}1", f"a_{c}2")
    d = [
        _side("a_x1", "a_y1", "a_x2", "a_y2", "b_x1", "b_y1"), _side("a_x1", "a_y1", "a_x2", "a_y2", "b_x2", "b_y2"),
        _side("b_x1", "b_y1", "b_x2", "b_y2", "a_x1", "a_y1"), _side("b_x1", "b_y1", "b_x2", "b_y2", "a_x2", "a_y2"),
    ]
    found = left.join(right, meet & (d[0] * d[1] <= 0) & (d[2] * d[3] <= 0))
    kept = [*[f"a_{c}" for c in names], *[f"b_{c}" for c in names]]
    # two edges may meet in several cells
    return found.select(*kept, *[x.alias(f"d{i + 1}") for i, x in enumerate(d)]).dropDuplicates(["a_id", "a_ring", "a_edge", "b_id", "b_ring", "b_edge"])


def _boxed(rings: DataFrame, size: float) -> DataFrame:
    """(poly, box columns, cx, cy): the cells of each polygon's box."""
    box = ring_bbox(F.col("points"))
    outer = rings.where("ring = 0").select(F.col("id").alias("poly"), *[c.cast("double").alias(n) for c, n in zip(box, BOX, strict=True)])
    return outer.withColumn("_c", F.explode(_box_cells(*[F.col(b) for b in BOX], size))).select("poly", *BOX, F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"))


def box_candidates(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """``points`` (px, py and others) with each polygon (poly) whose box holds them."""
    placed = points.withColumn("_px", _cell(F.col("px"), -180.0, size)).withColumn("_py", _cell(F.col("py"), -90.0, size))
    inside = F.col("px").between(F.col("min_lon"), F.col("max_lon")) & F.col("py").between(F.col("min_lat"), F.col("max_lat"))
    return placed.join(_boxed(rings, size), (F.col("_px") == F.col("cx")) & (F.col("_py") == F.col("cy")) & inside).drop(*BOX, "cx", "cy", "_px", "_py")


def inside_points(points: DataFrame, edges: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Distinct ``keys`` and poly of those rows of ``points`` (px, py, poly) that lie in their polygon, its holes excluded.

    A ray to the east crosses all rings an odd number of times. ``keys`` name a point.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    strips = edges.select(F.col("id").alias("_poly"), "x1", "y1", "x2", "y2", F.explode(F.sequence(_cell(low, -90.0, size), _cell(high, -90.0, size))).alias("_strip"))
    lat, lon = F.col("py"), F.col("px")
    crossed = ((F.col("y1") > lat) != (F.col("y2") > lat)) & (lon < (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    met = points.join(strips, (F.col("poly") == F.col("_poly")) & (_cell(lat, -90.0, size) == F.col("_strip")) & crossed)
    return met.groupBy(*keys, "poly").agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def inner_point(ring: Column) -> Column:
    """A struct (px, py) inside a ring: halfway between the first two crossings of a line between its two lowest latitudes."""

    def middle(lats: Column) -> Column:
        return (lats[0] + lats[1]) / 2

    def crossings(y: Column) -> Column:
        hits = F.filter(_segments(ring), lambda s: (s["a"]["lat"] > y) != (s["b"]["lat"] > y))
        xs = F.transform(hits, lambda s: s["a"]["lon"] + (y - s["a"]["lat"]) / (s["b"]["lat"] - s["a"]["lat"]) * (s["b"]["lon"] - s["a"]["lon"]))
        return let(F.array_sort(xs), lambda x: F.struct(((F.get(x, F.lit(0)) + F.get(x, F.lit(1))) / 2).alias("px"), y.alias("py")))

    lats = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["lat"].cast("double"))))
    return F.when(F.size(lats) > 1, let(let(lats, middle), crossings))


def _first_points(rings: DataFrame, key: str) -> DataFrame:
    """A vertex of every ring: (key, ring, px, py)."""
    return rings.select(F.col("id").alias(key), "ring", F.col("points")[0]["lon"].cast("double").alias("px"), F.col("points")[0]["lat"].cast("double").alias("py"))


def _intersecting(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b) that share a point: their edges do, or one holds a vertex of the other's outer ring."""
    edges_a, edges_b = polygon_edges(a), polygon_edges(b)
    touch = touching_edges(edges_a, edges_b, size).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    b_in_a = inside_points(box_candidates(_first_points(b.where("ring = 0"), "b"), a, size), edges_a, ["b"], size)
    a_in_b = inside_points(box_candidates(_first_points(a.where("ring = 0"), "a"), b, size), edges_b, ["a"], size)
    return touch.unionByName(b_in_a.select(F.col("poly").alias("a"), "b")).unionByName(a_in_b.select("a", F.col("poly").alias("b"))).distinct()


def _covering(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b) where no point of b lies outside of a; their boundaries may touch.

    Candidates are pairs whose first outer vertex lies in the box. Edges that cross end a pair. Where edges only touch,
    the b edge is cut at the touches; every piece that does not run along an a edge must have its middle inside a. A ring
    of b that touches nothing is tested by one vertex. At last, no hole of a may be filled by b.
    """
    edges_a, edges_b = polygon_edges(a), polygon_edges(b)
    candidates = box_candidates(_first_points(b.where("ring = 0"), "b"), a, size).select(F.col("poly").alias("a"), "b")
    touch = touching_edges(edges_a, edges_b, size)
    crossed = touch.where("d1 * d2 < 0 AND d3 * d4 < 0").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))

    # where the a edge's ends lie on the b edge, as shares of it; an edge along it covers what lies between
    dx, dy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    share = [F.least(F.greatest(((F.col(f"a_x{i}") - F.col("b_x1")) * dx + (F.col(f"a_y{i}") - F.col("b_y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)) for i in (1, 2)]
    along = (F.col("d1") == 0) & (F.col("d2") == 0)
    cuts = F.filter(F.array(F.when(F.col("d3") == 0, share[0]), F.when(F.col("d4") == 0, share[1])), lambda t: t.isNotNull())
    span = F.when(along, F.struct(F.least(*share).alias("low"), F.greatest(*share).alias("high")))
    told = touch.select("a_id", "b_id", "b_ring", "b_edge", "b_x1", "b_y1", "b_x2", "b_y2", cuts.alias("cuts"), span.alias("span"))
    by_edge = told.groupBy("a_id", "b_id", "b_ring", "b_edge", "b_x1", "b_y1", "b_x2", "b_y2").agg(
        F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.flatten(F.collect_list("cuts"))))).alias("cuts"), F.collect_set("span").alias("spans")
    )
    parts = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda s, e: (s + e) / 2)
    free = by_edge.withColumn("t", F.explode(parts)).where(~F.exists("spans", lambda s: (s["low"] <= F.col("t")) & (F.col("t") <= s["high"])))
    middles = free.select(
        F.col("a_id").alias("poly"), F.col("b_id").alias("b"), "b_ring", "b_edge", "t",
        (F.col("b_x1") + F.col("t") * (F.col("b_x2") - F.col("b_x1"))).alias("px"), (F.col("b_y1") + F.col("t") * (F.col("b_y2") - F.col("b_y1"))).alias("py"),
    )
    alone = candidates.join(_first_points(b, "b"), "b").join(told.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("b_ring").alias("ring")).distinct(), ["a", "b", "ring"], "left_anti")
    tested = middles.unionByName(alone.select(F.col("a").alias("poly"), "b", F.col("ring").alias("b_ring"), F.lit(-1).alias("b_edge"), F.lit(0.0).alias("t"), "px", "py"))
    tested = tested.join(candidates.select(F.col("a").alias("poly"), "b"), ["poly", "b"], "left_semi")
    keys = ["b", "b_ring", "b_edge", "t"]
    outside = tested.join(inside_points(tested, edges_a, keys, size), [*keys, "poly"], "left_anti").select(F.col("poly").alias("a"), "b")

    holes = a.where("ring > 0").select(F.col("id").alias("a"), "ring", inner_point(F.col("points")).alias("p")).select("a", "ring", "p.px", "p.py").where("px IS NOT NULL")
    asked = holes.join(candidates.withColumnRenamed("b", "poly"), "a")
    filled = inside_points(asked, edges_b, ["a", "ring"], size).select("a", F.col("poly").alias("b"))
    return candidates.join(crossed.unionByName(outside).unionByName(filled).distinct(), ["a", "b"], "left_anti")


def join_polygons(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, relation: str = "intersects", how: str = "inner",
    rings: str = "rings", size: float = 10.0,
) -> DataFrame:
    """(a, b): keys of left and right polygons that hold the relation; with ``how`` left, also left keys without any (b null).

    ``intersects``: they share a point, if only one of their boundaries. ``contains``: no point of the right one lies
    outside of the left one. ``within``: the same with the sides changed. ``size`` is the cell edge in degrees: a few
    usual edge lengths is best.
    """
    if relation not in RELATIONS or how not in ("inner", "left"):
        raise ValueError(f"unknown relation or join: {relation}, {how}")
    a, b = polygon_rings(left, left_key, rings), polygon_rings(right, right_key, rings)
    if relation == "intersects":
        pairs = _intersecting(a, b, size)
    elif relation == "contains":
        pairs = _covering(a, b, size)
    else:
        pairs = _covering(b, a, size).select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = pairs.select("a", "b")
    return pairs if how == "inner" else left.select(F.col(left_key).alias("a")).join(pairs, "a", "left")

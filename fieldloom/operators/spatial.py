"""Spatial joins as equi joins on grid cells, refined by the exact predicate.

Every join puts the exact test into the join condition, so candidates are never
written out, and uses equality on a cell, so there is no nested-loop plan. AQE
broadcasts the smaller side while it is small and splits skewed cells otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geo import EARTH_M, haversine_m, point_in_ring, ring_bbox
from fieldloom.session import checkpointed

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def _cell(value: Column, origin: float, size: float) -> Column:
    return F.floor((value - origin) / size).cast("int")


def _box_cells(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, size: float) -> Column:
    """Cells of a regular degree grid that a box touches."""
    xs = F.sequence(_cell(min_lon, -180.0, size), _cell(max_lon, -180.0, size))
    ys = F.sequence(_cell(min_lat, -90.0, size), _cell(max_lat, -90.0, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def join_point_bbox(
    points: DataFrame, boxes: DataFrame, how: str = "inner", size: float = 10.0, lon: str = "lon", lat: str = "lat",
    extra: Column | None = None,
) -> DataFrame:
    """Points with the boxes that hold them, edges included; ``how`` inner or left.

    ``size`` is the cell edge in degrees: about the usual box edge is best.
    """
    cells = boxes.withColumn("_c", F.explode(_box_cells(*[F.col(b) for b in BOX], size)))
    placed = points.withColumn("_px", _cell(F.col(lon), -180.0, size)).withColumn("_py", _cell(F.col(lat), -90.0, size))
    cond = (
        (F.col("_px") == F.col("_c.x")) & (F.col("_py") == F.col("_c.y"))
        & F.col(lon).between(F.col("min_lon"), F.col("max_lon")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
    )
    if extra is not None:
        cond = cond & extra
    return placed.join(cells, cond, how).drop("_px", "_py", "_c")


def join_point_polygon(
    points: DataFrame, polygons: DataFrame, ring: str = "ring", how: str = "inner", size: float = 10.0,
    lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """Points with the polygons that hold them (for points, intersects = within = contains)."""
    west, south, east, north = ring_bbox(F.col(ring))
    boxed = polygons.select("*", west.alias("min_lon"), south.alias("min_lat"), east.alias("max_lon"), north.alias("max_lat"))
    inside = point_in_ring(F.col(lon), F.col(lat), F.col(ring))
    return join_point_bbox(points, boxed, how, size, lon, lat, inside).drop(*BOX)


#: rows of one side of a unit of work, about; a unit tests each row of one side against each of the other
UNIT_ROWS = 4096
#: pairs that one task tests, about
TASK_PAIRS = 20_000_000
#: keys of one place that stand in one row at most, about
PLACE_KEYS = 1024


def _by_cell(left: DataFrame, right: DataFrame, cell: Sequence[str], cond: Column, weight: tuple[Column, Column] | None = None) -> DataFrame:
    """Inner join on the columns ``cell``, which both sides have, and ``cond``; the cell columns are dropped.

    A cell with many rows is dealt into units, each a share of the left rows against a share of the right ones, and the
    units over as many tasks as the pairs of all cells ask for, however small the tables are. ``weight`` says how many
    rows a row of each side stands for.
    """
    own, told = weight or (F.lit(1), F.lit(1))
    here = left.groupBy(*cell).agg(F.sum(own).alias("_nl")).join(right.groupBy(*cell).agg(F.sum(told).alias("_nr")), list(cell))
    sizes = checkpointed(here)
    pairs = sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0.0
    tasks = max(1, min(10_000, math.ceil(pairs / TASK_PAIRS)))
    units = sizes.select(*cell, F.ceil(F.col("_nl") / UNIT_ROWS).alias("_pl"), F.ceil(F.col("_nr") / UNIT_ROWS).alias("_pr"))

    def dealt(rows: DataFrame, shares: str, others: str, share: str, other: str) -> DataFrame:
        values = [c for c in rows.columns if c not in cell]
        placed = rows.join(units, list(cell)).withColumn(share, F.pmod(F.xxhash64(*values), F.col(shares)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop("_pl", "_pr")

    keys = [*cell, "_i", "_j"]
    one = dealt(left, "_pl", "_pr", "_i", "_j").repartition(tasks, *keys)
    two = dealt(right, "_pr", "_pl", "_j", "_i").repartition(tasks, *keys).select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in [*right.columns, "_i", "_j"]])
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_r{k}") for k in keys])
    return one.hint("merge").join(two, same & cond).drop(*keys, *[f"_r{k}" for k in keys])


def join_bbox_overlap(boxes: DataFrame, key: str, size: float = 10.0) -> DataFrame:
    """Pairs (a, b), both directions, of different boxes that overlap, edges included.

    Two boxes can meet in many cells; the pair is kept only in the cell of the
    corner where the overlap begins, so no distinct is needed.
    """
    base = boxes.select(key, *BOX)
    cells = base.withColumn("_c", F.explode(_box_cells(*[F.col(b) for b in BOX], size)))
    cell = [F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y")]
    a = cells.select(F.col(key).alias("a"), *[F.col(b).alias(f"a_{b}") for b in BOX], *cell)
    b = cells.select(F.col(key).alias("b"), *[F.col(b).alias(f"b_{b}") for b in BOX], *cell)
    west, south = F.greatest("a_min_lon", "b_min_lon"), F.greatest("a_min_lat", "b_min_lat")
    cond = (
        (F.col("a") != F.col("b"))
        & (west <= F.least("a_max_lon", "b_max_lon")) & (south <= F.least("a_max_lat", "b_max_lat"))
        & (F.col("_x") == _cell(west, -180.0, size)) & (F.col("_y") == _cell(south, -90.0, size))
    )
    return _by_cell(a, b, ["_x", "_y"], cond).select("a", "b")


def _places(rows: DataFrame, key: str, side: str, lon: str, lat: str) -> DataFrame:
    """(lon, lat, keys) of ``side``: the keys of each place as lists, more than one where the place has many rows."""
    x, y = f"{side}_lon", f"{side}_lat"
    own = rows.select(F.struct(F.col(key).alias("key")).alias("_k"), F.col(lon).alias(x), F.col(lat).alias(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    lists = own.groupBy(x, y).agg(F.ceil(F.count(F.lit(1)) / PLACE_KEYS).alias("_lists"))
    return own.join(lists, [x, y]).groupBy(x, y, F.pmod(F.xxhash64("_k"), F.col("_lists")).alias("_list")).agg(F.collect_list("_k").alias(f"{side}_keys")).drop("_list")


def join_distance(
    left: DataFrame, right: DataFrame, metres: float, left_key: str, right_key: str, self_join: bool = False,
    lon: str = "lon", lat: str = "lat", digits: int | None = None,
) -> DataFrame:
    """(a, b, distance_m) for points closer than ``metres``; a self join gives each pair once, a < b.

    The sphere is cut into latitude bands at least one radius high, each band
    into its own number of cells. A left point is sent to the cells its circle
    can touch (across the antimeridian and the poles too); a right point has
    one cell. Points at one place are one row until the end, so a place with
    many points costs few candidates, not one per point. Distances are rounded
    to ``digits`` where given, once for each two places.
    """
    delta = metres / EARTH_M
    size = max(math.degrees(delta) * 1.000001, 180.0 / 20_000)

    def band_cells(band: Column) -> Column:
        middle = F.radians((band + 0.5) * size - 90.0)
        return F.greatest(F.floor(360.0 * F.cos(middle) / size), F.lit(1)).cast("long")

    places_l = checkpointed(_places(left, left_key, "a", lon, lat))
    places_r = checkpointed(_places(right, right_key, "b", lon, lat))
    phi = F.radians("a_lat")
    reach = F.when(F.abs(phi) + delta >= math.pi / 2, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.sin(F.lit(delta)) / F.cos(phi), F.lit(1.0)))) * 1.000001
    )
    band = F.floor((F.col("a_lat") + 90.0) / size)
    probe = places_l.withColumn("_reach", reach).withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
    n = band_cells(F.col("_band"))
    low = F.floor((F.col("a_lon") - F.col("_reach") + 180.0) / 360.0 * n)
    high = F.floor((F.col("a_lon") + F.col("_reach") + 180.0) / 360.0 * n)
    probe = probe.withColumn("_n", n).withColumn(
        "_cell", F.explode(F.sequence(low, F.least(high, low + F.col("_n") - 1)))
    ).withColumn("_cell", F.pmod(F.col("_cell"), F.col("_n")))
    band_r = F.floor((F.col("b_lat") + 90.0) / size)
    build = places_r.withColumn("_band_r", band_r)
    n_r = band_cells(F.col("_band_r"))
    build = build.withColumn("_cell_r", F.pmod(F.floor((F.col("b_lon") + 180.0) / 360.0 * n_r), n_r))
    d = haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    probe = probe.select("a_lon", "a_lat", "a_keys", "_band", "_cell")
    build = build.select("b_lon", "b_lat", "b_keys", F.col("_band_r").alias("_band"), F.col("_cell_r").alias("_cell"))
    near = _by_cell(probe, build, ["_band", "_cell"], d < metres, (F.size("a_keys"), F.size("b_keys")))
    distance = d if digits is None else F.round(d, digits)
    out = near.select("a_keys", "b_keys", distance.alias("distance_m"))
    out = out.select(F.explode("a_keys").alias("_a"), "b_keys", "distance_m").select("_a", F.explode("b_keys").alias("_b"), "distance_m")
    out = out.select(F.col("_a.key").alias("a"), F.col("_b.key").alias("b"), "distance_m")
    return out.where(F.col("a") < F.col("b")) if self_join else out


def count_near(
    left: DataFrame, right: DataFrame, metres: float, key: str, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """(key, near): how many right points lie within ``metres`` of each left row; no pair of rows is formed."""
    weights = right.groupBy(lon, lat).agg(F.count(F.lit(1)).alias("_w"))
    numbered = weights.withColumn("_p", F.struct(lon, lat, "_w"))
    places = left.select(lon, lat).distinct().withColumn("_q", F.struct(lon, lat))
    pairs = join_distance(places, numbered, metres, "_q", "_p", lon=lon, lat=lat)
    sums = pairs.groupBy(F.col(f"a.{lon}").alias(lon), F.col(f"a.{lat}").alias(lat)).agg(F.sum("b._w").alias("near"))
    return left.join(sums, [lon, lat], "left").select(key, F.coalesce("near", F.lit(0)).alias("near"))


def covering(boxes: DataFrame, key: str, zoom: int) -> DataFrame:
    """(key, tile) for the map tiles each box touches."""
    from fieldloom.functions.geo import covering_tiles, tile_id

    tiles = boxes.select(key, F.explode(covering_tiles(*[F.col(b) for b in BOX], zoom)).alias("t"))
    return tiles.select(key, tile_id(zoom, F.col("t.x"), F.col("t.y")).alias("tile"))


def ring_of(points: Sequence[tuple[Column, Column]]) -> Column:
    """Array of ``lon, lat`` structs."""
    return F.array(*[F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for x, y in points])

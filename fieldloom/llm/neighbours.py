"""Approximate nearest neighbours by low-dimensional stable projections with a chi-square stopping test.

Vectors are projected onto ``AXES`` random Gaussian directions. For a pair at distance d, the squared projected
distance over d * d follows a chi-square distribution with ``AXES`` degrees of freedom. A query takes the projected
points nearest first and verifies them on the original vectors; when the next projected distance is so large that a
point nearer than the k-th best so far would have come earlier with probability ``SURE``, it stops.

The projected points lie in a kd-tree. Its upper part, at most ``CELLS`` cells fitted on a bounded sample, deals all
rows out; each cell's box is that of all its rows. A cell's rows are cut into blocks of bounded size, and a task
builds the lower part of the tree over a block. Every query first searches its own cell. The k-th best distance found
there tells which other cells it cannot leave out, and those are searched with it as the first limit.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import stored
from fieldloom.llm.vectors import matrix, usable

AXES, SURE, SEED = 8, 0.98, 8191
CELLS, CELL_ROWS, SAMPLE_ROWS = 1024, 8192, 20_000
BLOCK, QUERIES, LEAF = 4096, 512, 64


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def quantile(p: float, freedom: int) -> float:
    """Where the distribution function reaches ``p``."""
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < p else (low, mid)
    return high


def directions(size: int, axes: int, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, size, axes])).standard_normal((size, axes))


def split(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows of ``points`` by leaf of a kd-tree: halves at the median of the widest axis until a leaf has ``rows`` at most."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            leaves.append(at)
            continue
        own = points[at]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = np.argpartition(own[:, axis], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return leaves


def upper_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the splits of a complete kd-tree, node i above 2 i + 1 and 2 i + 2."""
    axis, value = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
    held = {0: sample}
    for i in range(len(axis)):
        own = held.pop(i)
        if len(own):
            axis[i] = int((own.max(axis=0) - own.min(axis=0)).argmax())
            value[i] = np.median(own[:, axis[i]])
        low = own[:, axis[i]] < value[i] if len(own) else np.zeros(0, bool)
        held |= {2 * i + 1: own[low], 2 * i + 2: own[~low]}
    return axis, value


def cell_of(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), int)
    while len(node) and len(axis) and node[0] < len(axis):  # all rows are equally deep
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(axis)


def box_gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(axis=2)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, limits: np.ndarray, k: int, axes: int, factor: float):
    """For each query the rows of ``x`` among its ``k`` nearest found, as (query rows, rows, squared distances)."""
    project = directions(x.shape[1], axes)
    p, pq = x @ project, q @ project
    leaves = split(p, LEAF)
    low, high = np.stack([p[a].min(axis=0) for a in leaves]), np.stack([p[a].max(axis=0) for a in leaves])
    found = []
    for row in range(len(q)):
        gap = box_gap(pq[row : row + 1], low, high)[0]
        best, rows, limit = np.zeros(0), np.zeros(0, int), limits[row]
        for leaf in np.argsort(gap, kind="stable"):
            if gap[leaf] > factor * limit:  # the stopping test: no later point is nearer in projection
                break
            at = leaves[leaf]
            delta = p[at] - pq[row]
            at = at[((delta * delta).sum(axis=1) <= factor * limit) & (ids[at] != q_ids[row])]
            delta = x[at] - q[row]
            exact = (delta * delta).sum(axis=1)
            near = exact <= limit
            best, rows = np.concatenate([best, exact[near]]), np.concatenate([rows, at[near]])
            if len(best) > k:
                order = np.lexsort((ids[rows], best))[:k]
                best, rows = best[order], rows[order]
            if len(best) == k:
                limit = min(limit, float(best.max()))
        found.append((np.full(len(rows), row), rows, best))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def nearest(embeddings: DataFrame, queries: Column, k: int = 10, axes: int = AXES, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row of ``embeddings`` that ``queries`` picks.

    ``embeddings`` needs vec_id and embedding. Score is the Euclidean distance of the vectors in double precision; ties
    go to the smaller vec_id. A query's candidates are all rows with another vec_id; a query id that stands there more
    than once is searched with its smallest vector. Vectors that are null, empty, zero, hold null or non-finite
    components, or have another length than most take no part, and neither do rows without an id. Fewer candidates
    than ``k`` are all returned; an empty table gives no row. Every row is indexed; only the upper splits are fitted on
    a sample of ``SAMPLE_ROWS`` rows. ``axes`` is even.
    """
    result = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    fine = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = fine.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    size, total = sizes.size, sizes["count"]
    fine = fine.where(F.size("vector") == size)
    depth = max(0, min(CELLS.bit_length() - 1, (max(1, -(-total // CELL_ROWS)) - 1).bit_length()))
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    axis, value = upper_tree(matrix(sample.column("vector").combine_chunks()) @ directions(size, axes), depth)
    factor = quantile(sure, axes)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column("vector")) @ directions(size, axes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points.tolist(), pa.list_(pa.float64())), pa.array(cell_of(points, axis, value).astype(np.int32))], names=[*batch.schema.names, "point", "cell"])

    placed = stored(fine.mapInArrow(place, "vec_id long, vector array<double>, asks boolean, point array<double>, cell int"), "points")
    bounds = [F.min(F.col("point")[i]).alias(f"l{i}") for i in range(axes)] + [F.max(F.col("point")[i]).alias(f"h{i}") for i in range(axes)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *bounds).orderBy("cell").collect()  # CELLS rows at most
    cells = np.array([r.cell for r in boxes])
    low, high = (np.array([[r[f"{s}{i}"] for i in range(axes)] for r in boxes]) for s in "lh")
    blocks = F.element_at(F.create_map(*[F.lit(int(v)) for r in boxes for v in (r.cell, -(-r.n // BLOCK))]), F.col("cell"))
    points = placed.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"))
    first = Window.partitionBy("vec_id").orderBy("vector")
    asking = placed.where("asks").withColumn("turn", F.row_number().over(first)).where("turn = 1").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "point", F.col("cell").alias("home"))

    def answers(routed: DataFrame) -> DataFrame:
        """The best of each block for queries (query_id, query, cell, limit); both sides meet by block and part of the queries."""
        many = routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        left = points.join(many, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "block", "part", "vec_id", "vector", F.lit(None).cast("double").alias("limit"), F.lit(False).alias("asks"))
        right = routed.join(many, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
        right = right.select("cell", "block", "part", F.col("query_id").alias("vec_id"), F.col("query").alias("vector"), "limit", F.lit(True).alias("asks"))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("square", pa.float64())])

        def find(table: pa.Table) -> pa.Table:
            asks = np.asarray(table.column("asks"))
            ids, x = np.asarray(table.column("vec_id")), matrix(table.column("vector").combine_chunks())
            if asks.all() or not asks.any():
                return schema.empty_table()
            limits = np.nan_to_num(np.asarray(table.column("limit"), np.float64)[asks], nan=np.inf)
            q, row, square = search(x[~asks], ids[~asks], x[asks], ids[asks], limits, k, axes, factor)
            return pa.table([pa.array(ids[asks][q]), pa.array(ids[~asks][row]), pa.array(square)], schema=schema)

        return left.unionByName(right).groupBy("cell", "block", "part").applyInArrow(find, "query_id long, vec_id long, square double")

    order = Window.partitionBy("query_id").orderBy("square", "vec_id")
    home = stored(answers(asking.select("query_id", "query", F.col("home").alias("cell"), F.lit(None).cast("double").alias("limit"))), "home")
    best = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("square").alias("limit"))

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                limits = np.nan_to_num(np.asarray(batch.column("limit"), np.float64), nan=np.inf)
                open_ = box_gap(matrix(batch.column("point")), low, high) <= factor * limits[:, None]
                open_ &= cells[None] != np.asarray(batch.column("home"))[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), batch.column("limit"), pa.array([cells[o].tolist() for o in open_], pa.list_(pa.int32()))], names=["query_id", "query", "limit", "cells"])

    away = asking.join(best, "query_id", "left").mapInArrow(route, "query_id long, query array<double>, limit double, cells array<int>")
    away = stored(away, "routes").select("query_id", "query", "limit", F.explode("cells").alias("cell"))
    ranked = home.unionByName(answers(away)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.sqrt("square").alias("score"))

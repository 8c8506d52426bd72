"""Near-duplicate embeddings by tiled comparison in PCA order, exact in double precision.

Only vectors with equal labels are compared. All vectors (scaled to length 1) are turned into the axes of their second
moments, largest first. Linked vectors differ by at most ``sqrt(2 - 2 cosine)`` on every axis, so cells of that width
on the leading axes need comparison only with themselves and their neighbours. Cells are cut into blocks of bounded
size, and every pair of blocks is a tile. A tile adds up the products of the leading axes first; what the other axes
can add is bounded by the product of the suffix norms; it stops when no pair can reach the cosine, and goes on with
single pairs when few can. Equal vectors are one vector with a weight, so a group of copies costs nothing.

A tile gives, for each of its vectors, the number of links and the smallest vector of its component inside the tile,
not the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored
from fieldloom.llm.components import components
from fieldloom.llm.vectors import matrix, usable

COSINE, BLOCK, CELL_AXES = 0.98, 512, 2
#: ends of the groups of axes that a tile adds up before it looks at the bounds
STEPS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, also where squares would overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes_of(vectors: DataFrame, size: int) -> np.ndarray:
    """Columns: the axes of the second moments of all vectors of this size, largest first. The driver gets size x size sums."""

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                u = scaled(matrix(batch.column("vector")))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = vectors.where(F.size("vector") == size).select("vector").mapInArrow(moments, "i int, row array<double>")
    summed = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()
    return np.linalg.eigh(np.array([r.row for r in summed]))[1][:, ::-1]


def tile(a: np.ndarray, b: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) whose cosine is ``cosine`` or more; rows are of length 1 and in PCA order."""
    d = a.shape[1]
    left = lambda x: np.sqrt(np.maximum((x * x)[:, ::-1].cumsum(axis=1)[:, ::-1], 0))  # noqa: E731  norms from an axis on
    rest_a, rest_b = left(a), left(b)
    sums, begin, pairs = np.zeros((len(a), len(b))), 0, None
    for end in [*(s for s in STEPS if s < d), d]:
        if pairs is None:
            sums += a[:, begin:end] @ b[:, begin:end].T
            reach = sums if end == d else sums + np.outer(rest_a[:, end], rest_b[:, end])
            i, j = np.nonzero(reach >= cosine - SLACK)
            if len(i) * 16 < sums.size:  # few are left: go on with them alone
                pairs, sums = (i, j), sums[i, j]
        else:
            i, j = pairs
            sums = sums + np.einsum("ij,ij->i", a[i, begin:end], b[j, begin:end])
            kept = (sums if end == d else sums + rest_a[i, end] * rest_b[j, end]) >= cosine - SLACK
            pairs, sums = (i[kept], j[kept]), sums[kept]
        if pairs is not None and not len(pairs[0]):
            break
        begin = end
    i, j = pairs if pairs is not None else np.nonzero(sums >= cosine - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, cell_axes: int = CELL_AXES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors have one length, and the cosine is ``cosine`` or
    more. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept.
    Repeated rows link with each other as rows. Null ids name a component only if all its ids are null. An empty table
    gives none.
    """
    fine = embeddings.select("vec_id", "label", "embedding").where(F.col("label").isNotNull() & usable(F.col("embedding")))
    groups = fine.groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    groups = stored(groups.withColumn("gid", F.monotonically_increasing_id()).withColumn("vector", F.col("embedding").cast("array<double>")), "vectors")
    if groups.isEmpty():
        return embeddings.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size = groups.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first().size
    axes = axes_of(groups, size)
    width = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-6) + 1e-9

    def turned(vectors: np.ndarray) -> np.ndarray:
        u = scaled(vectors)
        return u @ axes if u.shape[1] == size else u

    def cells(batches):
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            found = np.zeros((batch.num_rows, cell_axes), np.int32)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                z = turned(matrix(batch.column("vector").take(pa.array(at))))[:, :cell_axes]
                found[at, : z.shape[1]] = np.floor(z / width)
            yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("label"), pa.array(lengths, pa.int32()), pa.array(found.tolist(), pa.list_(pa.int32())), batch.column("weight"), batch.column("vector")], names=["gid", "label", "size", "cell", "weight", "vector"])

    placed = stored(groups.select("gid", "label", "weight", "vector").mapInArrow(cells, "gid long, label int, size int, cell array<int>, weight long, vector array<double>"), "cells")
    counts = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = placed.join(counts, ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("gid"), "blocks").cast("int")).drop("blocks")

    # a copy for each block of the own cell and its neighbours, under the name of the pair of blocks
    steps = [F.array(*map(F.lit, s)) for s in np.stack(np.meshgrid(*[[-1, 0, 1]] * cell_axes), -1).reshape(-1, cell_axes).tolist()]
    near = own.withColumn("step", F.explode(F.array(*steps))).withColumn("other", F.zip_with("cell", "step", lambda c, s: c + s)).drop("step")
    near = near.join(counts.withColumnRenamed("cell", "other"), ["label", "size", "other"]).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here, there = F.struct("cell", "block"), F.struct(F.col("other").alias("cell"), F.col("other_block").alias("block"))
    copies = near.select("label", "size", F.least(here, there).alias("a"), F.greatest(here, there).alias("b"), (here > there).alias("right"), (here == there).alias("same"), "gid", "weight", "vector")

    out = pa.schema([("gid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        same = table.column("same")[0].as_py()
        z = turned(matrix(table.column("vector").combine_chunks()))
        gid, weight = np.asarray(table.column("gid")), np.asarray(table.column("weight"))
        right = np.asarray(table.column("right"))
        a, b = (np.arange(len(gid)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        i, j = tile(z[a], z[b], same, cosine)
        i, j = a[i], b[j]
        # what lies at the limit is decided by the vectors as given
        x = matrix(table.column("vector").combine_chunks())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        kept = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine
        i, j = i[kept], j[kept]
        links = np.bincount(i, weight[j], len(gid)) + np.bincount(j, weight[i], len(gid))
        root = np.arange(len(gid))
        while True:  # smallest row reachable inside the tile
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        at = np.flatnonzero(links > 0)
        return pa.table([pa.array(gid[at]), pa.array(links[at].astype(np.int64)), pa.array(gid[root[at]])], schema=out)

    tiles = stored(copies.groupBy("label", "size", "a", "b").applyInArrow(compare, "gid long, links long, root long"), "tiles")
    linked = tiles.groupBy("gid").agg(F.sum("links").alias("links"))
    tied = components(tiles.select(F.col("gid").alias("u"), F.col("root").alias("v")))
    named = groups.select("gid", "label", "embedding", "weight", "least").join(linked, "gid", "left").join(tied, F.col("gid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "gid"))
    firsts = named.groupBy("comp").agg(F.min("least").alias("first"))
    named = named.join(firsts, "comp").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "first")
    rows = embeddings.select("vec_id", "label", "embedding", (F.col("label").isNotNull() & usable(F.col("embedding"))).alias("fine"))
    found = rows.where("fine").join(named, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("first").alias("component_id"))
    lone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

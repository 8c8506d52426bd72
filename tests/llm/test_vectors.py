from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.neardup import near_duplicates, tile
from fieldloom.llm.neighbours import chi_square, nearest, quantile

SCHEMA = "vec_id long, embedding array<float>, label int, gid string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], SCHEMA)


def cloud(n, d, seed, near=0.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    if near:
        x[n // 2 :] = x[: n - n // 2] + near * rng.standard_normal((n - n // 2, d))
    return x.astype(np.float32)


def brute_links(rows):
    out = {}
    for k, (i, v, lab) in enumerate(rows):
        out[k] = set()
        for j, (_, w, other) in enumerate(rows):
            fine = all(x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x) for x in (v, w))
            if j != k and lab is not None and lab == other and fine and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    out[k].add(j)
    comp = {k: {k} | v for k, v in out.items()}
    for _ in rows:
        comp = {k: set().union(*(comp[j] for j in v)) for k, v in comp.items()}
    return sorted((rows[k][0], len(out[k]), min(rows[j][0] for j in comp[k])) for k in out)


@pytest.mark.parametrize("block", [3, 512])
def test_links_as_brute_force(spark, block):
    x = cloud(60, 6, 1, near=0.05)
    rows = [(k, x[k].tolist(), k % 2) for k in range(60)]
    rows += [(100, x[0].tolist(), 0), (101, x[0].tolist(), 0), (102, x[0].tolist(), None), (103, None, 0), (104, [0.0] * 6, 0), (105, [float("nan")] * 6, 0)]
    rows += [(106, [None] * 6, 0), (107, [], 0), (108, [1.0, 2.0], 0), (109, [2.0, 4.0], 0), (110, (x[1] * 1e-30).tolist(), 1), (0, x[0].tolist(), 0)]
    got = near_duplicates(table(spark, rows), block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_of_an_empty_table(spark):
    assert near_duplicates(table(spark, [])).collect() == []


def test_tile_stops_early_without_losing_pairs():
    x = cloud(40, 64, 3, near=0.02).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = tile(x, x, True, 0.98)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if x[a] @ x[b] >= 0.98}
    assert want <= set(zip(i.tolist(), j.tolist()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    extra = spark.createDataFrame([(900, 901), (901, 900), (900, 900)], "u long, v long")
    got = {r.node: r.component for r in components(edges.unionByName(extra)).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_chi_square():
    assert chi_square(quantile(0.95, 8), 8) == pytest.approx(0.95)
    assert quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_neighbours_recall_and_order(spark, tables):
    found = nearest(tables.embeddings, F.col("vec_id") % 10 == 0).collect()
    rows = tables.embeddings.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for k in np.flatnonzero(ids % 10 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != k][:10]
        got = sorted(by[ids[k]])
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[np.searchsorted(ids, v)] - s) < 1e-12 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(ids[order].tolist()))
    assert hits / (10 * len(by)) >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (6, [1.0], 0), (7, [3.0, 4.0], 1)]
    got = [tuple(r) for r in nearest(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 7)] and got[2][3] == math.sqrt(20)
    assert nearest(table(spark, []), F.col("vec_id") == 0).collect() == []
    assert nearest(table(spark, rows[:1]), F.col("vec_id") == 0).collect() == []

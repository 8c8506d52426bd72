import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph as g
from tests.conftest import rows

NODES = "id string, label string, name string, domain string, status string"
EDGES = "src string, dst string, type string, strength double"


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame(
        [("r", "Region", "r", None, None), ("e", "Ecosystem", "e", "climate", None), ("h", "Habitat", "h", "climate", None), ("s1", "Species", "s1", None, "CR"),
         ("s2", "Species", "s2", None, "LC"), ("t", "Threat", "t", "health", None), ("lone", "Species", "lone", None, None), ("p", "Policy", "p", None, None)], NODES)
    edges = spark.createDataFrame(
        [("e", "r", "LOCATED_IN", 1.0), ("h", "e", "LOCATED_IN", 1.0), ("s1", "h", "INHABITS", 1.0), ("s2", "h", "INHABITS", 1.0), ("t", "e", "THREATENS", 1.0),
         ("p", "t", "MITIGATES", 1.0), ("p", "s1", "PROTECTS", 1.0), ("h", "t", "CAUSES", 0.5)], EDGES)
    return nodes, edges


def test_closure_is_two_hops(small):
    assert rows(g.region_closure(small[1], "r")) == [("e",), ("h",), ("r",)]


def test_shortest_path_explains(small):
    row = g.shortest_path(*small, "s1", "r", 5).first()
    assert row["path"] == ["s1", "h", "e", "r"] and row["depth"] == 3
    assert row["explanation"] == "s1 -[INHABITS]- h -[LOCATED_IN]- e -[LOCATED_IN]- r"
    assert g.shortest_path(*small, "s1", "lone", 5).count() == 0
    assert g.shortest_path(*small, "s1", "r", 2).count() == 0


def test_paths_through_a_hub_keep_a_bounded_front(spark):
    """A hub with 3,000 ways out, of which few can end in time: no level holds more than the limit for each length."""
    rows_ = [("s", f"m{i:04d}", "X") for i in range(300)] + [(f"m{i:04d}", "hub", "X") for i in range(300)]
    rows_ += [("hub", f"z{i:04d}", "X") for i in range(3000)] + [(f"z{i:04d}", "end", "X") for i in range(2500, 3000)] + [("hub", "a", "X"), ("a", "b", "X")]
    edges = spark.createDataFrame(rows_, "src string, dst string, type string")
    told = []
    end = spark.createDataFrame([("end",)], "id string")
    got = [tuple(r["path"]) for r in g.paths(edges, spark.createDataFrame([("s",)], "id string"), ["X"], 1, 6, end, 10, told).collect()]
    assert got == [("s", "m0000", "hub", f"z{i:04d}", "end") for i in range(2500, 2510)]
    assert len(told) == 1 and max(told[0]) <= 10


def test_paths_in_order_against_all_trails(spark):
    """Random graphs with cycles and several types: the first by (length, path, types), also where ways end in nothing."""
    import random

    rnd = random.Random(11)
    for size, n, limit in ((4, 9, 3), (5, 14, 7), (3, 8, 1)):
        edges = sorted({(f"n{rnd.randrange(size)}", f"n{rnd.randrange(size)}", rnd.choice("XYZ")) for _ in range(n)})
        steps = [e for e in edges if e[2] != "Z"]
        found, front = [], [((f"n{i}",), (), frozenset()) for i in range(2)]
        for depth in range(1, 6):
            front = [(p + (d,), t + (k,), u | {(s, d, k)}) for p, t, u in front for s, d, k in steps if s == p[-1] and (s, d, k) not in u]
            if depth >= 2:
                found += [(depth, p, t) for p, t, _ in front if p[-1] in ("n0", "n2")]
        df = spark.createDataFrame(edges, "src string, dst string, type string")
        ends = spark.createDataFrame([("n0",), ("n2",)], "id string")
        starts = spark.createDataFrame([("n0",), ("n1",)], "id string")
        got = [(r["length"], tuple(r["path"]), tuple(r["types"])) for r in g.paths(df, starts, ["X", "Y"], 2, 5, ends, limit).collect()]
        assert got == sorted(found)[:limit]


def test_paths_use_an_edge_once(spark):
    edges = spark.createDataFrame([("a", "b", "X", 1.0), ("b", "a", "X", 1.0), ("a", "b", "Y", 1.0), ("b", "c", "X", 1.0)], EDGES)
    start = spark.createDataFrame([("a",)], "id string")
    got = {(">".join(r["path"]), ">".join(r["types"])) for r in g.paths(edges, start, ["X", "Y"], 1, 6, limit=None).collect()}
    want = set()

    def walk(path, used):
        for i, (s, d, t) in enumerate((("a", "b", "X"), ("b", "a", "X"), ("a", "b", "Y"), ("b", "c", "X"))):
            if s == path[-1] and i not in used:
                types = [("X", "X", "Y", "X")[u] for u in used] + [t]
                want.add((">".join([*path, d]), ">".join(types)))
                if len(used) < 5:
                    walk([*path, d], [*used, i])

    walk(["a"], [])
    assert got == want
    few = g.paths(edges, start, ["X", "Y"], 1, 6, limit=2).collect()
    assert [r["length"] for r in few] == [1, 1]


def test_pagerank_with_a_salted_hub(spark):
    rng = np.random.default_rng(3)
    n = 30
    pairs = sorted({(0, int(b)) for b in range(1, 25)} | {(int(a), int(b)) for a, b in rng.integers(0, n - 4, (60, 2)) if a != b})
    nodes = spark.createDataFrame([(str(i), "N", str(i), None, None) for i in range(n)], NODES)
    edges = spark.createDataFrame([(str(a), str(b), "X", 1.0) for a, b in pairs], EDGES)
    rank, out = np.full(n, 1 / n), np.bincount([a for a, _ in pairs], minlength=n)
    for _ in range(20):
        new = np.zeros(n)
        for a, b in pairs:
            new[b] += rank[a] / out[a]
        rank = 0.15 / n + 0.85 * (new + rank[out == 0].sum() / n)
    for hub in (1_000_000, 3):
        got = dict(rows(g.pagerank(nodes, edges, 20, hub_edges=hub)))
        assert [got[str(i)] for i in range(n)] == pytest.approx(list(rank), abs=1e-12)


def test_patterns(small):
    got = rows(g.patterns(*small, monitor="Habitat", hub_degree=1, hub_ratio=1.5))
    assert ("isolated_node", "lone", "medium") in got and ("missing_expected_link", "lone", "high") in got
    assert ("hub_imbalance", "p", "low") in got and ("unmonitored_region", "r", "medium") in got


def test_mutation(small, spark):
    nodes, edges = small
    left, kept = g.delete_nodes(nodes, edges, spark.createDataFrame([("e",)], "id string"))
    assert left.count() == 7 and kept.where("src = 'e' OR dst = 'e'").count() == 0 and kept.count() == 5
    more = g.create_edges(nodes, edges, spark.createDataFrame([("s1", "h", "INHABITS", 9.0), ("s1", "x", "A", 1.0), ("lone", "h", "INHABITS", 1.0)], EDGES))
    assert more.count() == edges.count() + 1 and more.where("strength = 9").count() == 0
    same = g.create_nodes(nodes, nodes)
    assert same.count() == nodes.count()
    new = g.update_nodes(nodes, spark.createDataFrame([("e", None)], "id string, domain string"), ["domain"])
    assert new.where("id = 'e'").first()["domain"] is None


def test_templates(small):
    assert rows(g.threats(*small, "r"), "ecosystem", "threat", "threat_count") == [("e", "t", 1)]
    assert rows(g.habitat_overlap(*small, "s1", "s2"), "id") == [("h",)]
    impact = rows(g.policy_impact(*small, "p"), "role", "id")
    assert impact == [("indirect", "e"), ("mitigated", "t"), ("protected", "s1")]
    assert rows(g.cross_domain(*small, "climate", "health", "r", ["CAUSES"]), "src") == []


def test_levels_and_cycles(spark):
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert rows(g.topological_levels(dag)) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        g.topological_levels(dag.unionByName(spark.createDataFrame([("c", "a")], "src string, dst string")))


def test_matrix_has_every_variable(spark):
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, strength double")
    assert rows(g.adjacency_matrix(edges, ["a", "b"])) == [("a", 0.0, 0.5), ("b", 0.0, 0.0)]


def test_shortest_path_grows_over_nodes_between_its_ends_only(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    made = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", rnd.choice("xy"), 1.0) for _ in range(60)]
    made += [("n1", f"leaf{i}", "x", 1.0) for i in range(300)] + [("n1", "n2", None, 1.0), (None, "n3", "x", 1.0)]
    edges = spark.createDataFrame(made, "src string, dst string, type string, strength double")
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}" if i % 3 else None) for i in range(40)], "id string, name string")
    grown = []
    real = g._smallest
    monkeypatch.setattr(g, "_smallest", lambda level, both: grown.append(real(level, both)) or grown[-1])
    ways = g.breadth_first(edges, spark.createDataFrame([("n1",)], "id string"), 4)
    want = {r.id: (r.path, r.types, r.depth) for r in ways.collect()}
    grown.clear()
    for end in ("n1", "n2", "n3", "n17", "n30", "leaf7", "none"):
        got = [(r.path, r.types, r.depth) for r in g.shortest_path(nodes, edges, "n1", end, 4).collect()]
        assert got == [want[end]] if end in want else got == []
    assert g.shortest_path(nodes, edges, "none", "n1", 4).collect() == []
    assert grown and max(x.count() for x in grown) < 40  # the leaves are on no way

"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import graph as op
from fieldloom.operators import windows
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with


@query("g_find_nodes", sql_with("nodes", "SELECT id, name FROM nodes WHERE label = 'Species' AND status = 'EN' ORDER BY id LIMIT 100"))
def _(t):
    return op.find_nodes(t.nodes, "Species", 100, status="EN").select("id", "name")


@query("g_mutate", sql_with("nodes edges", """, n AS (SELECT id, label, CASE WHEN label = 'Habitat' THEN 'resources' ELSE domain END AS domain FROM nodes
      WHERE NOT (label = 'Species' AND status = 'EX') UNION ALL SELECT DISTINCT 'E' || event_type, 'Observation', 'climate' FROM events),
    e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
    e2 AS (SELECT type, count(*) AS c FROM e GROUP BY 1 UNION ALL SELECT 'MONITORS', count(*) FROM (SELECT DISTINCT 'E' || event_type, 'C' || user_id FROM events WHERE 'C' || user_id IN (SELECT id FROM n)))
    SELECT 'node' AS kind, label || '/' || coalesce(domain, '') AS item, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, c FROM e2"""))
def _(t):
    none = F.lit(None).cast("string")
    new = t.events.select(F.concat(F.lit("E"), "event_type").alias("id")).distinct().select(
        "id", F.lit("Observation").alias("label"), F.col("id").alias("name"), F.lit("climate").alias("domain"), none.alias("status")
    )
    nodes = op.create_nodes(t.nodes, new)
    nodes = op.update_nodes(nodes, t.nodes.where("label = 'Habitat'").select("id", F.lit("resources").alias("domain")), ["domain"])
    nodes, edges = op.delete_nodes(nodes, t.edges, t.nodes.where("label = 'Species' AND status = 'EX'"))
    links = t.events.select(
        F.concat(F.lit("E"), "event_type").alias("src"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("dst"),
        F.lit("MONITORS").alias("type"), F.lit(1.0).alias("strength"),
    )
    edges = op.create_edges(nodes, edges, links)
    return nodes.groupBy(F.concat("label", F.lit("/"), F.coalesce("domain", F.lit(""))).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("node").alias("kind"), "item", "n"
    ).unionByName(edges.groupBy(F.col("type").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "item", "n"))


@query("g_relationships", sql_with("nodes edges", "SELECT src, type, dst, name FROM edges JOIN nodes ON dst = id WHERE src = 'LECONOMY' AND type = 'PROTECTS' AND label = 'Species'"))
def _(t):
    return op.relationships(t.nodes, t.edges, "LECONOMY", "PROTECTS", "Species").select("src", "type", "dst", "name")


@query("g_neighbours", sql_with("nodes edges", """SELECT n.id, type, name FROM (SELECT dst AS id, type FROM edges WHERE src = 'N7' UNION ALL SELECT src, type FROM edges WHERE dst = 'N7') e
    JOIN nodes n ON e.id = n.id ORDER BY n.id, type LIMIT 50"""))
def _(t):
    return op.neighbours(t.nodes, t.edges, "N7", "both").select("id", "type", "name")


CLOSURE = """inside AS (SELECT '{r}' AS id UNION SELECT src FROM edges WHERE type = 'LOCATED_IN' AND dst = '{r}'
    UNION SELECT src FROM edges WHERE type = 'LOCATED_IN' AND dst IN (SELECT src FROM edges WHERE type = 'LOCATED_IN' AND dst = '{r}'))"""

PATHS_SQL = ", " + CLOSURE.format(r="R1") + """, steps AS (SELECT src, dst, type FROM edges WHERE type IN ('DRAINS_TO', 'INFLUENCES')),
    s AS (SELECT 'C' || max(c_custkey) AS id FROM customer),
    w AS (SELECT [id] AS path, CAST([] AS VARCHAR[]) AS types, id AS e, 0 AS length FROM s
      UNION ALL SELECT list_append(path, dst), list_append(types, type), dst, length + 1 FROM w JOIN steps ON e = src WHERE length < 6)
    SELECT array_to_string(path, '>') AS path, array_to_string(types, '>') AS types, CAST(length AS BIGINT) AS length FROM
      (SELECT * FROM w WHERE length > 0 AND e IN (SELECT id FROM inside) ORDER BY length, path, types LIMIT 20)"""


@query("g_paths_k", sql_with("edges", PATHS_SQL, recursive=True))
def _(t):
    start = t.customer.agg(F.concat(F.lit("C"), F.max("c_custkey").cast("string")).alias("id"))
    out = op.paths(t.stored_edges, start, ["DRAINS_TO", "INFLUENCES"], 1, 6, op.region_closure(t.stored_edges, "R1"), 20)
    return out.select(F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"), F.col("length").cast("long").alias("length"))


@query("g_paths_hub", """SELECT 'C' || c_custkey || '>N' || c_nationkey || '>S' || s_suppkey || '>R' || n_regionkey AS path, CAST(3 AS BIGINT) AS length
    FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 3 AND s_suppkey % 3 <> 0
    ORDER BY ['C' || c_custkey, 'N' || c_nationkey, 'S' || s_suppkey] LIMIT 50""")
def _(t):
    """The first paths from all customers through nations, which are hubs on both sides, and suppliers to some regions."""
    def edges(rows, a, b):
        return rows.select(a.alias("src"), b.alias("dst"), F.lit("LEADS_TO").alias("type"))

    def named(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 3 <> 0")
    graph = edges(t.customer, named("C", "c_custkey"), named("N", "c_nationkey")).unionByName(
        edges(suppliers, named("N", "s_nationkey"), named("S", "s_suppkey"))).unionByName(edges(suppliers, named("S", "s_suppkey"), named("R", "n_regionkey")))
    targets = t.region.where("r_regionkey <> 3").select(named("R", "r_regionkey").alias("id"))
    out = op.paths(graph, t.customer.select(named("C", "c_custkey").alias("id")), ["LEADS_TO"], 1, 4, targets, 50)
    return out.select(F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


def _bfs_sql(depth: int) -> str:
    ctes = [", adj AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)", "l0 AS (SELECT {start} AS id, [{start}] AS path, CAST([] AS VARCHAR[]) AS types)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d))
        ctes.append(
            f"l{d} AS MATERIALIZED (SELECT dst AS id, arg_min(list_append(path, dst), (list_append(path, dst), list_append(types, type))) AS path, "
            f"arg_min(list_append(types, type), (list_append(path, dst), list_append(types, type))) AS types "
            f"FROM l{d - 1} JOIN adj ON l{d - 1}.id = src WHERE dst NOT IN ({seen}) GROUP BY 1)"
        )
    ctes.append("bfs AS (" + " UNION ALL ".join(f"SELECT *, {d} AS depth FROM l{d}" for d in range(depth + 1)) + ")")
    return ", ".join(ctes)


@query("g_shortest_path", sql_with("nodes edges", _bfs_sql(5).replace("{start}", "'LECONOMY'") + """, p AS (SELECT path, types, depth FROM bfs WHERE id = 'R3'),
    x AS (SELECT unnest(path) AS id, generate_subscripts(path, 1) AS i, types FROM p),
    names AS (SELECT string_agg(CASE WHEN i > 1 THEN ' -[' || types[i - 1] || ']- ' ELSE '' END || n.name, '' ORDER BY i) AS explanation FROM x JOIN nodes n ON n.id = x.id)
    SELECT array_to_string(path, '>') AS path, CAST(depth AS BIGINT) AS depth, explanation FROM p, names"""))
def _(t):
    out = op.shortest_path(t.nodes, t.stored_edges, "LECONOMY", "R3", 5)
    return out.select(F.array_join("path", ">").alias("path"), F.col("depth").cast("long").alias("depth"), "explanation")


@query("g_subgraph", sql_with("nodes edges", _bfs_sql(2).replace("{start}", "'C7'") + """, k AS (SELECT id, depth FROM bfs ORDER BY depth, id LIMIT 200)
    SELECT 'node' AS kind, id AS a, CAST(depth AS VARCHAR) AS b, '' AS type FROM k
    UNION ALL SELECT 'edge', src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""))
def _(t):
    nodes, edges = op.subgraph(t.nodes, t.stored_edges, "C7", 2, 200)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("depth").cast("string").alias("b"), F.lit("").alias("type")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "type")
    )


def _pagerank_sql(rounds: int) -> str:
    ctes = [", o AS MATERIALIZED (SELECT src, count(*) AS c FROM edges GROUP BY 1)", "n AS (SELECT count(*) AS n FROM nodes)",
            "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"d{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS d FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)), "
            f"c{i} AS MATERIALIZED (SELECT dst, sum(rank / c) AS s FROM edges JOIN o ON edges.src = o.src JOIN r{i - 1} ON id = edges.src GROUP BY 1), "
            f"r{i} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (d / n + coalesce(s, 0)) AS rank FROM nodes LEFT JOIN c{i} ON id = dst, n, d{i})"
        )
    return ", ".join(ctes)


@query("g_pagerank", sql_with("nodes edges", _pagerank_sql(20) + """ SELECT id, round(rank / (SELECT max(r.rank) FROM r20 r JOIN nodes USING (id) WHERE label = 'Habitat'), 6) AS score
    FROM r20 JOIN nodes USING (id) WHERE label = 'Habitat'"""))
def _(t):
    ranks = op.pagerank(t.nodes, t.stored_edges, 20)
    return op.importance(t.nodes, ranks, "Habitat", None).select("id", F.round("score", 6).alias("score"))


DEGREE = """, d AS (SELECT n.id, n.label, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM nodes n LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON n.id = src
    LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) ON n.id = dst)"""


@query("g_degree", sql_with("nodes edges", DEGREE + " SELECT id, o AS out_degree, i AS in_degree, o + i AS degree FROM d"))
def _(t):
    return op.degrees(t.nodes, t.edges).select("id", "out_degree", "in_degree", "degree")


@query("g_degree_summary", sql_with("nodes edges", DEGREE + " SELECT round(avg(o + i), 6) AS avg_degree, CAST(max(o + i) AS DOUBLE) AS max_degree, CAST(min(o + i) AS DOUBLE) AS min_degree, median(o + i) AS median_degree FROM d"))
def _(t):
    return op.degree_summary(t.nodes, t.edges).withColumn("avg_degree", F.round("avg_degree", 6))


@query("g_metrics", sql_with("nodes edges", """SELECT 'nodes' AS metric, '' AS item, CAST(count(*) AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges
    UNION ALL SELECT 'label', label, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY 2
    UNION ALL SELECT 'density', '', round(2.0 * (SELECT count(*) FROM edges) / (count(*) * (count(*) - 1.0)), 8) FROM nodes"""))
def _(t):
    return op.metrics(t.nodes, t.edges).withColumn("value", F.round("value", 8))


@query("g_link_predict", sql_with("nodes edges", """, t AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'INHABITS'), mine AS (SELECT dst FROM t WHERE src = 'P1'),
    s AS (SELECT src AS candidate, dst AS shared FROM t WHERE dst IN (SELECT dst FROM mine) AND src <> 'P1'),
    c AS (SELECT candidate, count(*) AS common FROM s WHERE candidate NOT IN (SELECT dst FROM mine) GROUP BY 1 ORDER BY common DESC, candidate LIMIT 20),
    e AS (SELECT candidate, string_agg(name, ',' ORDER BY name) AS evidence FROM (SELECT candidate, name FROM (SELECT DISTINCT s.candidate, name FROM s JOIN c ON s.candidate = c.candidate JOIN nodes ON shared = id)
      QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY name) <= 5) GROUP BY 1)
    SELECT c.candidate, common, round(common / (SELECT max(common) FROM c), 4) AS score, evidence FROM c JOIN e ON c.candidate = e.candidate"""))
def _(t):
    out = op.link_prediction(t.nodes, t.edges, "P1", "INHABITS", 20)
    return out.select("candidate", "common", "score", F.array_join("evidence", ",").alias("evidence"))


@query("g_patterns", sql_with("nodes edges", DEGREE + """ SELECT 'isolated_node' AS pattern, id, 'medium' AS severity FROM d WHERE o + i = 0
    UNION ALL SELECT 'hub_imbalance', id, 'low' FROM d WHERE o + i > 10 AND o / (i + 1) > 5
    UNION ALL SELECT 'missing_expected_link', id, 'high' FROM nodes WHERE label = 'Species' AND id NOT IN (SELECT src FROM edges WHERE type = 'INHABITS')
    UNION ALL SELECT 'unmonitored_region', id, 'medium' FROM nodes WHERE label = 'Region' AND id NOT IN (SELECT dst FROM edges JOIN nodes n ON src = n.id WHERE type = 'LOCATED_IN' AND n.label = 'Habitat')"""))
def _(t):
    return op.patterns(t.nodes, t.edges, monitor="Habitat")


@query("g_threats", sql_with("nodes edges", """, e AS (SELECT id, name FROM nodes WHERE label = 'Ecosystem' AND id IN (SELECT src FROM edges WHERE type = 'LOCATED_IN' AND dst = 'N4')),
    h AS (SELECT src, dst FROM edges WHERE type = 'THREATENS')
    SELECT e.id AS ecosystem, h.src AS threat, count(h.src) OVER (PARTITION BY e.id) AS threat_count FROM e LEFT JOIN h ON h.dst = e.id"""))
def _(t):
    return op.threats(t.nodes, t.edges, "N4").select("ecosystem", "threat", "threat_count")


@query("g_habitat_overlap", sql_with("nodes edges", "SELECT id, name FROM nodes WHERE id IN (SELECT dst FROM edges WHERE type = 'INHABITS' AND src = 'P1') AND id IN (SELECT dst FROM edges WHERE type = 'INHABITS' AND src = 'P2')"))
def _(t):
    return op.habitat_overlap(t.nodes, t.edges, "P1", "P2")


@query("g_hotspots", sql_with("nodes edges", """, p AS (SELECT DISTINCT a.src AS species, b.dst AS region FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'INHABITS' AND b.type = 'LOCATED_IN')
    SELECT region, count(*) AS species_count, count(*) FILTER (status IN ('CR', 'EN', 'VU')) AS endangered_count,
      round(count(*) FILTER (status IN ('CR', 'EN', 'VU')) / count(*), 6) AS vulnerability_ratio FROM p JOIN nodes ON id = species GROUP BY 1 HAVING count(*) >= 100"""))
def _(t):
    return op.hotspots(t.nodes, t.edges, 100).withColumn("vulnerability_ratio", F.round("vulnerability_ratio", 6))


@query("g_dependencies", sql_with("nodes edges", ", " + CLOSURE.format(r="R2") + """ SELECT e.src, a.name AS entity, e.type, e.dst, b.name AS resource FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id
    WHERE e.type IN ('DEPENDS_ON', 'CONSUMES', 'PRODUCES') AND e.src IN (SELECT id FROM inside)"""))
def _(t):
    return op.dependencies(t.nodes, t.edges, "R2").drop("strength")


@query("join_cross_domain", sql_with("nodes edges", ", " + CLOSURE.format(r="R2") + """ SELECT src, type, dst, strength FROM edges WHERE type IN ('DRAINS_TO', 'INFLUENCES')
    AND src IN (SELECT id FROM nodes WHERE domain = 'climate') AND dst IN (SELECT id FROM nodes WHERE domain = 'health') AND src IN (SELECT id FROM inside)
    AND dst IN (SELECT id FROM inside) ORDER BY strength DESC, src, dst, type LIMIT 50"""))
def _(t):
    return op.cross_domain(t.nodes, t.edges, "climate", "health", "R2", ["DRAINS_TO", "INFLUENCES"])


@query("g_policy_impact", sql_with("nodes edges", """, p AS (SELECT dst, type FROM edges WHERE src = 'LECONOMY'), x AS (SELECT 'mitigated' AS role, dst AS id FROM p WHERE type = 'MITIGATES'
    UNION SELECT 'protected', dst FROM p WHERE type = 'PROTECTS' UNION SELECT 'influenced', dst FROM p WHERE type = 'INFLUENCES'
    UNION SELECT 'indirect', dst FROM edges WHERE type = 'THREATENS' AND src IN (SELECT dst FROM p WHERE type = 'MITIGATES'))
    SELECT role, x.id, name FROM x JOIN nodes ON x.id = nodes.id"""))
def _(t):
    return op.policy_impact(t.nodes, t.edges, "LECONOMY")


@query("g_recommend_subgraph", sql_with("nodes edges", ", " + CLOSURE.format(r="R1") + """, ent AS (SELECT id FROM nodes WHERE (domain IS NULL OR domain = 'biodiversity') AND id IN (SELECT id FROM inside)),
    con AS (SELECT id FROM nodes WHERE domain IS NULL OR domain = 'biodiversity' OR label IN ('Region', 'Ecosystem', 'Habitat', 'Policy'))
    SELECT 'entity' AS part, id, NULL AS other, NULL AS type FROM ent
    UNION ALL SELECT DISTINCT 'relationship', src, dst, type FROM edges WHERE src IN (SELECT id FROM ent) AND dst IN (SELECT id FROM con)
    UNION ALL SELECT DISTINCT 'policy', src, NULL, NULL FROM edges WHERE type IN ('PROTECTS', 'MITIGATES') AND dst IN (SELECT id FROM ent) AND src IN (SELECT id FROM nodes WHERE label = 'Policy')"""))
def _(t):
    return op.recommendation(t.nodes, t.edges, "R1", "biodiversity")


@query("g_build_observations", sql_with("stations boxes", "SELECT DISTINCT station AS src, box AS dst, 'LOCATED_IN' AS type FROM events JOIN stations ON user_id = station JOIN boxes ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat"))
def _(t):
    placed = t.observations.select("station").distinct().join(t.stations, "station")
    return op.build_region_links(placed, t.boxes, "station", "box", size=36.0)


@query("g_build_species", sql_with("boxes points", """, o AS (SELECT o_orderkey AS k, 'species ' || o_custkey % 150 AS s, lon, lat FROM orders JOIN points ON o_custkey = id), sp AS (SELECT DISTINCT 'species ' || p_partkey % 120 AS s FROM part)
    SELECT 'O' || k AS src, 'Y' || o.s AS dst, 'MONITORS' AS type FROM o JOIN sp ON o.s = sp.s
    UNION ALL SELECT DISTINCT 'Y' || o.s, 'H' || box, 'INHABITS' FROM o JOIN sp ON o.s = sp.s JOIN boxes ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat"""))
def _(t):
    seen = t.orders.join(t.points, F.col("o_custkey") == F.col("id")).select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("obs_id"),
        F.concat(F.lit("species "), (F.col("o_custkey") % 150).cast("string")).alias("species_name"), "lon", "lat",
    )
    species = t.part.select(F.concat(F.lit("species "), (F.col("p_partkey") % 120).cast("string")).alias("scientific_name")).distinct().withColumn(
        "species_id", F.concat(F.lit("Y"), "scientific_name")
    )
    habitats = t.boxes.withColumn("habitat_id", F.concat(F.lit("H"), F.col("box").cast("string")))
    return op.build_species_links(seen, species, habitats, 36.0)


@query("g_build_air", sql_with("air", "SELECT DISTINCT 'A' || station AS src, 'X' || parameter AS dst, 'MONITORS' AS type FROM air WHERE value > 0"))
def _(t):
    return t.air.where("value > 0").select(
        F.concat(F.lit("A"), F.col("station").cast("string")).alias("src"), F.concat(F.lit("X"), "parameter").alias("dst"), F.lit("MONITORS").alias("type")
    ).distinct()


@query("g_build_adjacency", sql_with("boxes", "SELECT a.box AS src, b.box AS dst, 'ADJACENT_TO' AS type FROM boxes a JOIN boxes b ON a.box <> b.box AND a.min_lon <= b.max_lon AND b.min_lon <= a.max_lon AND a.min_lat <= b.max_lat AND b.min_lat <= a.max_lat"))
def _(t):
    return op.build_adjacency(t.boxes, "box", 36.0)


@query("g_build_causal", sql_with("nodes", """SELECT 'C' || o_custkey AS src, 'P' || o_orderkey AS dst, 'CAUSES' AS type, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, 0) AS strength, CAST(0 AS DOUBLE) AS confidence
    FROM orders WHERE 'C' || o_custkey IN (SELECT id FROM nodes) AND 'P' || o_orderkey IN (SELECT id FROM nodes)"""))
def _(t):
    evidence = t.orders.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cause"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("effect"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("strength"), F.lit(None).cast("double").alias("confidence"),
    )
    return op.build_causal(t.nodes, evidence)


MATRIX_SQL = """, s AS (SELECT lag(variable) OVER (PARTITION BY station ORDER BY ts, event_id) AS src, variable AS dst FROM obs),
    c AS (SELECT src, dst, count(*) AS n FROM s WHERE src IS NOT NULL GROUP BY 1, 2)
    SELECT src AS variable, """ + ", ".join(f"coalesce(sum(n) FILTER (dst = '{v}'), 0) / CAST(1 AS DOUBLE) AS {v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM c GROUP BY 1"


@query("g_causal_views", sql_with("obs", MATRIX_SQL))
def _(t):
    follow = windows.lags(t.observations, ["station"], [F.col("ts"), F.col("event_id")], ["variable"], 1)
    edges = follow.where("variable_lag1 IS NOT NULL").groupBy(F.col("variable_lag1").alias("src"), F.col("variable").alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("strength")
    )
    return op.adjacency_matrix(edges, ["click", "error", "purchase", "signup", "view"])


@query("g_topological", sql_with("edges", """, s AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('DRAINS_TO', 'INFLUENCES')),
    w AS (SELECT DISTINCT src AS id, 0 AS level FROM s WHERE src NOT IN (SELECT dst FROM s) UNION SELECT dst, level + 1 FROM w JOIN s ON id = src)
    SELECT id, CAST(max(level) AS BIGINT) AS level FROM w GROUP BY 1""", recursive=True))
def _(t):
    out = op.topological_levels(t.edges.where("type IN ('DRAINS_TO', 'INFLUENCES')"))
    return out.select("id", F.col("level").cast("long").alias("level"))

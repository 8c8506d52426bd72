"""Property-graph queries on two frames: nodes(id, label, name, domain, status) and edges(src, dst, type, strength).

Traversals are rounds of joins. Each round is checkpointed, so a plan never
refers to its own past twice, and a lost executor costs at most one round.
Lists that a node could have without bound are returned as rows, not collected.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldloom.operators.scale import quantiles
from fieldloom.session import checkpointed

# ---- finding ----------------------------------------------------------------


def find_nodes(nodes: DataFrame, label: str | None = None, limit: int | None = 100, **equals) -> DataFrame:
    """Nodes of a label with equal properties, by id."""
    if label is not None:
        nodes = nodes.where(F.col("label") == label)
    for name, value in equals.items():
        nodes = nodes.where(F.col(name) == value)
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def relationships(
    nodes: DataFrame, edges: DataFrame, src: str, kind: str | None = None, target_label: str | None = None
) -> DataFrame:
    """Edges out of one node with their target."""
    out = edges.where(F.col("src") == src)
    if kind is not None:
        out = out.where(F.col("type") == kind)
    target = nodes if target_label is None else nodes.where(F.col("label") == target_label)
    return out.join(target, F.col("dst") == F.col("id")).select("src", "type", "dst", "label", "name")


def neighbours(
    nodes: DataFrame, edges: DataFrame, node: str, direction: str = "both", kind: str | None = None, limit: int | None = 50
) -> DataFrame:
    """(id, type, label, name) next to a node: out, in or both; first ``limit`` by (id, type)."""
    if kind is not None:
        edges = edges.where(F.col("type") == kind)
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "type")
    back = edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "type")
    near = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    found = near.join(nodes, "id").select("id", "type", "label", "name")
    return found if limit is None else found.orderBy("id", "type").limit(limit)


def region_closure(edges: DataFrame, region: str, kinds: Sequence[str] = ("LOCATED_IN",), hops: int = 2) -> DataFrame:
    """Ids at most ``hops`` located-in steps below a region, the region included."""
    inside = edges.where(F.col("type").isin(list(kinds))).select("src", "dst")
    level = inside.where(F.col("dst") == region).select(F.col("src").alias("id"))
    out = edges.sparkSession.range(1).select(F.lit(region).alias("id")).unionByName(level)
    for _ in range(hops - 1):
        level = inside.join(level.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        out = out.unionByName(level)
    return out.distinct()


# ---- changing ---------------------------------------------------------------


def create_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones; an id that exists keeps its row."""
    return nodes.unionByName(new.join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def update_nodes(nodes: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` of the listed ids (one change per id); unknown ids are ignored."""
    renamed = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = nodes.join(renamed, "id", "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns
    ])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the ids, and every edge that touches them, are gone."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(
        gone.withColumnRenamed("id", "dst"), "dst", "left_anti"
    )
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def create_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones whose ends both exist; an existing (src, dst, type) is kept as it is."""
    ids = nodes.select("id")
    valid = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    key = ["src", "dst", "type"]
    fresh = valid.dropDuplicates(key).join(edges.select(*key), key, "left_anti")
    return edges.unionByName(fresh.select(*edges.columns))


# ---- paths ------------------------------------------------------------------


def reach_labels(steps: DataFrame, targets: DataFrame | None, high: int) -> DataFrame:
    """(id, left): the nodes from which some walk of exactly ``left`` steps, up to ``high``, ends in ``targets`` (id).

    Without targets any end counts. Rounds go backwards from the far side and hold nodes, never paths.
    """
    level = (steps.select(F.col("dst").alias("id")) if targets is None else targets.select("id")).distinct()
    if targets is None:
        level = level.unionByName(steps.select(F.col("src").alias("id"))).distinct()
    levels = [checkpointed(level)]
    for _ in range(high):
        back = steps.join(levels[-1].withColumnRenamed("id", "dst"), "dst", "left_semi")
        levels.append(checkpointed(back.select(F.col("src").alias("id")).distinct()))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, [x.select("id", F.lit(k).alias("left")) for k, x in enumerate(levels)])


def _used(depth: int) -> Column:
    """Whether the step (src, dst, type) is one of the first ``depth`` - 1 steps of path and types."""
    return F.exists(
        F.sequence(F.lit(1), F.lit(depth - 1)) if depth > 1 else F.expr("cast(array() as array<int>)"),
        lambda i: (F.element_at("path", i) == F.col("src")) & (F.element_at("path", i + 1) == F.col("dst"))
        & (F.element_at("types", i) == F.col("type")),
    )


def _grown(steps: DataFrame, front: DataFrame, labels: DataFrame, depth: int, bounded: bool) -> DataFrame:
    """Partial paths of one step more that can still end in time: (length, path, types, _end)."""
    # a bounded front goes to the edges wherever they are
    hop = steps.join(F.broadcast(front) if bounded else front, F.col("_end") == F.col("src")).where(~_used(depth))
    longer = hop.select(
        "length", F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("type")).alias("types"), F.col("dst").alias("_end")
    )
    return longer.join(labels, (F.col("_end") == F.col("id")) & (F.col("length") - depth == F.col("left")), "left_semi")


def _paths_in_order(steps: DataFrame, starts: DataFrame, labels: DataFrame, low: int, high: int, beam: int | None) -> tuple[DataFrame, dict[int, int], set[int], list[int]]:
    """Complete paths from at most ``beam`` partial ones a length and level, the first in order: (paths, number of each
    length, lengths where some were left out, rows of each level's front)."""
    lengths = F.explode(F.sequence(F.lit(low), F.lit(high)))
    front = starts.select("id").distinct().select("id", lengths.alias("length"))
    front = front.join(labels.withColumnRenamed("left", "length"), ["id", "length"], "left_semi")
    front = front.select("length", F.array("id").alias("path"), F.expr("cast(array() as array<string>)").alias("types"), F.col("id").alias("_end"))
    done, cut, sizes = [], set(), []
    for depth in range(high + 1):
        grown = front if depth == 0 else _grown(steps, front, labels, depth, beam is not None)
        if beam is None:
            now = checkpointed(grown)
        else:
            # a path may come with several lists of types: the cut is between paths, so it never parts them; partitions
            # are cut before the shuffle
            ranked = grown.withColumn("_rank", F.dense_rank().over(Window.partitionBy("length").orderBy("path"))).where(F.col("_rank") <= beam + 1)
            first = checkpointed(ranked)
            cut |= {r["length"] for r in first.where(F.col("_rank") > beam).select("length").distinct().collect()}
            now = first.where(F.col("_rank") <= beam).drop("_rank")
        sizes.append(now.count())
        if depth >= low:
            done.append(now.where(F.col("length") == depth).select("path", "types", "length"))
        front = now.where(F.col("length") > depth)
        if not sizes[-1]:
            break
    out = reduce(DataFrame.unionByName, done) if done else front.select("path", "types", "length").limit(0)
    return out, {r["length"]: r["count"] for r in out.groupBy("length").count().collect()}, cut, sizes


def paths(
    edges: DataFrame, starts: DataFrame, kinds: Sequence[str], low: int, high: int, targets: DataFrame | None = None,
    limit: int | None = 20, told: list | None = None,
) -> DataFrame:
    """(path, types, length): directed paths of ``low``..``high`` typed edges from ``starts`` (id) that end in ``targets``.

    No edge is used twice in a path. The first ``limit`` by (length, path, types). Nodes are labelled from the far side
    with the numbers of steps in which they can reach a target; paths then grow in final order, and of each length
    only the first ``limit`` partial ones are kept a level: whatever follows them in order can only end after them. Where
    partial paths end in nothing, because their only ways on use an edge again, the search is made again with twice as
    many. ``told`` receives the rows of every level's front, a list for each search. Without a limit all paths are built.
    """
    steps = checkpointed(edges.where(F.col("type").isin(list(kinds))).select("src", "dst", "type").distinct())
    labels = checkpointed(reach_labels(steps, targets, high))
    beam = limit
    while True:
        found, number, cut, sizes = _paths_in_order(steps, starts, labels, low, high, beam)
        if told is not None:
            told.append(sizes)
        if limit is None:
            return found
        have, short = 0, False
        for length in range(low, high + 1):
            have += number.get(length, 0)
            if have >= limit:
                break
            if length in cut:  # some were left out, and those that were kept do not fill the answer
                short = True
                break
        if not short:
            return found.orderBy("length", "path", "types").limit(limit)
        beam *= 2


def _undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, type) of every edge, both ways."""
    return edges.select("src", "dst", "type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def _rooted(starts: DataFrame) -> DataFrame:
    """The paths of no step from ``starts`` (id)."""
    return starts.select("id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.expr("cast(array() as array<string>)").alias("types"))


def _smallest(level: DataFrame, both: DataFrame) -> DataFrame:
    """(id, b): the smallest path and types of one step more to every node beside the level."""
    hop = level.withColumnRenamed("id", "src").join(both, "src")
    return hop.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(
        F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("type")).alias("types")
    )).alias("b"))


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int, target: str | None = None) -> DataFrame:
    """(id, depth, path, types) of the nodes within ``depth`` undirected steps; the smallest of the shortest paths.

    Stops early when the target is reached or nothing new is found.
    """
    both = _undirected(edges)
    level = _rooted(starts.select("id").distinct())
    levels = [checkpointed(level)]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, [x.select("id") for x in levels])
        best = _smallest(levels[-1], both)
        new = checkpointed(best.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "b.path", "b.types"))
        if new.isEmpty():
            break
        levels.append(new)
        if target is not None and not new.where(F.col("id") == target).isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def _meeting(both: DataFrame, start: DataFrame, end: DataFrame, depth: int) -> list[DataFrame] | None:
    """Ids (id) for each step of the shortest undirected walks from ``start`` to ``end`` (id), or None beyond ``depth``: up to
    where the ends meet those on a walk, behind it all that are as far from the end.

    Both ends grow in levels of ids, never of paths, the smaller one first, until they meet.
    """
    near, far = [checkpointed(start)], [checkpointed(end)]
    counts = [near[0].count(), far[0].count()]

    def beside(level: DataFrame) -> DataFrame:
        return both.join(level.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()

    while (middle := near[-1].join(far[-1], "id", "left_semi")).isEmpty():
        if len(near) + len(far) - 2 >= depth or not all(counts):
            return None
        side = 0 if counts[0] <= counts[1] else 1
        levels = (near, far)[side]
        # an edge leads from a level to the one before, the same or the next
        known = reduce(DataFrame.unionByName, levels[-2:])
        levels.append(checkpointed(beside(levels[-1]).join(known, "id", "left_anti")))
        counts[side] = levels[-1].count()
    on = [checkpointed(middle)]
    for level in reversed(near[:-1]):
        on.insert(0, checkpointed(level.join(beside(on[0]), "id", "left_semi")))
    return on + far[-2::-1]


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str, depth: int = 5) -> DataFrame:
    """One row (path, types, depth, explanation) when ``b`` is within ``depth`` undirected steps of ``a``.

    Of several shortest paths the smallest; paths are built over nodes that lie on a shortest one only.
    """
    both = _undirected(edges)
    start = nodes.where(F.col("id") == a).select("id").distinct()
    end = edges.sparkSession.range(1).select(F.lit(b).alias("id"))
    on = _meeting(both, start, end, depth)
    hit = _rooted(start)
    for d, level in enumerate(on[1:] if on else [], 1):
        onward = both.join(level.withColumnRenamed("id", "dst"), "dst", "left_semi")
        hit = checkpointed(_smallest(hit, onward).select("id", F.lit(d).alias("depth"), "b.path", "b.types"))
    hit = hit.where(F.col("id") == b)
    places = hit.select("path", "types", "depth", F.posexplode("path").alias("_i", "_id"))
    named = places.join(nodes.select(F.col("id").alias("_id"), "name"), "_id")
    texts = named.groupBy("path", "types", "depth").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("name", "_id").alias("n")))), lambda x: x["n"]).alias("names")
    )
    steps = F.zip_with(
        F.slice("names", 2, F.size("names")), F.col("types"), lambda n, t: F.concat(F.lit(" -["), t, F.lit("]- "), n)
    )
    return texts.select("path", "types", "depth", F.concat(F.element_at("names", 1), F.array_join(steps, "")).alias("explanation"))


def subgraph(nodes: DataFrame, edges: DataFrame, center: str, depth: int = 2, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges between them): the nearest ``limit`` nodes by (depth, id) around a center."""
    start = nodes.where(F.col("id") == center).select("id")
    near = breadth_first(edges, start, depth).select("id", "depth").orderBy("depth", "id").limit(limit)
    kept = near.join(nodes, "id")
    ids = near.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return kept, inside


# ---- importance and shape -----------------------------------------------------


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, hub_edges: int = 1_000_000) -> DataFrame:
    """(id, rank) over all edges; the rank of nodes without out-edges is spread over all nodes.

    Edges are placed once by (source, salt) and kept; a source with more than
    ``hub_edges`` edges is split over several salts, so a hub is many tasks.
    Each round moves only ranks and partial sums, and is checkpointed.
    """
    pairs = edges.select("src", "dst")
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    degree = checkpointed(degree.withColumn("salts", F.ceil(F.col("out") / hub_edges).cast("int")))
    placed = (
        pairs.join(degree.select("src", "salts"), "src")
        .select("src", "dst", F.pmod(F.hash("dst"), F.col("salts")).alias("salt"))
        .repartition("src", "salt").persist()
    )
    n = nodes.count()
    # a rank is stored without the share every node gets (``spread``); a node nothing points to stores no row
    ranks, spread = None, 1.0 / n
    for _ in range(rounds):
        sending = degree if ranks is None else degree.join(ranks, F.col("src") == F.col("id"), "left")
        own = F.lit(0.0) if ranks is None else F.coalesce("rank", F.lit(0.0))
        sending = sending.select(
            "src", ((own + spread) / F.col("out")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        )
        sums = placed.join(sending, ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg((F.sum("share") * damping).alias("rank"))
        # the total is observed while the round is written: no second pass over it
        seen = Observation()
        ranks = checkpointed(sums.observe(seen, F.sum("rank").alias("total")))
        spread = (1.0 - (seen.get["total"] or 0.0)) / n
    placed.unpersist()
    return nodes.select("id").join(ranks, "id", "left").select("id", (F.coalesce("rank", F.lit(0.0)) + spread).alias("rank"))


def importance(nodes: DataFrame, ranks: DataFrame, label: str, limit: int | None = 50) -> DataFrame:
    """Nodes of a label by rank, scaled so the best has 1."""
    of_label = nodes.where(F.col("label") == label).join(ranks, "id")
    top = of_label.agg(F.max("rank")).scalar()
    scaled = of_label.select("id", "label", "name", (F.col("rank") / top).alias("score"))
    return scaled if limit is None else scaled.orderBy(F.desc("score"), "id").limit(limit)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: in, out and total degree, 0 when it has none."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    out = nodes.select("id", "label", "domain").join(sums, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "id", "label", "domain", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree")
    ).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_summary(nodes: DataFrame, edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row: average, greatest, least and median degree."""
    d = degrees(nodes, edges).select(F.col("degree").cast("double").alias("degree"))
    base = d.agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    median = quantiles(d, [], "degree", {"m": 0.5}, hot_rows).scalar()
    return base.withColumn("median_degree", median)


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, item, value): node and edge counts, label and type distributions, density 2m/(n(n-1))."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("v")), edges.agg(F.count(F.lit(1)).alias("v"))

    def row(df: DataFrame, metric: str, item: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), item.alias("item"), F.col("v").cast("double").alias("value"))

    labels = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("v"))
    kinds = edges.groupBy("type").agg(F.count(F.lit(1)).alias("v"))
    n_nodes = F.col("_n")
    density = m.withColumn("_n", n.scalar()).select(
        F.when(n_nodes > 1, 2.0 * F.col("v") / (n_nodes * (n_nodes - 1))).otherwise(0.0).alias("v")
    )
    parts = [
        row(n, "nodes", F.lit("")), row(m, "edges", F.lit("")), row(labels, "label", F.col("label")),
        row(kinds, "type", F.col("type")), row(density, "density", F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def link_prediction(nodes: DataFrame, edges: DataFrame, source: str, kind: str, limit: int = 20, names: int = 5) -> DataFrame:
    """Nodes that share targets with ``source`` but are not its targets: common count, score / best, first shared names.

    The names are looked up only for the nodes that stay, five rows each.
    """
    typed = edges.where(F.col("type") == kind).select("src", "dst").distinct()
    mine = typed.where(F.col("src") == source).select(F.col("dst").alias("shared"))
    shared = typed.join(mine, F.col("dst") == F.col("shared")).where(F.col("src") != source).select(F.col("src").alias("candidate"), "shared")
    counts = shared.groupBy("candidate").agg(F.count(F.lit(1)).alias("common"))
    fresh = counts.join(mine, F.col("candidate") == F.col("shared"), "left_anti")
    top = fresh.orderBy(F.desc("common"), "candidate").limit(limit)
    best = top.agg(F.max("common")).scalar()
    labelled = shared.join(top.select("candidate"), "candidate").join(
        nodes.select(F.col("id").alias("shared"), "name"), "shared"
    ).select("candidate", "name").distinct()
    from fieldloom.operators.sets import topk_per_group

    few = topk_per_group(labelled, ["candidate"], [F.col("name")], names).groupBy("candidate").agg(
        F.array_sort(F.collect_list("name")).alias("evidence")
    )
    return top.withColumn("score", F.round(F.col("common") / best, 4)).join(few, "candidate", "left")


def patterns(
    nodes: DataFrame, edges: DataFrame, domain: str | None = None, monitor: str = "Observation", hub_degree: int = 10, hub_ratio: float = 5.0
) -> DataFrame:
    """(pattern, id, severity): isolated nodes, hubs, species without habitat, regions nothing observes."""
    scope = nodes if domain is None else nodes.where(F.col("domain") == domain)
    d = degrees(scope, edges)
    hub = (F.col("degree") > hub_degree) & (F.col("out_degree") / (F.col("in_degree") + 1) > hub_ratio)
    # one pass over the degrees marks both patterns
    shaped = d.select(
        "id", F.when(F.col("degree") == 0, F.struct(F.lit("isolated_node").alias("pattern"), F.lit("medium").alias("severity")))
        .when(hub, F.struct(F.lit("hub_imbalance").alias("pattern"), F.lit("low").alias("severity"))).alias("m"),
    ).where("m IS NOT NULL").select("m.pattern", "id", "m.severity")
    homes = edges.where("type = 'INHABITS'").select(F.col("src").alias("id"))
    homeless = nodes.where("label = 'Species'").select("id").join(homes, "id", "left_anti")
    watchers = nodes.where(F.col("label") == monitor).select(F.col("id").alias("src"))
    watched = edges.where("type = 'LOCATED_IN'").join(watchers, "src", "left_semi").select(F.col("dst").alias("id"))
    blind = nodes.where("label = 'Region'").select("id").join(watched, "id", "left_anti")
    return (
        shaped.unionByName(homeless.select(F.lit("missing_expected_link").alias("pattern"), "id", F.lit("high").alias("severity")))
        .unionByName(blind.select(F.lit("unmonitored_region").alias("pattern"), "id", F.lit("medium").alias("severity")))
    )


# ---- templates ----------------------------------------------------------------


def threats(nodes: DataFrame, edges: DataFrame, region: str, label: str = "Ecosystem") -> DataFrame:
    """Ecosystems of a region, one row per threat (null when none), with the threat count."""
    from fieldloom.operators.joins import join_optional

    located = edges.where((F.col("type") == "LOCATED_IN") & (F.col("dst") == region)).select(F.col("src").alias("id"))
    systems = nodes.where(F.col("label") == label).join(located, "id", "left_semi").select(F.col("id").alias("ecosystem"), F.col("name").alias("ecosystem_name"))
    by = edges.where("type = 'THREATENS'").select(F.col("src").alias("threat"), F.col("dst").alias("_of"))
    return join_optional(systems, by, "ecosystem", "_of").drop("_of").withColumnRenamed("matches", "threat_count")


def habitat_overlap(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Habitats two species share."""
    lives = edges.where("type = 'INHABITS'")
    first = lives.where(F.col("src") == a).select(F.col("dst").alias("id"))
    second = lives.where(F.col("src") == b).select(F.col("dst").alias("id"))
    return nodes.join(first, "id", "left_semi").join(second, "id", "left_semi").select("id", "name")


def hotspots(nodes: DataFrame, edges: DataFrame, at_least: int) -> DataFrame:
    """Regions by number of species over their habitats, with the endangered share."""
    from fieldloom.operators.aggregates import species_richness

    lives = edges.where("type = 'INHABITS'").select(F.col("src").alias("species"), F.col("dst").alias("habitat"))
    located = edges.where("type = 'LOCATED_IN'").select(F.col("src").alias("habitat"), F.col("dst").alias("region"))
    # distinct (species, region) first: the status lookup then joins far fewer rows
    pairs = lives.join(located, "habitat").select("species", "region").distinct()
    typed = pairs.join(nodes.where("label = 'Species'").select(F.col("id").alias("species"), "status"), "species")
    regions = nodes.where("label = 'Region'").select(F.col("id").alias("region"))
    return species_richness(typed.join(regions, "region", "left_semi"), "region", "species", "status", at_least)


def dependencies(nodes: DataFrame, edges: DataFrame, region: str, kinds: Sequence[str] = ("DEPENDS_ON", "CONSUMES", "PRODUCES")) -> DataFrame:
    """Resource edges of the entities within two steps of a region."""
    inside = region_closure(edges, region)
    deps = edges.where(F.col("type").isin(list(kinds))).join(inside.withColumnRenamed("id", "src"), "src", "left_semi")
    who, what = nodes.select(F.col("id").alias("src"), F.col("name").alias("entity")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("resource"))
    return deps.join(who, "src").join(what, "dst").select("src", "entity", "type", "dst", "resource", "strength")


def cross_domain(nodes: DataFrame, edges: DataFrame, a: str, b: str, region: str, kinds: Sequence[str], limit: int = 50) -> DataFrame:
    """Linking edges between entities of two domains in one region, strongest first."""
    inside = checkpointed(region_closure(edges, region))
    left = nodes.where(F.col("domain") == a).join(inside, "id", "left_semi").select(F.col("id").alias("src"))
    right = nodes.where(F.col("domain") == b).join(inside, "id", "left_semi").select(F.col("id").alias("dst"))
    links = edges.where(F.col("type").isin(list(kinds))).join(left, "src", "left_semi").join(right, "dst", "left_semi")
    return links.select("src", "type", "dst", "strength").orderBy(F.desc("strength"), "src", "dst", "type").limit(limit)


def policy_impact(nodes: DataFrame, edges: DataFrame, policy: str) -> DataFrame:
    """(role, id, name): mitigated threats, protected, influenced, and what the mitigated threats threaten.

    Four distinct lists joined as rows; the combination of the lists is never formed.
    """
    roles = {"MITIGATES": "mitigated", "PROTECTS": "protected", "INFLUENCES": "influenced"}
    out = edges.where(F.col("src") == policy)
    role = F.lit(None).cast("string")
    for kind, name in roles.items():
        role = F.when(F.col("type") == kind, name).otherwise(role)
    direct = out.select(role.alias("role"), F.col("dst").alias("id")).where("role IS NOT NULL")
    tackled = out.where("type = 'MITIGATES'").select(F.col("dst").alias("src"))
    indirect = edges.where("type = 'THREATENS'").join(tackled, "src", "left_semi").select(F.lit("indirect").alias("role"), F.col("dst").alias("id"))
    return direct.unionByName(indirect).distinct().join(nodes.select("id", "name"), "id").select("role", "id", "name")


def recommendation(nodes: DataFrame, edges: DataFrame, region: str, domain: str) -> DataFrame:
    """(part, id, other, type): entities of a domain in a region, their relationships, open alerts, and policies on them."""
    inside = checkpointed(region_closure(edges, region))
    of_domain = F.col("domain").isNull() | (F.col("domain") == domain)
    entities = nodes.where(of_domain).join(inside, "id", "left_semi")
    ids = entities.select("id")
    connected = nodes.where(of_domain | F.col("label").isin("Region", "Ecosystem", "Habitat", "Policy")).select(F.col("id").alias("dst"))
    rels = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(connected, "dst", "left_semi")
    alerts = nodes.where((F.col("label") == "Alert") & (F.col("domain") == domain) & (F.coalesce("status", F.lit("open")) != "resolved"))
    alerts = alerts.join(inside, "id", "left_semi")
    policies = edges.where("type IN ('PROTECTS', 'MITIGATES')").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    policies = policies.join(nodes.where("label = 'Policy'").select(F.col("id").alias("src")), "src", "left_semi").select("src").distinct()
    none = F.lit(None).cast("string")

    def part(df: DataFrame, name: str, id_: str, other: Column = none, kind: Column = none) -> DataFrame:
        return df.select(F.lit(name).alias("part"), F.col(id_).alias("id"), other.alias("other"), kind.alias("type"))

    return (
        part(entities, "entity", "id").unionByName(part(rels, "relationship", "src", F.col("dst"), F.col("type")).distinct())
        .unionByName(part(alerts, "alert", "id")).unionByName(part(policies, "policy", "src"))
    )


# ---- building -------------------------------------------------------------------


def build_region_links(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, kind: str = "LOCATED_IN", size: float = 10.0) -> DataFrame:
    """LOCATED_IN edges from points to the boxes that hold them."""
    from fieldloom.operators.spatial import join_point_bbox

    hits = join_point_bbox(points, boxes, size=size)
    return hits.select(F.col(point_id).alias("src"), F.col(box_id).alias("dst"), F.lit(kind).alias("type")).distinct()


def build_species_links(observations: DataFrame, species: DataFrame, habitats: DataFrame, size: float = 10.0) -> DataFrame:
    """MONITORS edges observation -> species by name, and INHABITS edges species -> habitat box of the observation."""
    from fieldloom.operators.spatial import join_point_bbox

    known = observations.join(species.select("species_id", F.col("scientific_name").alias("species_name")), "species_name")
    monitors = known.select(F.col("obs_id").alias("src"), F.col("species_id").alias("dst"), F.lit("MONITORS").alias("type")).distinct()
    # places of a species first: repeated observations at one place are joined once
    places = known.select("species_id", "lon", "lat").distinct()
    homes = join_point_bbox(places, habitats, size=size)
    return monitors.unionByName(homes.select(F.col("species_id").alias("src"), F.col("habitat_id").alias("dst"), F.lit("INHABITS").alias("type")).distinct())


def build_adjacency(boxes: DataFrame, key: str, size: float = 10.0) -> DataFrame:
    """ADJACENT_TO edges, both directions, between overlapping boxes."""
    from fieldloom.operators.spatial import join_bbox_overlap

    return join_bbox_overlap(boxes, key, size).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("ADJACENT_TO").alias("type"))


def build_causal(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """CAUSES edges of the evidence rows whose ends both exist; missing strength and confidence are 0."""
    ids = nodes.select("id")
    ok = evidence.join(ids.withColumnRenamed("id", "cause"), "cause", "left_semi").join(ids.withColumnRenamed("id", "effect"), "effect", "left_semi")
    return ok.select(
        F.col("cause").alias("src"), F.col("effect").alias("dst"), F.lit("CAUSES").alias("type"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def adjacency_matrix(edges: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per variable, one column per effect: summed strength, 0 where there is no edge."""
    cells = edges.where(F.col("src").isin(list(variables))).groupBy(F.col("src").alias("variable")).agg(
        *[F.coalesce(F.sum(F.when(F.col("dst") == v, F.col("strength"))), F.lit(0.0)).alias(v) for v in variables]
    )
    spine = edges.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in variables])).alias("variable"))
    return spine.join(cells, "variable", "left").select("variable", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in variables])


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level): causes before effects. Each round takes the nodes no remaining edge leads to; a cycle is an error."""
    rest = checkpointed(edges.select("src", "dst").distinct())
    left = checkpointed(rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct())
    levels = []
    for level in itertools.count():
        free = checkpointed(left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            if not left.isEmpty():
                raise ValueError("the graph has a cycle")
            break
        levels.append(free.withColumn("level", F.lit(level)))
        rest = checkpointed(rest.join(free.withColumnRenamed("id", "src"), "src", "left_anti"))
        left = checkpointed(left.join(free, "id", "left_anti"))
    return reduce(DataFrame.unionByName, levels)

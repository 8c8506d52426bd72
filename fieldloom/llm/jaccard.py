"""Exact Jaccard join of documents' shingle sets as a metric-space join.

Jaccard distance d is a metric, but most documents are at distance 1 from any other, where no pivot tells them apart.
So the space is divided twice.

1. Regions of anchors. The size of the difference, q(x, y) = |x - y|, obeys the triangle inequality too, and a link
   leaves q(x, y) <= |x| / 4. Take one order of all shingles; the pivot of shingle s is the set of s and all that come
   after it. A document's nearest pivot is that of its first shingle. If s is the first shingle that x and y share,
   both lie within |x| / 4 and |y| / 4 of the pivot of s, so replicating every document into the regions of its first
   ``|x| // 4 + 1`` shingles (the window) brings each linked pair together. The order puts shingles that recur in many
   documents last; it decides how large regions are, never which pairs are found.
2. Recursion inside a region with Jaccard distance. First every member is compared with one pivot document, the one
   that meets most others in its regions, then members that are not connected yet with a few more; this settles groups of
   copies, since documents linked to one pivot are connected. A region whose members are all connected is done. A
   region that stays open is finished: as single pairs that are not connected and whose distances to the region's pivot
   differ by r at most, or, if those are many, in tiles. Only a very large one is split: it gets about sqrt(members)
   pivots; a document goes to the Voronoi cell of its nearest pivot c, if within 1 / 2 of it, and to those of other
   pivots p with d(x, p) <= d(x, c) + 2 r; what is far from all pivots is a region of its own, with the documents that
   lie within r of it. These are regions for the next round.

A pair is measured in two steps. Two documents' anchors are complete up to the smaller of their last ones; the
difference that shows there bounds the distance from below, and only pairs that may still be links are compared whole.

Equal sets are one set from the start. Sets are named by 64-bit digests; the sets themselves are built again from
the texts of those documents that share a region with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import bounded_batches, sieved, sifted, spare, stored, text_of
from fieldloom.llm.components import components
from fieldloom.llm.shingles import digest, shingle_sets
from fieldloom.llm.wordpieces import blocks

WORDS, PERCENT = 5, 75
#: unconnected pairs of a region that is finished as pairs, members of one that is finished in tiles, and of a tile's side
BLOCK, TILED, SIDE = 1 << 12, 1 << 14, 128
#: rounds in which regions with more unconnected pairs than this get so many more pivots, before they are finished or split
ROUNDS, LOOSE, PIVOTS = 1, 64, 5
#: shingles that are told to all tasks as common, and how often they recur at least; both only shape the order
COMMON, COMMON_DOCS = 1 << 18, 4
#: anchors carry their place in the order: the level in the upper bits, the shingle below
LEVEL_SHIFT = np.uint64(57)

SETS = "doc_id long, text_hash long, id long, n int, anchors array<long>"


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that recur in many documents with their levels, by shingle: at most ``COMMON`` of them.

    Every block of all documents counts its shingles and reports those it has more than once, so that only the
    frequent ones are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = {digest(s): s for s in shingle_sets(block.column("text"), words)}.values()
                found, many = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
                kept = many > 1
                yield pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(many[kept])], names=["shingle", "n"])

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS)
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    order = np.argsort(top["shingle"].to_numpy(np.int64).view(np.uint64))
    return np.stack([top["shingle"].to_numpy(np.int64).view(np.uint64)[order], np.frexp(top["n"].to_numpy(float))[1].astype(np.uint64)[order]])


def shingled(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """For every row its set's digest and size, and its anchors: the first shingles that a link cannot all miss."""
    told = docs.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, levels = told.value
        flags = np.zeros(1 << 22, bool)
        mask = np.uint64(len(flags) - 1)
        flags[shingles & mask] = True

        def anchors(s: np.ndarray) -> np.ndarray:
            n = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
            doubt = np.flatnonzero(flags[s & mask]) if len(shingles) else ()
            if not len(doubt):
                return s[:n] >> (64 - LEVEL_SHIFT)
            at = np.minimum(np.searchsorted(shingles, s[doubt]), len(shingles) - 1)
            hit = shingles[at] == s[doubt]
            placed = s >> (64 - LEVEL_SHIFT)
            placed[doubt[hit]] |= levels[at[hit]] << LEVEL_SHIFT
            return np.sort(placed)[:n]

        for batch in batches:
            for block in blocks(batch, "text"):
                sets = shingle_sets(block.column("text"), words)
                first = [anchors(s) for s in sets]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(a) for a in first])]).astype(np.int32), np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_hash"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists], names=["doc_id", "text_hash", "id", "n", "anchors"])

    return docs.mapInArrow(read, SETS)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y, low (a lower bound of the distance), open (whether they may be linked) for ``pairs`` (x, y) of set ids.

    Only sets of ``pairs`` are sent, with the upper halves of their anchors: what differs in these differs in the anchors,
    and below the last one's half both lists are complete, so the bound holds.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, open_ = [], []
            sizes = (np.asarray(batch.column("n_x")) + np.asarray(batch.column("n_y"))).tolist()
            least = np.abs(np.asarray(batch.column("n_x")) - np.asarray(batch.column("n_y"))).tolist()
            lists = []
            for side in "xy":
                column = batch.column(f"anchors_{side}")
                flat, offsets = np.asarray(column.values), np.asarray(column.offsets).tolist()
                lists.append([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])
            for a, b, size, apart in zip(*lists, sizes, least, strict=True):
                last = min(a[-1], b[-1])
                a, b = np.unique(a[: np.searchsorted(a, last)]), np.unique(b[: np.searchsorted(b, last)])
                apart = max(apart, len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True)))
                low.append(2 * apart / (size + apart))
                open_.append(apart * (100 + percent) <= size * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(low, pa.float64()), pa.array(open_, pa.bool_())], names=["x", "y", "low", "open"])

    ids = stored(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), "compared")
    # levels are small, so a half is no negative number and its order is that of the anchors
    half = F.transform("anchors", lambda a: F.shiftright(a, 32).cast("int")).alias("anchors")
    sets = sieved(sets, F.col("id"), ids, F.col("id")).select("id", "n", half)
    sides = [sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("anchors").alias(f"anchors_{s}")) for s in "xy"]
    joined = pairs.join(sides[0], "x").join(sides[1], "y").select("x", "y", "n_x", "n_y", "anchors_x", "anchors_y")
    return joined.mapInArrow(compare, "x long, y long, low double, open boolean")


def overlaps(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """x, y, both (size of the intersection), either (of the union) for ``pairs`` (x, y) of set ids."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text_x"):
                xs, ys = block.column("x").to_pylist(), block.column("y").to_pylist()
                sets: dict[int, np.ndarray] = {}
                for ids, column in ((ys, "text_y"), (xs, "text_x")):
                    new = {i: k for k, i in enumerate(ids) if i not in sets}
                    sets |= zip(new, shingle_sets(block.column(column).take(pa.array(list(new.values()), pa.int64())), words), strict=True)
                both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(xs, ys, strict=True)]
                either = [len(sets[x]) + len(sets[y]) - n for x, y, n in zip(xs, ys, both, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("x"), block.column("y"), pa.array(both, pa.int32()), pa.array(either, pa.int32())], names=["x", "y", "both", "either"])

    a = texts.select(F.col("id").alias("x"), F.col("text").alias("text_x"))
    b = texts.select(F.col("id").alias("y"), F.col("text").alias("text_y"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "text_x", "text_y").mapInArrow(compare, "x long, y long, both int, either int")


def tile_links(member: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) that connect all linked members of regions (region, id, comp): every text is sent a few times, no pair is.

    A region's largest component is its major part; its members are connected and need no comparison with each other.
    The rest is the minor part. Both are cut into sides of about ``SIDE`` members, and a tile is a minor side with another
    minor or a major one. A tile counts all its intersections as matrix products over its shingles.
    """
    parts = member.groupBy("region", "comp").agg(F.count("*").alias("c"))
    parts = parts.groupBy("region").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"))
    sides = lambda n: F.greatest(F.ceil(n / SIDE), F.lit(1)).cast("int")
    parts = parts.select("region", F.col("top.comp").alias("major"), sides(F.col("top.c")).alias("majors"), sides(F.col("m") - F.col("top.c")).alias("minors"))
    rows = member.select("region", "id", "comp").join(parts, "region").withColumn("minor", F.col("comp") != F.col("major"))
    side = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    rows = rows.withColumn("side", side)
    count = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    own = F.concat(
        F.transform(count(F.col("minors")), lambda j: tile(F.least(F.col("side"), j), F.greatest(F.col("side"), j))),
        F.transform(count(F.col("majors")), lambda k: tile(F.col("side"), -1 - k)),
    )
    other = F.transform(count(F.col("minors")), lambda i: tile(i, -1 - F.col("side")))
    copies = rows.withColumn("tile", F.explode(F.when(F.col("minor"), own).otherwise(other))).join(texts, "id").select("region", "tile.a", "tile.b", "id", "text")

    def compare(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"))
        sets = shingle_sets(table.column("text").combine_chunks(), words)
        sizes = np.array([len(x) for x in sets])
        kinds, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        for low in range(0, len(kinds), 1 << 14):  # the shingles in parts, so that the matrix stays small
            a, b = np.searchsorted(place, [low, low + (1 << 14)])
            dense = np.zeros((len(ids), 1 << 14), np.float32)
            dense[owner[a:b], place[a:b] - low] = 1
            both += dense @ dense.T
        either = sizes[:, None] + sizes[None] - both
        i, j = np.nonzero(np.triu(100 * both >= percent * either, 1))
        root = np.arange(len(ids))
        while True:  # the first row reachable inside the tile
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[at]), "v": pa.array(ids[root[at]])})

    return copies.groupBy("region", "a", "b").applyInArrow(compare, "u long, v long")


def links(sets: DataFrame, sets_of, texts_of, words: int, percent: int, block: int = BLOCK, tiled: int = TILED) -> DataFrame | None:
    """Links (u, v) between different ``sets`` (id, n, anchors) that connect all that are linked; None if there are none.

    ``sets_of(ids)`` gives those of a table of ids again, ``texts_of(ids)`` their id, text.
    """
    r = 1 - percent / 100 + 1e-9
    # a region's rows meet once, where its size and its members' common hash are found; all else goes by id
    region = Window.partitionBy("region")
    rows = sets.select("id", F.explode("anchors").alias("region")).withColumn("m", F.count("*").over(region)).where("m > 1")
    rows = stored(rows.withColumn("who", F.bit_xor(F.xxhash64("id")).over(region)), "regions")
    if rows.isEmpty():
        return None
    # regions with the same members are one: each member names the same one of them
    members = rows.repartition("id").groupBy("id", "m", "who").agg(F.min("region").alias("region"), F.count("*").alias("same"))
    weight = F.sum(F.col("same") * (F.col("m") - 1)).over(Window.partitionBy("id"))
    members = stored(members.select("region", "id", weight.alias("weight")), "members")
    sets = stored(sets_of(members.select("id").distinct()), "open-sets")

    known: DataFrame | None = None
    found: DataFrame | None = None

    def measure(pairs: DataFrame) -> None:
        """Adds to ``known`` the pairs (x, y) that are not there, and to ``found`` the links among them."""
        nonlocal known, found
        pairs = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["x", "y"], "left_anti")
        # sizes alone rule out most; the anchors are sent for the others only
        sized = pairs.join(sets.select(F.col("id").alias("x"), F.col("n").alias("n_x")), "x").join(sets.select(F.col("id").alias("y"), F.col("n").alias("n_y")), "y")
        apart, size = F.abs(F.col("n_x") - F.col("n_y")), F.col("n_x") + F.col("n_y")
        sized = stored(sized.select("x", "y", (2 * apart / (size + apart)).alias("low"), (apart * (100 + percent) <= size * (100 - percent)).alias("open")), "sizes")
        judged = stored(bounded(sized.where("open").select("x", "y"), sets, percent).unionByName(sized.where("not open")), "bounds")
        left = judged.where("open").select("x", "y")
        ids = left.select(F.col("x").alias("id")).unionByName(left.select(F.col("y").alias("id"))).distinct()
        done = stored(overlaps(left, stored(texts_of(ids), "texts"), words), "overlaps")
        exact = 1 - F.col("both") / F.col("either")
        news = judged.join(done, ["x", "y"], "left").select("x", "y", F.coalesce(exact, "low").alias("low"), exact.alias("d"))
        known = stored(news if known is None else known.unionByName(news), "known")
        ties = done.where(F.col("both") * 100 >= F.col("either") * percent).select(F.col("x").alias("u"), F.col("y").alias("v"))
        found = stored(ties if found is None else found.unionByName(ties), "links")

    def distances(pairs: DataFrame) -> DataFrame:
        """``pairs`` (with id and p) and what is known of them."""
        at = pairs.withColumn("x", F.greatest("id", "p")).withColumn("y", F.least("id", "p"))
        return at.join(known, ["x", "y"]).drop("x", "y")

    star = members.withColumn("p", F.max(F.struct("weight", "id")).over(region)["id"])
    star = stored(star, "stars")
    rest = star.where("id <> p")
    measure(rest.select(F.col("id").alias("x"), F.col("p").alias("y")))
    seat = distances(rest).select("region", "id", "weight", "d")
    regions = stored(seat.unionByName(star.where("id = p").select("region", "id", "weight", F.lit(0.0).alias("d"))), "seats")
    turn = 0
    while True:
        turn += 1
        member = regions.join(components(found), F.col("id") == F.col("node"), "left").select("region", "id", "weight", "d", F.coalesce("component", "id").alias("comp"))
        member = stored(member, "members")
        each = member.groupBy("region", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
        shape = each.groupBy("region").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("tied"), F.sum("who").alias("who"))
        shape = shape.withColumn("pairs", (F.col("m") * F.col("m") - F.col("tied")) / 2).where("pairs > 0")
        shape = shape.groupBy("m", "who").agg(F.min(F.struct("region", "pairs")).alias("one")).select("m", "one.*")
        member = stored(member.join(shape, "region"), "members")
        if member.isEmpty():
            return found
        if turn <= ROUNDS:
            # a few members, the same in all regions that share them, meet those that are not connected with them
            loose = member.where(F.col("pairs") > min(LOOSE, block))
            rank = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("id"), "id"))
            next_ = loose.withColumn("rank", rank).where((F.col("rank") > PIVOTS * (turn - 1)) & (F.col("rank") <= PIVOTS * turn))
            pivots = next_.select("region", F.col("id").alias("p"), F.col("comp").alias("cp"))
            measure(loose.join(pivots, "region").where(F.col("comp") != F.col("cp")).select(F.col("id").alias("x"), F.col("p").alias("y")))
            continue
        small, large = member.where(F.col("pairs") <= block), member.where(F.col("pairs") > block)
        whole, large = large.where(F.col("m") <= tiled), large.where(F.col("m") > tiled)
        if not whole.isEmpty():
            found = stored(found.unionByName(tile_links(whole, stored(texts_of(whole.select("id").distinct()), "texts"), words, percent)), "links")

        a = small.select("region", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("d").alias("dx"))
        b = small.select("region", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("d").alias("dy"))
        window = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= r, F.lit(True))
        measure(a.join(b, "region").where((F.col("x") > F.col("y")) & (F.col("cx") != F.col("cy")) & window).select("x", "y"))
        if large.isEmpty():
            return found

        # about sqrt(m) pivots, the heaviest among them
        heavy = large.groupBy("region").agg(F.max_by("id", F.struct("weight", "id")).alias("heavy"))
        large = large.join(heavy, "region")
        chosen = (F.pmod(F.xxhash64("id", F.lit(turn)), F.col("m")) < F.ceil(F.sqrt("m"))) | (F.col("id") == F.col("heavy"))
        pivots = stored(large.where(chosen).select("region", F.col("id").alias("p")), "pivots")
        pairs = large.select("region", "id", "weight").join(pivots, "region").where("id <> p")
        measure(pairs.select(F.col("id").alias("x"), F.col("p").alias("y")))
        # pivots have met every member and leave
        spread = distances(pairs).join(pivots.select("region", F.col("p").alias("id")), ["region", "id"], "left_anti")
        spread = stored(spread, "spread")
        nearest = spread.groupBy("region", "id", "weight").agg(F.min("d").alias("dc"), F.min("low").alias("low"))
        nearest = nearest.withColumn("near", F.coalesce(F.col("dc") < 0.5, F.lit(False)))
        cells = spread.join(nearest.where("near").select("region", "id", "dc"), ["region", "id"]).where(F.col("low") <= F.col("dc") + 2 * r)
        # what is far from all pivots, and what may be linked with that
        edge = nearest.where("not near").groupBy("region").agg(F.min("low").alias("edge"))
        rest = nearest.join(edge, "region").where(~F.col("near") | (F.col("dc") >= F.col("edge") - r))
        regions = cells.select(F.xxhash64("region", "p", F.lit(turn)).alias("region"), "id", "weight", "d").unionByName(
            rest.select(F.xxhash64("region", F.lit("rest"), F.lit(turn)).alias("region"), "id", "weight", F.lit(None).cast("double").alias("d"))
        )
        regions = stored(regions, "regions")


def classes_of(docs: DataFrame, words: int, percent: int, block: int, tiled: int) -> tuple[DataFrame, DataFrame]:
    """The set (id, n) of every row of ``docs`` (doc_id, text_hash), and every worded set's class: id, class, row.

    A class is named by one of its sets, never by a doc_id; row (null, doc_id, text_hash) is its least one.
    """
    texts = bounded_batches(docs.select("doc_id", text_of("text").alias("text")).withColumn("text_hash", F.xxhash64("text")))
    common = common_shingles(texts, words)
    named = stored(shingled(texts.select("doc_id", "text_hash", "text"), common, words, percent), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    # most sets stand once, and their anchors stay where they are; only those of sets that may stand again are shuffled
    worded = named.where("n > 0").select("id", "n", "anchors")
    again = stored(worded.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated")
    sets = sifted(worded, F.col("id"), again, F.col("id"), "again")
    once = sets.where("again").groupBy("id").agg(F.first("n").alias("n"), F.first("anchors").alias("anchors"))
    sets = sets.where("not again").drop("again").unionByName(once)
    first = named.where("n > 0").groupBy("id").agg(F.min(row).alias("row"))

    def sets_of(ids: DataFrame) -> DataFrame:
        # no semi-join: Spark would move that before the sieve
        ids = stored(ids.distinct(), "wanted")
        return sieved(named, F.col("id"), ids, F.col("id")).join(ids, "id").select("id", "n", "anchors").dropDuplicates(["id"])

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = first.join(ids, "id", "left_semi").select("id", F.col("row.doc_id").alias("wanted_doc"), F.col("row.text_hash").alias("wanted_hash"))
        wanted = stored(wanted, "wanted")
        same = F.col("doc_id").eqNullSafe(F.col("wanted_doc")) & (F.col("text_hash") == F.col("wanted_hash"))
        return sieved(texts, F.col("text_hash"), wanted, F.col("wanted_hash")).join(wanted, same).select("id", "text").dropDuplicates(["id"])

    found = links(sets, sets_of, texts_of, words, percent, block, tiled)
    if found is None:
        return named, first.select("id", F.col("id").alias("class"), "row")
    tied = first.join(components(found), F.col("id") == F.col("node"), "left").select("id", "row", F.coalesce("component", "id").alias("class"))
    return named, tied.select("id", "class").join(tied.groupBy("class").agg(F.min("row").alias("row")), "class").select("id", "class", "row")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, tiled: int = TILED) -> DataFrame:
    """Classes of documents whose shingle sets have ``intersection / union >= percent / 100``, linked or through others.

    ``docs`` needs doc_id and text. Returns, in a row for each row of ``docs``: doc_id, text_hash, n_shingles,
    component_id, the smallest doc_id of the class. Texts that are null or hold no word have no shingles and are a class of
    their own. Repeated rows and equal sets are one class; null ids never name a class unless all its ids are null. An
    empty table gives none.
    """
    named, classes = classes_of(docs, words, percent, block, tiled)
    out = named.select("doc_id", "text_hash", "id", "n").join(classes.select("id", F.col("row.doc_id").alias("component_id")), "id", "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, tiled: int = TILED) -> DataFrame:
    """``docs`` with one row of each class: the one whose doc_id names it. Of rows that repeat it, one stays.

    Classes are told apart by their sets: rows with null or repeated ids stay where their texts are of different classes.
    Documents without words are classes of their own, row by row, and stay.
    """
    named, classes = classes_of(docs, words, percent, block, tiled)
    worded = classes.select("row.doc_id", "row.text_hash", "class").distinct()
    kept = worded.unionByName(named.where("n = 0").select("doc_id", "text_hash", F.lit(None).cast("long").alias("class")).distinct())
    hashed, group = spare(docs, "text_hash", "class")
    left = docs.withColumn(hashed, F.xxhash64(text_of("text"))).alias("d")
    right = kept.select(F.col("doc_id").alias("k_doc"), F.col("text_hash").alias("k_hash"), F.col("class").alias("k_class")).alias("k")
    rows = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("k.k_doc")) & (F.col(f"d.{hashed}") == F.col("k.k_hash"))).select("d.*", F.col("k.k_class").alias(group))
    return rows.where(F.col(group).isNotNull()).dropDuplicates([group]).unionByName(rows.where(F.col(group).isNull())).drop(hashed, group)

"""The prefix trie of conversations, from digests of blocks of turns.

A conversation's turns are digested in blocks of fixed length. The key of a prefix is a digest of its depth and of sums
over its turns' salted digests, so the key of every block's end comes from one running sum over blocks. Conversations
are grouped by these keys first: those that agree in a block and all before it are one row from there on, and one of
them, the smallest, stands for all. Only where blocks after the same prefix differ are their turns compared, one row a
different block and turn; in all other blocks each turn is a node with the block's members.

Sums over subtrees need no walk: a node belongs to its smallest member, and the subtree of a node holds what its members
own, without what its own smallest member has above it. A node with a single member is on a chain with one leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored, text_of
from fieldloom.operators.scale import running_sums, with_position

#: turns of a block
BLOCK = 8
#: characters of one piece of a list of ids
PIECE = 1 << 16
LANES = ("l1", "l2", "l3", "l4")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest and n_bytes (of the text) of ``turns`` (conv_id, turn, role, text); null role or text: empty.

    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = text_of("role"), text_of("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return turns.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def in_order(turns: DataFrame, name: str, hot_rows: int | None = None) -> DataFrame:
    """``digests`` rows with their place in the conversation from 1: by turn, null first; ties by digest."""
    return with_position(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], name, hot_rows)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *sums))


def _upto(turns: Column, n: Column, lane: str) -> Column:
    """Sum of a lane over the first ``n`` turns of a block."""
    return F.aggregate(F.slice(turns, F.lit(1), n), F.lit(0).cast("long"), lambda total, t: total + t[lane])


def _blocks(turns: DataFrame, size: int, hot_rows: int | None) -> DataFrame:
    """A row for each conversation and block: start and whole (keys before and after it) and its turns."""
    salted = F.md5(F.concat_ws(":", "pos", "digest"))
    lanes = [F.conv(F.substring(salted, 8 * k + 1, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(LANES)]
    rows = in_order(turns, "pos", hot_rows).select("conv_id", F.floor((F.col("pos") - 1) / size).alias("block"), "pos", "n_bytes", *lanes)
    # at most ``size`` turns a row
    made = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "n_bytes", *LANES))).alias("turns"), *[F.sum(c).alias(c) for c in LANES])
    before = [f"before_{c}" for c in LANES]
    summed = running_sums(made, ["conv_id"], [F.col("block")], {b: F.col(c) for b, c in zip(before, LANES, strict=True)}, include_current=False, hot_rows=hot_rows)
    first, n = F.col("block") * size, F.size("turns")
    keys = summed.select("conv_id", "block", "turns", *before, _key(first, [F.col(b) for b in before]).alias("start"), _key(first + n, [F.col(b) + F.col(c) for b, c in zip(before, LANES, strict=True)]).alias("whole"))
    return stored(keys, "blocks")


def _turns_of(blocks: DataFrame) -> DataFrame:
    """The nodes inside ``blocks``, one row a turn: key, parent, depth, n_bytes and what else the blocks carry."""

    def node(t: Column, i: Column) -> Column:
        def at(depth: Column, n: Column) -> Column:
            return _key(depth, [F.col(f"before_{c}") + _upto(F.col("turns"), n, c) for c in LANES])

        return F.struct(at(t["pos"], i + 1).alias("key"), at(t["pos"] - 1, i).alias("parent"), t["pos"].alias("depth"), t["n_bytes"].alias("n_bytes"))

    return blocks.select("start", "whole", "n_convs", "conv_id", "fork", F.explode(F.transform("turns", node)).alias("node")).select("start", "whole", "n_convs", "conv_id", "fork", "node.*")


def ids_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: of the decimal ids of each key of ``ends`` (key, conv_id, no repeats), ascending, comma-joined.

    Ids are joined to pieces where the sort has put them, a key over as many tasks as it needs; only the digest itself
    is made in order, from pieces.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if k != key or size >= PIECE:
                    if held:
                        out.append((key, first, ",".join(held)))
                    key, first, held, size = k, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _rows(out)
        if held:
            yield _rows([(key, first, ",".join(held))])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": k, "first": f, "ids": i} for k, f, i in out], pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        out.append({"key": key, "ends_sha256": sha.hexdigest()})
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": sha.hexdigest()}], schema)

    ranged = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = stored(ranged.mapInArrow(pieces, "key string, first long, ids string"), "pieces")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, ends_sha256 string")


def prefix_nodes(turns: DataFrame, convs: DataFrame | None = None, block: int = BLOCK, hot_rows: int | None = None) -> DataFrame:
    """A row for each node of the trie of the conversations of ``turns`` (rows of ``digests``): each distinct sequence of
    first turns, from the root of none.

    conv_id is the smallest member, n_convs the number of members (conversations that begin with the sequence), parent_conv_id
    the parent's conv_id (null for the root), n_children the number of its children, n_leaves the number of childless nodes
    in its subtree (itself included), saved_tokens the sum over its subtree of (n_convs - 1) times the bytes of the last
    text, ends_sha256 the digest of the members that end there. ``convs`` (conv_id) names conversations that may have no
    turns. Turns go by turn, null first, ties by digest; repeated rows are turns like all others. No conversations: no rows.
    A conversation of any length and a prefix of any number of members are spread over tasks.
    """
    blocks = _blocks(turns, block, hot_rows)
    everyone = turns.select("conv_id")
    everyone = (everyone if convs is None else everyone.unionByName(convs.select("conv_id").where("conv_id IS NOT NULL"))).distinct()
    zero = F.lit(0).cast("long")
    root_key = _key(zero, [zero] * len(LANES))

    grouped = blocks.groupBy("start", "whole").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.max("block").alias("block"))
    grouped = stored(grouped, "grouped")
    forks = stored(grouped.groupBy("start").agg(F.count("*").alias("n")).where("n > 1").select("start", F.lit(True).alias("fork")), "forks")
    told = grouped.join(forks, "start", "left").withColumn("fork", F.coalesce("fork", F.lit(False)))
    # one conversation stands for all that agree up to the end of the block
    bodies = blocks.select(F.col("conv_id").alias("rep"), "block", "turns", *[f"before_{c}" for c in LANES])
    inner = stored(_turns_of(told.join(bodies, ["rep", "block"]).withColumnRenamed("rep", "conv_id")), "inner")

    shape = ("key", "parent", "depth", "n_bytes")
    straight = inner.where("NOT fork").select(*shape, "n_convs", "conv_id")
    split = inner.where("fork").groupBy(*shape).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = everyone.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(root_key.alias("key"), F.lit(None).cast("string").alias("parent"), zero.alias("depth"), zero.alias("n_bytes"), "n_convs", "conv_id")
    nodes = stored(straight.unionByName(split).unionByName(root), "nodes")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", zero)).join(above, "parent", "left")
    saving = (F.col("n_convs") - 1) * F.col("n_bytes")
    tree = stored(tree.withColumn("saving", saving), "tree")

    # what each conversation owns, summed over the members of every shared node
    owned = stored(tree.groupBy("conv_id").agg(F.sum("saving").alias("savings"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")), "owned")
    shared = told.where("n_convs > 1 OR fork").select("start", "whole")
    members = blocks.select("conv_id", "start", "whole").join(shared, ["start", "whole"], "left_semi").join(owned, "conv_id")
    of_block = members.groupBy("start", "whole").agg(F.sum("savings").alias("savings"), F.sum("leaves").alias("leaves"))
    of_node = inner.select("start", "whole", "key").join(of_block, ["start", "whole"]).groupBy("key").agg(F.sum("savings").alias("savings"), F.sum("leaves").alias("leaves"))
    of_root = owned.agg(F.sum("savings").alias("savings"), F.sum("leaves").alias("leaves")).select(root_key.alias("key"), "savings", "leaves")
    sums = stored(of_node.unionByName(of_root), "sums")
    common = running_sums(tree.where("n_convs > 1").select("key", "conv_id", "depth", "saving"), ["conv_id"], [F.col("depth")], {"higher": F.col("saving")}, include_current=False, hot_rows=hot_rows)
    totals = common.join(sums, "key").select("key", (F.col("savings") - F.col("higher")).alias("saved_tokens"), F.col("leaves").alias("n_leaves"))

    last = blocks.groupBy("conv_id").agg(F.max_by("whole", "block").alias("key"))
    ends = stored(everyone.join(last, "conv_id", "left").select(F.coalesce("key", root_key).alias("key"), "conv_id"), "ends")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = tree.join(totals, "key", "left").join(ids_digests(ends), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))

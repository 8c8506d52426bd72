r"""Conversations as prefix trees of formatted turns.

A turn is written ``### role: text </turn>`` and a line end; in roles and texts a backslash goes before every
backslash, ``#``, ``<`` and (in roles) ``:`` that could be read as a mark, so that the text can be read back exactly.
Conversations that begin with the same turns share those nodes of a tree, one tree a first turn. The nodes are emitted
depth first, each with its tokens once, the position id of its first token (the number of tokens before it in the
conversation), the place of its first token in the tree's stream, and the intervals of the stream that hold its
ancestors, which its tokens may attend to beside their own node's earlier ones.

A node is named by a hash over all its turns. The depth-first order needs no walk over the tree: conversations sorted
by their list of node names are in that order, a node belongs to the first conversation that passes it, and the nodes
that one conversation owns follow each other in depth and in the stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded_batches, stored, text_of

LOSS_ROLES = ("assistant",)
#: fixed values of the template
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)

WALK = "key string, conv_id long, depth long, node string, root string, position long, n long, loss_from long, loss_to long, tokens array<int>"
NODES = "tree string, node string, depth long, start long, position long, n long, loss_from long, loss_to long, ancestors array<struct<from:long,to:long>>, tokens array<int>"


class Trees(NamedTuple):
    """nodes: as ``NODES``, a row a node; members: conv_id, key, depth, node for every turn."""

    nodes: DataFrame
    members: DataFrame


def escaped(text: str, marks: str = r"[\\#<]") -> str:
    return re.sub(f"({marks})", r"\\\1", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def byte_tokenizer(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks; kept on the tiktoken module, which lives as long as the worker."""
    import base64

    import tiktoken

    kept = tiktoken.__dict__.setdefault("_rank_files", {})
    if path not in kept:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def _walk(turns: DataFrame, path: str, pattern: str, loss_roles: tuple[str, ...]) -> DataFrame:
    """Every turn with its node and tokens: rows come by conversation and in order, and only the last one is held."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(path, pattern).encode_ordinary
        key, depth, name, root, position = None, 0, b"", "", 0
        schema = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.string()), ("root", pa.string()), ("position", pa.int64()), ("n", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("tokens", pa.list_(pa.int32()))])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    key, depth, name, position = r["key"], 0, b"", 0
                role, text = r["role"], r["text"]
                name = hashlib.blake2b(b"\0".join([name, str(len(role)).encode(), role.encode(), text.encode()]), digest_size=16).digest()
                if depth == 0:
                    root = name.hex()
                head, body, tail = (encode(x) for x in (OPEN + escaped(role, r"[\\#<:]") + MIDDLE, escaped(text), CLOSE))
                n = len(head) + len(body) + len(tail)
                loss = (len(head), len(head) + len(body)) if role in loss_roles else (0, 0)
                rows.append((key, r["conv_id"], depth, name.hex(), root, position, n, *loss, head + body + tail))
                depth += 1
                position += n
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    keyed = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("key"), "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    return keyed.repartition("key").sortWithinPartitions("key", "turn", "role", "text").mapInArrow(walk, WALK)


def prefix_trees(turns: DataFrame, tokenizer: str, pattern: str, loss_roles: tuple[str, ...] = LOSS_ROLES) -> Trees:
    """Prefix trees of all conversations of ``turns`` (conv_id, turn, role, text).

    Turns go by turn (null first), then role and text, so that ties and repeated rows have one order; all of them are
    kept. Null texts and roles are empty. Rows whose conv_id is null are one conversation. Other columns are not
    carried. An empty table gives no trees. A conversation is read in order by one task, which holds one turn at a time.
    """
    walk = stored(_walk(bounded_batches(turns), tokenizer, pattern, loss_roles), "turns")
    # where each conversation ends, and the names on its way; equal conversations are one
    ways = walk.groupBy("key").agg(F.max_by("node", "depth").alias("end"), F.first("root").alias("root"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]), "").alias("way"))
    ways = stored(ways, "ways")
    ends = ways.groupBy("end").agg(F.min("key").alias("key"), F.min("root").alias("root"), F.min("way").alias("way"))
    # the ids ascend with the sort, and their upper part is the sort's partition
    ends = stored(ends.orderBy("root", "way").select("end", "key", "root", F.monotonically_increasing_id().alias("rank")), "ends")
    ranks = ways.select("key", "end").join(ends.select("end", "rank"), "end").select("key", "rank")
    owner = walk.select("key", "node").join(ranks, "key").groupBy("node").agg(F.min("rank").alias("owner"))

    paths = walk.join(ends.select("key", "rank"), "key")
    slim = paths.select("node", "rank", "root", "position", "n").join(owner, "node").where(F.col("owner") == F.col("rank"))
    owned = slim.groupBy("rank").agg(F.first("root").alias("root"), F.sum("n").alias("total"), F.min("position").alias("shift"))
    chunk = F.shiftright("rank", 33)
    inside = Window.partitionBy("root", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("root").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    owned = stored(owned.withColumn("chunk", chunk), "owned")
    chunks = owned.groupBy("root", "chunk").agg(F.sum("total").alias("sum")).withColumn("ahead", F.coalesce(F.sum("sum").over(across), F.lit(0))).drop("sum")
    begins = owned.withColumn("before", F.coalesce(F.sum("total").over(inside), F.lit(0))).join(chunks, ["root", "chunk"]).select(F.col("rank").alias("owner"), (F.col("ahead") + F.col("before") - F.col("shift")).alias("base"))
    # a node starts at its owner's base and its own position
    places = stored(owner.join(begins, "owner").select("node", "owner", "base"), "places")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, held = None, []
        schema = pa.schema([("tree", pa.string()), ("node", pa.string()), ("depth", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("n", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("ancestors", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("tokens", pa.list_(pa.int32()))])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["rank"] != rank:
                    rank, held = r["rank"], []
                start = r["base"] + r["position"]
                if r["owner"] == rank:
                    rows.append({k: r[k] for k in ("node", "depth", "position", "n", "loss_from", "loss_to", "tokens")} | {"tree": r["root"], "start": start, "ancestors": [{"from": a, "to": b} for a, b in held]})
                if held and held[-1][1] == start:
                    held[-1] = (held[-1][0], start + r["n"])
                else:
                    held.append((start, start + r["n"]))
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = paths.join(places, "node").select("rank", "owner", "base", "root", "node", "depth", "position", "n", "loss_from", "loss_to", F.when(F.col("owner") == F.col("rank"), F.col("tokens")).alias("tokens"))
    nodes = rows.repartition("rank").sortWithinPartitions("rank", "depth").mapInArrow(intervals, NODES)
    return Trees(stored(nodes, "nodes"), walk.select("conv_id", "key", "depth", "node"))


def read_back(trees: Trees, tokenizer: str, pattern: str) -> DataFrame:
    """Every conversation from the trees' tokens: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_tokenizer(tokenizer, pattern).decode_bytes
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state: dict = {}

        def row() -> dict:
            return {k: state[k].hexdigest() if k.endswith("sha256") else state[k] for k in schema.names}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != state.get("key"):
                    if state:
                        out.append(row())
                    state = {"key": r["key"], "conv_id": r["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                formatted = decode(r["tokens"]).decode()
                state["formatted_chars"] += len(formatted)
                for role, text in turns_of(formatted):
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{text}\n".encode())
                loss = unescaped(decode(r["tokens"][r["loss_from"] : r["loss_to"]]).decode())
                state["loss_chars"] += len(loss)
                state["loss_sha256"].update(loss.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema)

    rows = trees.members.join(trees.nodes.select("node", "tokens", "loss_from", "loss_to"), "node")
    rows = rows.select("key", "conv_id", "depth", "tokens", "loss_from", "loss_to").repartition("key").sortWithinPartitions("key", "depth")
    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

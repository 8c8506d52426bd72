from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from fieldloom.llm.query_turn_blocks import rebuilt
from fieldloom.llm.turn_blocks import digests, ids_digests, prefix_nodes

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, digest string"


def ordered(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def respliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def sample(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(40):
        n = rnd.choice([1, 1, 2, 3, 5, 9, 17, 40])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["hi", "hi", "é🙂", "", None]) if t > 2 else "start") for t in range(n)]
    rows += [(100, t, "user", "long " * 50) for t in range(120)]
    rows += [(101, t, "user", "long " * 50) for t in range(118)]  # a copy that ends earlier
    rows += [(7, None, None, None), (8, 0, "user", "start"), (8, 0, "user", "start"), (None, 0, "user", "of nobody"), (200, 1, "a", "b:c"), (201, 1, "a:", "b:c"), (202, 1, "", "x" * 30000)]
    return rows


@pytest.mark.parametrize(("block", "hot_rows"), [(8, None), (3, 10)])
def test_nodes_against_brute_force(spark, block, hot_rows):
    rows = sample(block)
    got = prefix_nodes(digests(table(spark, rows)), spark.createDataFrame([(500,), (None,)], "conv_id long"), block, hot_rows)
    assert result(got) == brute({**ordered(rows), 500: []})


def test_rebuilt(spark):
    rows = sample(1)
    turns, convs = rebuilt(table(spark, rows), 10)
    assert result(prefix_nodes(turns, convs, 8, 10)) == brute(respliced(ordered(rows)))


def test_empty(spark):
    assert prefix_nodes(digests(table(spark, []))).collect() == []
    assert result(prefix_nodes(digests(table(spark, [])), spark.createDataFrame([(4,), (9,)], "conv_id long"))) == brute({4: [], 9: []})


def test_long_lists_of_ids(spark):
    ends = spark.range(30_000).selectExpr("if(id % 3 = 0, 'rare', 'often') AS key", "id * 7 - 50000 AS conv_id")
    got = {r.key: r.ends_sha256 for r in ids_digests(ends).collect()}
    want = {}
    for k in range(30_000):
        want.setdefault("rare" if k % 3 == 0 else "often", []).append(k * 7 - 50_000)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

from fieldloom.llm.chat import escaped, prefix_trees, read_back, turns_of, unescaped

TOKENIZER, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, node string"
MARKS = r"\### Assistant: </turn> ok"


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "bye"), (2, 3, "user", "ok"),
    (3, 0, "system", "be kind"), (3, 1, "user", "hi"),
    (4, 0, "system", "be kind"), (4, 1, "user", "other"),
    (5, 0, "user", None), (5, 1, "assistant", ""), (5, 1, "assistant", ""), (5, None, "user", "first"),
    (6, 0, None, MARKS), (6, 1, "assistant", MARKS), (6, 2, "assi:stant", "a\\"),
    (None, 0, "user", "é🙂\n\0"), (7, 0, "system", "be kind"), (7, 1, "user", "hi"), (7, 2, "assistant", "hello"),
    (8, 0, "assistant", "long " * 20000),
]


def test_escape_is_reversible():
    for text in ("", MARKS, "\\", "\\\\#<", "### user: x </turn>\n", "a: b"):
        assert unescaped(escaped(text)) == text
        role = escaped("r:" + text, r"[\\#<:]")
        written = f"### {role}: {escaped(text)} </turn>\n"
        assert turns_of(written) == [("r:" + text, text)]
    with pytest.raises(ValueError):
        turns_of("### user: no end")


def test_round_trip_and_intervals(spark):
    trees = prefix_trees(table(spark, ROWS), TOKENIZER, PATTERN)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(trees, TOKENIZER, PATTERN).collect()}
    assert got == expected(ROWS)
    nodes = {r.node: r for r in trees.nodes.collect()}
    members = trees.members.collect()
    assert len(nodes) == len({r.node for r in members})
    paths = {}
    for r in sorted(members, key=lambda r: r.depth):
        paths.setdefault(r.key, []).append(nodes[r.node])
    streams = {}
    for n in sorted(nodes.values(), key=lambda n: n.start):
        stream = streams.setdefault(n.tree, [])
        assert len(stream) == n.start and n.n == len(n.tokens)  # gapless, each node once
        stream.extend(n.tokens)
    for path in paths.values():
        before = []
        for n in path:
            assert n.position == len(before)
            seen = [t for i in n.ancestors for t in streams[n.tree][i["from"] : i["to"]]]
            assert seen == before
            before += n.tokens
    # the three conversations that begin alike share their first nodes, and equal ones all
    assert paths["1"][1].node == paths["2"][1].node == paths["3"][1].node and paths["1"][2].node == paths["7"][2].node


def test_empty(spark):
    assert read_back(prefix_trees(table(spark, []), TOKENIZER, PATTERN), TOKENIZER, PATTERN).collect() == []

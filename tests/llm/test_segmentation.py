from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from fieldloom.llm.segmentation import _by_stop, decode, encode, lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world ▁x", "", None, "ab\ncd é漢字🙂 \0 end ", "naïve café" + " " * 70 + "z" * 130, "▁▁ ▁", "x" * 50_000, "Same text", "Same text"]


def test_round_trip_and_reproducible(spark):
    rows = [(k // 2 if k < 8 else 3, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "no key", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    first = encode(docs, MODEL)
    back = decode(first, MODEL).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((d, t or "") for d, t, _ in rows if d is not None)
    again = {(r.doc_id, tuple(r.ids)) for r in encode(docs.repartition(7), MODEL).collect()}
    assert again == {(r.doc_id, tuple(r.ids)) for r in first.collect()}
    assert {tuple(r.ids) for r in first.collect() if r.doc_id == 3 and len(r.ids) < 100} != set()
    assert again != {(r.doc_id, tuple(r.ids)) for r in encode(docs, MODEL, seed=1).collect()}
    assert encode(docs.limit(0), MODEL).collect() == []


def test_samples_follow_the_lattice():
    pieces, word, n = lattice(MODEL, 1.0), "other", 40_000
    ids, many = pieces.block(pa.array([word] * n), np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64))
    ends = np.cumsum(many)
    got = Counter(tuple(ids[b - a : b].tolist()) for a, b in zip(many, ends))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    exact = {}
    for mask in range(2 ** (len(word) - 1)):
        cut = [0, *[k + 1 for k in range(len(word) - 1) if mask >> k & 1], len(word)]
        parts = [word[a:b] for a, b in zip(cut, cut[1:])]
        found = [sp.piece_to_id(p) for p in parts]
        if all(sp.id_to_piece(i) == p for i, p in zip(found, parts)):
            exact[tuple(found)] = math.exp(sum(pieces.weight[i] for i in found))
    total = sum(exact.values())
    assert set(got) <= set(exact) and all(abs(got[k] / n - v / total) < 0.01 for k, v in exact.items())


def test_long_segments_follow_the_lattice():
    pieces, n = lattice(MODEL, 1.0), 1500
    edges = lambda text: pieces.edges(np.frombuffer(text.encode("utf-32-le"), "<u4"), np.full(len(text), len(text)))
    for text in ("other" * 24, "www.example.org/another/path?key=value&more=" * 3, "www.example.org/another/path?key=value&more=" * 8):
        # how likely a piece is to run over each place, by sums from both ends in plain loops
        found = list(zip(*(x.tolist() for x in edges(text)), strict=True))
        front, back = [0.0] + [-math.inf] * len(text), [-math.inf] * len(text) + [0.0]
        for a, b, _, w in sorted(found, key=lambda x: x[1]):
            front[b] = np.logaddexp(front[b], front[a] + w)
        for a, b, _, w in sorted(found, key=lambda x: -x[0]):
            back[a] = np.logaddexp(back[a], back[b] + w)
        want = np.zeros(len(text) + 1)
        for a, b, _, w in found:
            want[a + 1 : b] += math.exp(front[a] + w + back[b] - front[-1])
        ids, many = pieces.block(pa.array([text] * n), np.random.default_rng(2).integers(0, 2**63, n).astype(np.uint64))
        assert set(ids.tolist()) <= {p for _, _, p, _ in found}
        ends = np.cumsum(pieces.raw_sizes[ids])
        crossed = n - np.bincount(np.concatenate([[0], ends]) % len(text), minlength=len(text))[1:]
        assert len(ends) == many.sum() and want[48::48].max() > 0.05
        assert np.abs(crossed / n - want[1 : len(text)]).max() < 0.08


def test_windows_do_not_change_a_draw():
    pieces = lattice(MODEL, 1.0)
    cps = np.frombuffer(("https://example.org/漢字/x🙂\n\t" * 30 + "z" * 400).encode("utf-32-le"), "<u4")
    for key in range(20):
        seed = np.array([key * 7919], np.uint64)
        whole, alone = pieces._alone(cps, seed), pieces._alone(cps, seed, 37)
        segment, steps, ids, letters = pieces._together(cps[:250], np.array([250]), seed)
        short = pieces._alone(cps[:250], seed)
        assert all((a == b).all() for a, b in zip(whole, alone)) and (short[0] == ids).all() and (short[1] == letters).all()


def test_edges_are_looked_up_and_ordered_without_searching_or_sorting():
    pieces, rng = lattice(MODEL, 1.0), np.random.default_rng(3)
    keys = pieces.keys[:-1]
    asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 2**64 - 2, 2**64 - 1], np.uint64)])
    assert (pieces._looked_up(asked) == np.searchsorted(keys, asked)).all()
    stop = np.concatenate([np.sort(rng.choice(np.arange(1, 400), n, replace=False)) for n in (300, 120, 1, 7)])
    assert (_by_stop(stop, 401) == np.argsort(stop, kind="stable")).all()

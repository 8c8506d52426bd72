from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from fieldloom.llm import alignment
from fieldloom.llm.alignment import align, grouped, overlaps
from fieldloom.llm.bpe_trie import TrieEncoder, byte_of_char
from tests.conftest import DATA

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def who():
    return alignment.Aligner(BYTES, PIECES)


def brute(libraries, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every row, text by text and pair by pair."""
    a, b = libraries
    byte = byte_of_char()
    names = {i: t for t, i in a.get_vocab().items()}
    found = []
    for doc_id, text in rows:
        text = text or ""
        ea = a.encode(" " + text, add_special_tokens=False).ids if text else []
        eb = b.encode(text) if text else []
        ta = [bytes(byte[c] for c in names[i]) for i in ea]
        tb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        groups, links, i, j, x, y, left, right = [], [], 0, 0, 0, 0, [], []
        while i < len(ea) or j < len(eb):
            if x <= y:
                left.append(ea[i])
                x += len(ta[i])
                i += 1
            else:
                right.append(eb[j])
                y += len(tb[j])
                j += 1
            if x == y:
                groups.append((left, right))
                left, right = [], []
        spans_a, spans_b = np.cumsum([0, *map(len, ta)]), np.cumsum([0, *map(len, tb)])
        k = 0
        for i in range(len(ea)):
            while spans_b[k + 1] <= spans_a[i]:
                k += 1
            m = k
            while m < len(eb) and spans_b[m] < spans_a[i + 1]:
                links.append((ea[i], eb[m]))
                m += 1
        found.append((doc_id, ea, eb, groups, links))
    held = Counter(p for *_, links in found for p in set(links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, ea, eb, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(ea), len(eb), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    None, "", " ", "  ", "a", " a", "a  b", "a   b \n c", "trailing  ", "\n", "\t\tx", "▁", "a▁b", "<s> </s> <unk> <0x0A>", "<|endoftext|> x", "日本語 テキスト", "🙂🙂 é́", "\x00\x01 \x7f",
    "same words here", "same words here", "words here same", "=" * 300, "x" * 700, "word " * 3000, "a\xa0b　c   d", "ﬁ ﬂ ½ Ⅷ",
]


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_against_brute_force(spark, libraries):
    rows = [(k % 20 if k else None, t) for k, t in enumerate(HARD)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, place string").withColumnRenamed("place", "block")
    assert result(align(docs, BYTES, PIECES)) == sorted(brute(libraries, rows), key=repr)
    assert align(docs.limit(0), BYTES, PIECES).collect() == []


def test_many_blocks(spark, libraries, who, tables, monkeypatch):
    rows = [(r.doc_id, r.text) for r in tables.documents.select("doc_id", "text").collect()]
    want = sorted(brute(libraries, rows), key=repr)
    assert result(entry_module.queries()["op11_alignment"](spark, DATA)) == want
    monkeypatch.setattr(alignment, "aligner", lambda *_: who)
    monkeypatch.setattr(alignment, "PART", 1 << 12)
    monkeypatch.setattr(alignment, "BLOCK", 1 << 14)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    batch = tables.documents.select("doc_id", "text").na.fill("").toArrow().to_batches()
    made = [b for b in alignment._aligned(iter(batch), BYTES, PIECES)]
    held = Counter()
    for b in made:
        for r in b.to_pylist():
            if r["pair"] is not None:
                held[r["pair"]] += r["held"]
    assert len({r["block"] for b in made for r in b.to_pylist()}) > 5
    top = {}
    for p, n in held.items():
        top[p >> 32] = max(top.get(p >> 32, 0), n)
    scored = []
    for b in made:
        scored.append(b.append_column("total", pa.array([held.get(p) for p in b.column("pair").to_pylist()], pa.int64())).append_column("best", pa.array([None if p is None else int(held[p] == top[p >> 32]) for p in b.column("pair").to_pylist()], pa.int64())))
    got = [tuple(r[c] for c in NAMES) for b in alignment._scored(iter(scored)) for r in b.to_pylist()]
    assert sorted(got, key=repr) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), min_size=1, max_size=30))
def test_groups_and_overlaps(a, b):
    a, b = list(a), list(b)
    short = sum(b) - sum(a)
    (a if short > 0 else b).extend([1] * abs(short))
    ae, be = np.cumsum(a), np.cumsum(b)
    ga, gb = grouped(ae, be)
    cuts = np.array(sorted(set(ae.tolist()) & set(be.tolist())))
    assert ga.tolist() == np.searchsorted(cuts, ae).tolist() and gb.tolist() == np.searchsorted(cuts, be).tolist()
    left, right = overlaps(ae, be)
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ae[i] - a[i], be[j] - b[j]) < min(ae[i], be[j])]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'st=0é日▁.,"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_chunks_encode_as_the_whole(libraries, who, texts):
    a, b = libraries
    names, places, bounds = alignment.chunks(pa.array(texts, pa.string()), led=True)
    pieces, (ids, edges) = who._pieces(names), who.a.chunk_ids(names)
    for k, text in enumerate(texts):
        at = places[bounds[k] : bounds[k + 1]]
        if text:
            assert [i for p in at for i in ids[edges[p] : edges[p + 1]].tolist()] == a.encode(" " + text, add_special_tokens=False).ids
        if text and "▁" not in text:
            assert [i for p in at for i in pieces[p]] == b.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=3), st.text("ab", max_size=3)), max_size=12))
def test_same_bytes(pairs):
    sides = [alignment.pooled([p[k].encode() for p in pairs]) for k in (0, 1)]
    assert alignment.same_bytes(sides[0][0], sides[0][2], sides[1][0], sides[1][2]).tolist() == [a == b for a, b in pairs]


def test_chunks_are_remembered_once_and_pairs_of_tokens_outlive_words():
    names, a = [" hello", " hello,", " x1y", ",", " 日本"], TrieEncoder(BYTES)
    ids, edges = a.ids_of(names)
    assert a.chunks == {"": 0} and " hello" in a.known  # the aligner remembers chunks, the encoder their words
    pairs = dict(a.together)
    a.forget()
    assert not a.known and pairs and a.together == pairs
    again, at = a.chunk_ids(names)
    assert again.tolist() == ids.tolist() and at.tolist() == edges.tolist()
    assert [x.tolist() for x in a.ids_of([])] == [[], [0]]

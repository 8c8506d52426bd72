from __future__ import annotations

import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from fieldloom.llm.bpe_trie import TokenBytes, TrieEncoder, decode, encode
from fieldloom.llm.chunks import chunks
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "a  b", "a \n  b", " a", "a ", "a\n ", "x" * 300, "=" * 400, "it's we'll 'd I'VE", "<|endoftext|>", "ß<|endoftext|> <|endoftext|>x<|endoftext|>",
    "<|endo", "  <|endoftext|>  ", "日本語テキスト 漢字", "🙂🙂 é́ ‍", "\x1c \x1d a \x85 b", "tab\t\tx \t y", "0123 456 ½", "a᠎ ​ b", "՘a ࢏1 \U000323af", "\x00\x01",
    "a" * 5000 + " " * 5000 + "\n" * 300 + "b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return TrieEncoder(PATH)


@pytest.fixture(scope="module")
def table():
    return TokenBytes(PATH)


def ids_of(coder, texts):
    ids, sizes = coder.block(pa.array(texts, pa.string()))
    out, at = [], 0
    for n in sizes.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    assert at == len(ids)
    return out


def test_hard_texts(coder, library):
    assert ids_of(coder, HARD) == [e.ids for e in library.encode_batch(HARD, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'st=0é日▁ "), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text(coder, table, library, texts):
    got = ids_of(coder, texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for ids, text in zip(got, texts, strict=True):
        assert table.text(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False) == text


def test_every_node_of_the_trie_is_met_once(coder):
    words = sorted({"prefix", "prefixes", "prefixing", "pre", "zebra"})
    coder.forget()
    met = []
    moves = coder.moves

    class Counting(dict):
        def get(self, key, default=None):
            met.append(key)
            return moves.get(key, default)

    coder.moves = Counting(moves)
    coder.walk(words)
    coder.forget()
    assert len(met) == len({w[: k + 1] for w in words for k in range(len(w))})


def test_chunks_hold_the_text():
    texts = ["a b", "", " ", "a  b \n c ", "\n a"]
    for led in (False, True):
        names, places, bounds = chunks(pa.array(texts), led)
        joined = ["".join(names[p] for p in places[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert joined == [(" " if led else "") + t if led else t for t in texts]


def test_ids_beyond_the_table_stand_for_nothing(coder, table):
    assert table.text(np.array([64, 4_000_000_000, 65], np.uint32)) == "ab"
    half = next(i for i, b in coder.bytes.items() if b == b"\xc3")
    assert table.text(np.array([half, 64], np.uint32)) == "\ufffda"


def test_rows(spark, library):
    rows = [(1, "one two", "x"), (1, "one two", "y"), (None, None, "z"), (2, "", "z"), (3, "long " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "n_tokens")
    got = decode(encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == sorted((d or 0, len(library.encode(t or "", add_special_tokens=False).ids), t or "") for d, t, _ in rows)
    assert encode(docs.limit(0), PATH).collect() == []


def test_query_equals_the_library(spark, library, tables):
    want = []
    for r in tables.documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = entry_module.queries()["op12_bpe_trie"](spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)

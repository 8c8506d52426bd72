from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import packing
from fieldloom.llm.packing import CAPACITY, GAP, UNIT, bins, linear_program, pack, patterns_for, placed, price, room_of
from fieldloom.llm.wordpieces import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), WordEncoder(PATH)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 300), max_size=20))
def test_patterns_hold_everything(histogram):
    plan = patterns_for(histogram, 32)
    held = dict.fromkeys(histogram, 0)
    for pattern, times in plan:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= 32
        for s, n in pattern.items():
            held[s] += n * times
    assert held == histogram
    if histogram:  # no fewer than the linear program's optimum, and no more than one for each size beyond it
        sizes = np.array(sorted(histogram))
        _, use = linear_program(sizes, np.array([histogram[s] for s in sizes]), 32, gap=1e-9)
        assert use.sum() - 1e-6 <= sum(t for _, t in plan) <= use.sum() * (1 + GAP) + len(histogram) + 1


def test_linear_program_finds_the_optimum():
    sizes, demand = np.array([3, 5, 8]), np.array([40, 40, 40])
    basis, use = linear_program(sizes, demand, 16, gap=1e-9)
    assert np.allclose(basis @ use, demand) and use.sum() == pytest.approx(40.0)


def test_few_patterns_are_priced(monkeypatch):
    lengths = np.minimum(np.exp(np.random.default_rng(1).normal(5.5, 1.1, 40000)).astype(int) + 1, CAPACITY)
    steps = np.array([next(step for longest, step in bins(CAPACITY, UNIT) if x <= longest) for x in lengths.tolist()])
    sizes, counts = np.unique(np.minimum(-(-lengths // steps) * steps, CAPACITY), return_counts=True)
    calls = []
    monkeypatch.setattr(packing, "price", lambda *a: calls.append(1) or price(*a))
    plan = patterns_for(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), CAPACITY)
    assert len(sizes) > 190 and len(calls) <= 50  # thousands from single sizes on
    assert sum(times for _, times in plan) <= 1.01 * (sizes @ counts) / CAPACITY + 1


WORDS = ["Haus", "maison.", "ERE***", "x$$$", "d'été", "don't", "it's'", "it's's", "İx", "ŉa", "K", "e\u0301t\u0301", "ΑΣ.", "\u0958", "漢字!", "12.5", "a1b", "(b)", "#", "'", "ǅ", "ſ", "ß,'", "x\u0338", "=\u0338", "a\x1cb", "a\xa0b", "\u0345", "Ⱥ"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS) | st.text(max_size=5), max_size=30).map(" ".join), max_size=6))
def test_words_encode_as_the_text(texts):
    ids, counts = ENCODER.block(pa.array(texts, pa.string()))
    whole = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


def test_marks_behind_letters_are_words_of_their_own():
    who = WordEncoder(PATH)
    who.block(pa.array(["Haus*** ende*** haus$$$ ende"]))
    assert set(who.rows) == {"", "haus", "ende", "***", "$$$"}


def check(docs, rows, tokenizer, capacity):
    ids = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for d, t in docs]
    pool, seqs = {}, {}
    for d, v in ids:
        for a in range(0, len(v), capacity):
            pool.setdefault((d, a, len(v)), []).append(v[a : a + capacity].tobytes())
    for r in rows:
        pool[r.doc_id, r.start, r.doc_tokens].remove(bytes(r.ids))
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(pool.values())
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_pack(spark, tables):
    rng = random.Random(2)
    docs = [(r.doc_id, r.text) for r in tables.documents.limit(60).collect()]
    docs += [(1000, None), (1001, ""), (None, "no id"), (1002, "<|endoftext|> a <|STARTOFTEXT|>"), (1003, "İstanbul's ΑΣ don't x y 12.5,"), (1003, "other"), (1004, "w" * 30000), (1005, "same"), (1005, "same"), (1006, " \n\t ")]
    docs += [(2000 + k, " ".join(rng.choices(["Haus.", "maison,", "x1", "état", "über", "..."], k=rng.randrange(400)))) for k in range(60)]
    table = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, length int")
    sequences = check(docs, pack(table, PATH, capacity=256, unit=2).collect(), Tokenizer.from_file(PATH), 256)
    total = sum(len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sequences <= 1.06 * total / 256 + 2
    assert pack(table.limit(0), PATH).collect() == []


@pytest.mark.parametrize("length", [1, 2, 9, 33, 67, 130])
def test_short_pieces_leave_little_padding(spark, length):
    pieces = spark.range(40960).select(F.col("id").alias("piece_id"), F.lit(length).alias("length"))
    n = placed(pieces).select("sequence_id").distinct().count()
    assert length * 40960 / (n * CAPACITY) >= (0.97 if length <= 32 else 0.93)


@pytest.mark.parametrize("capacity, unit", [(CAPACITY, UNIT), (256, 2), (100, 8), (7, 1)])
def test_bins_have_room(spark, capacity, unit):
    got = spark.range(1, capacity + 1).select("id", room_of(F.col("id"), capacity, unit).alias("room")).collect()
    assert all(r.id <= r.room <= min(capacity, r.id * 19 / 18 + 1) for r in got) and bins(capacity, unit)[-1][0] == capacity
    assert all(r.room == r.id for r in got if r.id <= 4 * unit)

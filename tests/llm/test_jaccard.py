from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from fieldloom.llm import jaccard
from fieldloom.llm.jaccard import bounded, near_duplicates, one_of_each
from fieldloom.llm.shingles import shingle_sets


def word_sets(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def brute(docs, percent=75):
    sets = [word_sets(t) for _, t in docs]
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    out = []
    for k, (i, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if comp[j] == comp[k] and docs[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids and sets[k] else i))
    return sorted(out, key=repr)


def corpus(seed=3):
    """Chains of edited copies, a passage that many share, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6)))
    passage = [word() for _ in range(60)]
    docs, base = [], [word() for _ in range(120)]
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = word()
        docs.append((k, " ".join(copy)))
        if k % 10 == 9:
            base = copy
    docs += [(100 + k, " ".join([word() for _ in range(rng.randrange(5, 40))] + passage + [word()])) for k in range(60)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE\ttwo "), (205, "one two three"), (206, "a b c d e"), (207, "a b c d e"), (207, "a b c d e"), (None, "a b c d e"), (208, "É b c d e f"), (209, "é b c d e f"), (210, "x " * 30000)]
    return docs


@pytest.mark.parametrize("block,tiled", [(0, 0), (0, 1 << 14), (1 << 12, 1 << 14)])
def test_classes_as_brute_force(spark, block, tiled):
    docs = corpus()
    table = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, id int, region string")
    got = near_duplicates(table, block=block, tiled=tiled)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(docs)


def test_bounds_hold_and_only_compared_sets_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # few different upper halves, so that many anchors share one
    base = rng.integers(0, 40, 60, dtype=np.int64) << 32 | rng.integers(0, 1 << 32, 60)
    sets = {k: np.unique(np.concatenate([rng.choice(base, int(rng.integers(20, 60)), replace=False), rng.integers(0, 40, 8) << 32])) for k in range(12)}
    anchored = {k: v[: len(v) - (75 * len(v) + 99) // 100 + 1] for k, v in sets.items()}
    table = spark.createDataFrame([(k, len(v), anchored[k].tolist()) for k, v in sets.items()] + [(k, 4, [1, 2]) for k in range(100, 400)], "id long, n int, anchors array<long>")
    pairs = spark.createDataFrame([(x, y) for x in sets for y in range(x)], "x long, y long")
    sent, sieve = [], jaccard.sieved
    monkeypatch.setattr(jaccard, "sieved", lambda *a: sent.append(sieve(*a)) or sent[-1])
    rows = bounded(pairs, table, 75).collect()
    assert len(rows) == 66 and sent[0].count() < 50  # 312 without the sieve
    for r in rows:
        both, either = (len(f(sets[r.x], sets[r.y])) for f in (np.intersect1d, np.union1d))
        assert r.low <= 1 - both / either + 1e-12 and (r.open or 100 * both < 75 * either)


def test_one_of_each_class_stays(spark):
    docs = corpus()
    table = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, id int, region string")
    out = one_of_each(table)
    assert out.columns == table.columns
    want = {c for i, n, c in brute(docs) if n} | {i for i, n, _ in brute(docs) if not n}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert near_duplicates(table.limit(0)).collect() == [] and one_of_each(table.limit(0)).collect() == []


def test_classes_stay_apart_where_ids_are_null_or_repeated(spark):
    docs = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (None, "m n o p q r"), (None, "m n o p q r"), (4, "m n o p q r")]
    docs += [(5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (5, "seven eight nine ten eleven twelve"), (6, "ONE two three four five six")]
    docs += [(None, ""), (None, None), (5, " ")]
    linked = " ".join(f"w{k}" for k in range(60))
    for more in ([], [(None, linked), (None, linked + " tail"), (7, linked + " other"), (7, "alone among all these texts")]):
        table = spark.createDataFrame([(*d, 1) for d in docs + more], "doc_id long, text string, id int")
        want = [(None, "a b c d e f"), (None, "g h i j k l"), (4, "m n o p q r"), (5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (None, ""), (None, None), (5, " ")]
        want += [(7, linked + " other"), (7, "alone among all these texts")] if more else []
        out = one_of_each(table)
        assert out.columns == table.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_no_shared_shingles(spark):
    table = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    assert sorted(tuple(r)[0::3] for r in near_duplicates(table).collect()) == [(1, 1), (2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé🙂\x1c\x85", max_size=30), max_size=6))
def test_shingle_hashes_count_like_sets(texts):
    sets = shingle_sets(pa.array(texts, pa.string()))
    want = [word_sets(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for a, wa in zip(sets, want):
        for b, wb in zip(sets, want):
            assert len(np.intersect1d(a, b)) == len(wa & wb)


def test_one_of_each_with_clashing_columns(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text, "a", "b", "c"), (3, "", "a", "b", "c")], "doc_id long, text string, class string, text_hash string, k_class string")
    assert sorted(tuple(r) for r in one_of_each(docs).collect()) == [(1, text, "a", "b", "c"), (3, "", "a", "b", "c")]


def test_members_of_regions_are_dealt_once(spark, monkeypatch):
    plans, store = {}, jaccard.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard, "stored", lambda df, name: plans.setdefault(name, plan(df)) and store(df, name))
    # 1, 2 and 3 share two regions each of the same members, 3 and 4 one; 5 is alone
    anchors = {1: [10, 11], 2: [10, 11], 3: [10, 11, 12], 4: [12, 13], 5: [14]}
    sets = spark.createDataFrame([(k, 8, v) for k, v in anchors.items()], "id long, n int, anchors array<long>")
    texts = spark.createDataFrame([(k, "a b c d e f g h i j k l" if k < 4 else f"q{k} r s t u v w x y z {k}") for k in anchors], "id long, text string")
    found = jaccard.links(sets, lambda ids: sets.join(ids, "id", "left_semi"), lambda ids: texts.join(ids, "id", "left_semi"), 5, 75)
    assert {frozenset(r) for r in found.collect()} >= {frozenset((1, 3)), frozenset((2, 3))}
    assert plans["regions"].count("Exchange") == 1 and plans["members"].count("Exchange") == 1


def test_anchors_are_shuffled_of_repeated_sets_only(spark, monkeypatch):
    plans, store = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: plans.setdefault(name, df) is not None and store(df, name))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")  # as with ids that are too many to be sent to all tasks
    try:
        texts = [f"w{k} a b c d e f g h i j {k}" for k in range(40)] * 2 + [" ".join(f"x{k}y{i}" for i in range(12)) for k in range(300)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = near_duplicates(docs).collect()
        wanted = plans["open-sets"]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(conf, before)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(list(enumerate(texts)))
    # the sieve stands before the join with the ids, so that rows are left out before they are shuffled
    assert "LeftSemi" not in wanted

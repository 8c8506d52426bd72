from __future__ import annotations

import re

import corpus_pipeline as cp
from tokenizers import Tokenizer

import __spark_entry__ as entry
from fieldloom.llm import jaccard, quality, secrets, toxicity
from fieldloom.llm.query_secrets import NAMES

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if re.match(rf"op{n}_", q)]) == 1
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark, tables):
    from test_jaccard import brute

    docs = tables.documents
    rows = {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in cp.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]

    model = toxicity.fit(docs, tables.labels)
    scores = {i: float(model.scores(__import__("pyarrow").array([r.text or ""]))[0]) for i, r in rows.items()}
    left = cp.reject_toxic(spark, docs, DATA)
    assert left.columns == docs.columns
    clean = {i for i, s in scores.items() if s < toxicity.REJECT}
    assert {r.doc_id for r in left.collect()} == clean and len(clean) > 0.8 * len(rows)

    good = cp.reject_poor(spark, left, DATA)
    assert good.columns == docs.columns
    scored = quality.scored(left, tables.labels, quality.fit(left, tables.labels)).collect()
    kept = {r.doc_id for r in scored if r.quality_score >= quality.KEEP}
    assert {r.doc_id for r in good.collect()} == kept

    once = cp.one_of_each(spark, good, DATA)
    assert once.columns == docs.columns
    classes = brute([(i, rows[i].text) for i in sorted(kept)])
    single = {c for _, n, c in classes if n} | {i for i, n, _ in classes if not n}
    assert {r.doc_id for r in once.collect()} == single

    red = cp.redact_secrets(spark, once, DATA)
    assert red.columns == docs.columns
    spans = {r.doc_id: r.spans for r in secrets.scan(once).collect()}
    texts = {}
    for i in single:
        out, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                out += rows[i].text[at : s.start] + f"[{NAMES[s.kind]} {s.verdict}]"
            at = max(at, s.end)
        texts[i] = out + (rows[i].text or "")[at:]
    assert {r.doc_id: r.text for r in red.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in red.collect())

    tok = Tokenizer.from_file(cp.TOKENIZER)
    want = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    for result in (cp.pack(spark, red, DATA), cp.run(spark, DATA)):
        got = {}
        for r in result.collect():
            got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        assert {i: b"".join(b for _, b in sorted(p)) for i, p in got.items()} == {i: b"".join(x.to_bytes(4, "little") for x in v) for i, v in want.items()}


def test_stages_take_an_empty_table(spark, tables):
    empty = tables.documents.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, DATA).collect() == []


def test_stages_take_more_columns_and_odd_rows(spark, tables):
    odd = tables.documents.limit(40).selectExpr("*", "if(doc_id IS NULL, NULL, 1) AS score", "if(doc_id IS NULL, NULL, 'k') AS key", "doc_id AS id")
    extra = spark.createDataFrame([(None, None, None, None, None, None, None, None), (7, "", "en", "src0", 0, 1, "k", 7), (7, "", "en", "src0", 0, 1, "k", 7)], odd.schema)
    docs = odd.unionByName(extra)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == odd.columns
    assert cp.STAGES[-1][1](spark, docs, DATA).count() > 0
    assert jaccard.WORDS == 5 and jaccard.PERCENT == 75

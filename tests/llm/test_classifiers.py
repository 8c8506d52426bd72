from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import quality, toxicity
from fieldloom.llm.query_toxicity import held_out
from fieldloom.plans.tables import Tables


@pytest.fixture(scope="module")
def larger(spark):
    return Tables(spark, "/root/testdata/sf0.1")


def rates(found, labels, label, yes):
    rows = found.join(labels.dropDuplicates(["doc_id"]), "doc_id").where(held_out()).select(label, F.expr(yes).alias("yes")).collect()
    right = [r.yes for r in rows if r[label] == 1], [r.yes for r in rows if r[label] == 0]
    return [sum(x) / len(x) for x in right]


def test_toxicity_on_held_out_rows(larger):
    model = toxicity.fit(larger.documents, larger.labels, ~held_out())
    caught, wrong = rates(toxicity.scored(larger.documents, model).select("doc_id", "score"), larger.labels, "toxic", "score >= 0.7")
    assert caught > 0.7 and wrong < 0.01


def test_toxicity_of_odd_rows(spark, larger):
    model = toxicity.fit(larger.documents, larger.labels)
    words = model.toxic.decode().removesuffix(toxicity.CONTEXT).split()[-8:]
    texts = [None, "", "x" * 100_000, "ordinary words only " * 3000, " ".join(words), " ".join(words), "1 2 | §"]
    rows = spark.createDataFrame([(k // 2, t, -1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    out = toxicity.scored(rows.withColumnRenamed("score", "other"), model).orderBy("doc_id").collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    high = [r.text for r in out if r.score >= 0.7]
    assert high == [" ".join(words)] * 2
    kept = toxicity.reject_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == len(texts) - 2
    assert toxicity.scored(rows.limit(0).drop("score"), model).collect() == []


@pytest.mark.parametrize("label", [None, 0, 1])
def test_toxicity_without_both_labels(spark, label):
    docs = spark.createDataFrame([(k, "a b c") for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, label, label), (None, 1, 1), (1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r.score for r in toxicity.scored(docs, model).collect()}
    assert len(scores) == 1 and (min(scores) >= 0.7) == (label == 1)
    assert quality.scored(docs.withColumns({"source": F.lit("s"), "lang": F.lit("x")}), labels, quality.fit(docs, labels)).count() == 4


def test_only_places_count_as_evidence(spark):
    texts = [(1, True, "big bad word")] * 5 + [(1, False, "Other word, " + "y" * 70), (0, True, "a word"), (0, True, "b word"), (0, False, ""), (0, False, "c Word word")]
    rows = spark.createDataFrame(texts, "toxic int, learn boolean, text string")
    got = {r.word: tuple(r)[1:] for r in toxicity.word_places(rows).collect()}
    pairs = {}
    for toxic, learn, text in texts:
        w = [x for x in toxicity.words_of(text)]
        for a, b in zip(["", *w], w):
            pairs.setdefault((toxic, b, a), []).append(learn)
    count = lambda b, v, some: sum(t == v and w == b and (any(x) or not some) for (t, w, _), x in pairs.items())
    words = {w for _, w, _ in pairs if len(w) <= toxicity.WORD_LETTERS}
    assert got == {w: (count(w, 1, False), count(w, 0, False), count(w, 1, True), count(w, 0, True)) for w in words}
    assert got["word"] == (2, 4, 1, 2)
    assert toxicity.doubled(b"ab")[::2] == b"ab"


def test_toxicity_learns_from_whole_texts(spark):
    """What tells toxic from ordinary texts stands behind 20,000 characters here."""
    long = "plain words go on and on " * 800
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [(k, f"{long} {'wretched villain' if k % 2 else 'gentle friend'} number{name(k)} {'villain' if k % 2 else 'friend'} again{name(k)} {'wretched' if k % 2 else 'gentle'} end") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    assert {"wretched", "villain"} <= set(model.toxic.decode().split())
    repeated = toxicity.fit(docs.unionByName(docs.where("doc_id < 9")), labels)
    assert repeated.toxic == model.toxic and repeated.ordinary == model.ordinary


def test_quality_on_held_out_rows(larger):
    docs, labels = larger.documents, larger.labels
    found = quality.scored(docs, labels, quality.fit(docs, labels, ~held_out()), learn=~held_out()).select("doc_id", "quality_score")
    kept, wrong = rates(found, labels, "quality", f"quality_score >= {quality.KEEP}")
    assert kept > 0.99 and wrong < 0.1


def test_sparse_sites_shrink_towards_their_parents(spark):
    rows = [(k, "text", "p", "good") for k in range(200)] + [(1000 + k, "text", "p", "bad") for k in range(200)] + [(2000, "text", "new", "bad"), (3000, "text", None, None)]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, lang string, source string, host_rate double")
    labels = spark.createDataFrame([(k, int(k < 1000), 0) for k, *_ in rows if k < 2000], "doc_id long, quality int, toxic int")
    found = {(r.source, r.lang): r for r in quality.scored(docs, labels, quality.fit(docs, labels)).collect()}
    good, bad, new, none = found["good", "p"], found["bad", "p"], found["bad", "new"], found[None, None]
    assert bad.host_rate < none.host_rate < good.host_rate and abs(none.host_rate - 0.5) < 0.1
    assert bad.path_rate <= new.path_rate < none.path_rate
    # sums by hand: 200 labels, the new path's one unlabelled document at weight SOFT
    assert good.quality_score > none.quality_score > new.quality_score


def test_quality_of_odd_rows(spark, larger):
    model = quality.fit(larger.documents, larger.labels)
    texts = [None, "", "#$% " * 50_000, "The words of a text.\nAnother line.", "The words of a text.\nAnother line.", "\n\n"]
    rows = spark.createDataFrame([(k, t, None, None, 1, 2.0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n int, good double")
    out = quality.scored(rows, larger.labels.limit(0), model).collect()
    assert len(out) == len(texts) and all(0 <= r.quality_score <= 1 for r in out)
    kept = quality.reject_poor(rows, larger.labels.limit(0), model)
    assert kept.columns == rows.columns and {3, 4} <= {r.doc_id for r in kept.collect()}
    assert quality.scored(rows.limit(0), larger.labels, model).collect() == []




def test_clashing_columns(spark, larger):
    names = ("toxicity_text", "Toxicity_Score", "host_key", "path_key", "own_odds", "may_learn", "host_rate", "quality_score", "kept_host_rate", "score")
    docs = spark.createDataFrame([(1, "The words of a text.", "en", "s", *["mine"] * len(names))], ["doc_id", "text", "lang", "source", *names])
    model = toxicity.fit(larger.documents, larger.labels)
    want = docs.collect()
    assert toxicity.reject_toxic(docs, model).collect() == want
    out = toxicity.scored(docs, model)
    assert out.columns == docs.columns and 0 <= out.first().score <= 1 and out.first().toxicity_text == "mine"
    fitted = quality.fit(larger.documents, larger.labels)
    assert quality.reject_poor(docs, larger.labels.limit(0), fitted).collect() == want
    scores = quality.scored(docs, larger.labels.limit(0), fitted).first()
    assert scores.host_key == scores.may_learn == scores.own_odds == "mine" and 0 <= scores.host_rate <= 1

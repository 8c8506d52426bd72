"""Keyword search, routing, evidence scoring, term hierarchies and vector search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import let
from fieldloom.operators.sets import topk_per_group

# fixed values: words that send a question to a domain, in the order that breaks ties
DOMAIN_KEYWORDS: dict[str, list[str]] = {
    "climate": [
        "climate", "temperature", "precipitation", "weather", "forecast", "warming", "rainfall", "drought", "heat", "storm",
        "hurricane", "el niño", "la niña", "greenhouse", "co2", "carbon dioxide",
    ],
    "biodiversity": [
        "species", "biodiversity", "ecosystem", "habitat", "wildlife", "conservation", "endangered", "migration", "bird", "plant",
        "forest", "coral", "reef", "invasive", "extinction",
    ],
    "health": [
        "health", "air quality", "pollution", "disease", "dengue", "malaria", "respiratory", "heat stress", "vulnerability",
        "water quality", "contamination", "epidemiology",
    ],
    "food_security": [
        "food", "crop", "agriculture", "yield", "famine", "hunger", "irrigation", "soil", "livestock", "grain", "rice", "wheat",
        "maize", "supply chain", "food price",
    ],
    "resources": [
        "resource", "water allocation", "energy", "optimization", "equity", "justice", "distribution", "sustainability", "renewable",
        "infrastructure", "budget",
    ],
}

#: query vectors of one block, on average
QUERY_BLOCK = 2048


def tokens(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits (no stemming)."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def search_any(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """Rows whose text has any of the words."""
    wanted = F.array(*[F.lit(w.lower()) for w in words])
    return df.where(F.arrays_overlap(tokens(F.col(text)), wanted))


def contains_topk(df: DataFrame, text: str, needle: str, order: Sequence[Column], k: int = 5) -> DataFrame:
    """First ``k`` rows whose text contains the needle, case ignored."""
    return df.where(F.lower(text).contains(needle.lower())).orderBy(*order).limit(k)


def route(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Domains of a text, most keyword hits first (ties in list order); all domains when nothing hits.

    The keyword lists are fixed, so the scores are expressions of the row: no join.
    """
    keywords = keywords or DOMAIN_KEYWORDS

    def domains(low: Column) -> Column:
        scored = []
        for i, (name, words) in enumerate(keywords.items()):
            hits = None
            for w in words:
                one = low.contains(w).cast("int")
                hits = one if hits is None else hits + one
            # sorts by falling score, then by list order
            scored.append(F.struct((-hits).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")))
        kept = F.filter(F.array_sort(F.array(*scored)), lambda x: x["s"] < 0)
        return F.transform(kept, lambda x: x["name"])

    everything = F.array(*[F.lit(n) for n in keywords])
    return let(let(F.lower(text), domains), lambda names: F.when(F.size(names) > 0, names).otherwise(everything))


def evidence(claim: Column, name: Column, description: Column, trend: Column, severity: Column) -> tuple[Column, Column]:
    """(supports, strength) of one piece of evidence for a claim.

    Strength is 0.5, or that of the first rule that applies, plus 0.1 for each
    shared word, at most 1.
    """
    claim_low = F.lower(claim)
    missing = F.lit("None")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, missing) for c in (name, description, trend, severity)]))

    def says(word: str) -> Column:
        return claim_low.contains(word)

    # fixed values: (condition, supports, strength), first match counts
    rules = [
        (says("increasing") & text.contains("declining"), False, 0.8),
        (says("decreasing") & text.contains("improving"), False, 0.7),
        (says("threat") & F.coalesce(severity.isin("high", "critical"), F.lit(False)), True, 0.9),
        (says("healthy") & F.coalesce(trend == "declining", F.lit(False)), False, 0.85),
        (says("healthy") & F.coalesce(trend == "improving", F.lit(False)), True, 0.85),
    ]
    supports, base = F.lit(True), F.lit(0.5)
    for condition, side, strength in reversed(rules):
        supports = F.when(condition, side).otherwise(supports)
        base = F.when(condition, strength).otherwise(base)

    def words(c: Column) -> Column:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    shared = F.size(F.array_intersect(words(claim_low), words(text)))
    return supports, F.round(F.when(shared > 0, F.least(F.lit(1.0), base + 0.1 * shared)).otherwise(base), 3)


def search_terms(df: DataFrame, text: str) -> DataFrame:
    """Terms with the text in label, description or a synonym, case ignored."""
    t = text.lower()
    return df.where(
        F.lower("label").contains(t) | F.coalesce(F.lower("description").contains(t), F.lit(False))
        | F.coalesce(F.exists("synonyms", lambda s: F.lower(s).contains(t)), F.lit(False))
    )


def children(df: DataFrame, uri: str) -> DataFrame:
    return df.where((F.col("parent_uri") == uri) & (F.col("uri") != uri))


def related(df: DataFrame, uri: str) -> DataFrame:
    """Terms with the same parent first (``rank`` 0), then those of the same domain (1); the term itself is left out."""
    term = df.where(F.col("uri") == uri)
    parent, domain = term.select(F.max("parent_uri")).scalar(), term.select(F.max("domain")).scalar()
    marked = df.where(F.col("uri") != uri).withColumn("_p", parent).withColumn("_d", domain)
    sibling = F.coalesce(F.col("parent_uri") == F.col("_p"), F.lit(False))
    rank = F.when(sibling, 0).when(F.col("domain") == F.col("_d"), 1)
    return marked.withColumn("rank", rank).where("rank IS NOT NULL").drop("_p", "_d")


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean vector of each key; sums are combined per dimension before the shuffle."""
    dims = df.select(key, F.posexplode(vector).alias("_i", "_v")).groupBy(key, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias(vector))


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id"):
    """(query_id, vec_id, score, rank): exact cosine top-k of each query vector over the corpus.

    The query vectors travel in blocks of about ``QUERY_BLOCK``, each as one matrix; an Arrow batch of the corpus is one
    matrix product, of which only its own best ``k`` per query leave the task. The corpus is read once a block and never
    shuffled as a whole.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    parts = [_vector_topk(corpus, queries.where(block == b), k, vec_id, vector, query_id) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _vector_topk(corpus: DataFrame, queries: DataFrame, k: int, vec_id: str, vector: str, query_id: str) -> DataFrame:
    """``vector_topk`` for one block of queries."""
    rows = queries.select(query_id, vector).collect()
    if not rows:
        empty = corpus.sparkSession.createDataFrame([], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {vec_id} {corpus.schema[vec_id].dataType.simpleString()}, score double")
        return topk_per_group(empty, [query_id], [F.desc("score"), F.asc(vec_id)], k)
    ids = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], dtype=np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def best(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
            scores = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ matrix.T
            keys = pdf[vec_id].to_numpy()
            out = []
            for j, q in enumerate(ids):
                order = np.lexsort((keys, -scores[:, j]))[:k]
                out.append(pd.DataFrame({query_id: q, vec_id: keys[order], "score": scores[order, j]}))
            yield pd.concat(out)

    q_type, v_type = queries.schema[query_id].dataType.simpleString(), corpus.schema[vec_id].dataType.simpleString()
    partial = corpus.select(vec_id, vector).mapInPandas(best, f"{query_id} {q_type}, {vec_id} {v_type}, score double")
    return topk_per_group(partial, [query_id], [F.desc("score"), F.asc(vec_id)], k)


def vector_topk_lsh(corpus: DataFrame, query: Sequence[float], k: int, vec_id: str = "vec_id", vector: str = "embedding", tables: int = 8, width: float = 0.5, seed: int = 7):
    """Approximate neighbours of one vector by random projections of the unit vectors (nearest first)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    q = np.asarray(query, dtype=np.float64)
    vectors = corpus.select(vec_id, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    unit = Normalizer(inputCol="_v", outputCol="_u", p=2.0).transform(vectors)
    model = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense(q / np.linalg.norm(q)), k, distCol="_d")
    return near.select(vec_id, (1 - F.col("_d") * F.col("_d") / 2).alias("score"))

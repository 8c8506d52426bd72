"""A training corpus from raw documents, in five stages, each an operator of ``fieldloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the
next one. All stages but the last return the columns of documents. Labels come from the data folder.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import jaccard, packing, quality, secrets, toxicity
from fieldloom.llm.common import stored
from fieldloom.plans.tables import Tables

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, Tables(spark, sf_dir).labels))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, with what is known of their host and path, reaches the limit."""
    labels = Tables(spark, sf_dir).labels
    return quality.reject_poor(docs, labels, quality.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return jaccard.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret replaced in their texts."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_duplicates", one_of_each),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: classifiers and tokenizers have no SQL form; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

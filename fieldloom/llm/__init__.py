"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from importlib import import_module

QUERY_MODULES = (
    "query_chat",
    "query_vectors",
    "query_segmentation",
    "query_warc",
    "query_packing",
    "query_jaccard",
    "query_toxicity",
    "query_secrets",
    "query_quality",
    "query_bpe",
    "query_alignment",
    "query_turn_blocks",
)


def load_queries():
    """(queries, their SQL) of this subpackage and of the corpus pipeline."""
    for name in QUERY_MODULES:
        import_module(f"fieldloom.llm.{name}")
    from fieldloom.llm.registry import ORACLES, QUERIES

    pipeline = import_module("corpus_pipeline")
    oracles = dict(ORACLES) if pipeline.ORACLE_SQL is None else {**ORACLES, "pipeline": pipeline.ORACLE_SQL}
    return {**QUERIES, "pipeline": pipeline.run}, oracles

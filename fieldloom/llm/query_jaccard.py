"""op6: classes of near-duplicate documents."""

from fieldloom.llm.jaccard import near_duplicates
from fieldloom.llm.registry import query


@query("op6_jaccard_join")
def op6(t):
    return near_duplicates(t.documents).select("doc_id", "n_shingles", "component_id")

"""op10: quality of every document, learnt from two thirds of the labels."""

from pyspark.sql import functions as F

from fieldloom.llm.quality import KEEP, fit, scored
from fieldloom.llm.query_toxicity import held_out
from fieldloom.llm.registry import query


@query("op10_quality")
def op10(t):
    docs, labels = t.documents, t.labels
    found = scored(docs, labels, fit(docs, labels, ~held_out()), learn=~held_out())
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "doc_score", "host_rate", "path_rate", "quality_score", (F.col("quality_score") >= KEEP).alias("keep"))

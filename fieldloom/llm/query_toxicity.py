"""op7: toxicity of every document, learnt from two thirds of the labels."""

from pyspark.sql import functions as F

from fieldloom.llm.registry import query
from fieldloom.llm.toxicity import REJECT, fit, scored


def held_out():
    """Whether a document's labels must not be learnt from; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@query("op7_toxicity")
def op7(t):
    model = fit(t.documents, t.labels, ~held_out())
    found = scored(t.documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))

"""op9: spans of secrets in every document."""

from pyspark.sql import functions as F

from fieldloom.llm.registry import query
from fieldloom.llm.secrets import KINDS, LIVE, scan

NAMES = [k for k, *_ in KINDS] + ["live"]


def joined(spans):
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans, kind: int):
    """How many spans are of one kind. (A second argument of the lambda would be the place in the array.)"""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op9_secrets")
def op9(t):
    found = scan(t.documents)
    counts = [counted("spans", i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < LIVE)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

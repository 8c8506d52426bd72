"""op2: near-duplicate embeddings; op8: nearest neighbours of every hundredth embedding."""

from pyspark.sql import functions as F

from fieldloom.llm.neardup import near_duplicates
from fieldloom.llm.neighbours import nearest
from fieldloom.llm.registry import query

OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, p.w FROM reach r JOIN pairs p ON r.w = p.u),
comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.u = vec_id LEFT JOIN deg ON deg.u = vec_id
"""


@query("op2_embedding_dedup", OP2_SQL)
def op2(t):
    return near_duplicates(t.embeddings)


@query("op8_neighbours")
def op8(t):
    return nearest(t.embeddings, F.col("vec_id") % 100 == 0)

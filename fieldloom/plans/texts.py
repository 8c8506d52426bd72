"""Text, term and vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.operators import text as op
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with
from fieldloom.session import shared_dir
from fieldloom.sources.textindex import TextIndex


@query("txt_search_any", "SELECT doc_id, lang FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['license', 'heon', 'thanat'])")
def _(t):
    return op.search_any(t.documents, "text", ["license", "heon", "Thanat"]).select("doc_id", "lang")


def _indexed(t) -> TextIndex:
    index = TextIndex(t.spark, f"{shared_dir(t.spark)}/text-index-{uuid.uuid4().hex}")
    return index.add(t.documents, "doc_id", "text")


@query("txt_search_index", "SELECT doc_id, lang FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['license', 'heon', 'thanat'])")
def _(t):
    index = _indexed(t)
    return index.rows(t.documents, "doc_id", index.search_any(["license", "heon", "Thanat"])).select("doc_id", "lang")


@query("txt_search_all_index", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['license', 'the']) AND doc_id >= 100")
def _(t):
    return _indexed(t).search_all(["license", "the"], low=100).select(F.col("id").alias("doc_id"))


@query("txt_contains_topk", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'er') ORDER BY conv_id DESC, turn LIMIT 5")
def _(t):
    return op.contains_topk(t.conversations, "text", "ER", [F.desc("conv_id"), F.asc("turn")], 5).select("conv_id", "turn", "role")


def _route_sql() -> str:
    parts = []
    for i, (name, words) in enumerate(op.DOMAIN_KEYWORDS.items()):
        hits = " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words)
        parts.append(f"SELECT doc_id, {i} AS i, '{name}' AS name, {hits} AS s FROM d")
    everything = ",".join(op.DOMAIN_KEYWORDS)
    return f"""WITH d AS (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' Coral reef temperature' WHEN 1 THEN ' crop yield and soil' WHEN 2 THEN ' Energy, health' ELSE '' END) AS low FROM documents),
        s AS ({' UNION ALL '.join(parts)}), h AS (SELECT doc_id, string_agg(name, ',' ORDER BY s DESC, i) AS domains FROM s WHERE s > 0 GROUP BY 1)
        SELECT d.doc_id, coalesce(domains, '{everything}') AS domains FROM d LEFT JOIN h ON d.doc_id = h.doc_id"""


@query("txt_route", _route_sql())
def _(t):
    k = F.col("doc_id") % 4
    asked = F.concat("text", F.when(k == 0, " Coral reef temperature").when(k == 1, " crop yield and soil").when(k == 2, " Energy, health").otherwise(""))
    return t.documents.select("doc_id", F.array_join(op.route(asked), ",").alias("domains"))


EVIDENCE_SQL = r"""WITH e AS (SELECT event_id, event_type || ' report' AS name, CASE WHEN event_id % 3 = 0 THEN 'value is ' || event_type END AS description,
      ['improving', 'declining', 'stable', NULL][CAST(user_id % 4 + 1 AS INT)] AS trend, ['low', 'medium', 'high', 'critical', NULL][CAST(event_id % 5 + 1 AS INT)] AS severity,
      ['Population is increasing', 'decreasing click report', 'a threat to view', 'healthy and stable'][CAST(event_id % 4 + 1 AS INT)] AS claim FROM events),
    x AS (SELECT *, lower(claim) AS c, lower(concat_ws(' ', coalesce(name, 'None'), coalesce(description, 'None'), coalesce(trend, 'None'), coalesce(severity, 'None'))) AS t FROM e),
    y AS (SELECT *, CASE WHEN contains(c, 'increasing') AND contains(t, 'declining') THEN 1 WHEN contains(c, 'decreasing') AND contains(t, 'improving') THEN 2
      WHEN contains(c, 'threat') AND coalesce(severity IN ('high', 'critical'), false) THEN 3 WHEN contains(c, 'healthy') AND coalesce(trend = 'declining', false) THEN 4
      WHEN contains(c, 'healthy') AND coalesce(trend = 'improving', false) THEN 5 ELSE 0 END AS rule,
      len(list_intersect(list_distinct(regexp_split_to_array(c, '\s+')), list_distinct(regexp_split_to_array(t, '\s+')))) AS shared FROM x)
    SELECT event_id, rule NOT IN (1, 2, 4) AS supports, round(CAST(least(1.0, CASE rule WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 WHEN 3 THEN 0.9 WHEN 4 THEN 0.85 WHEN 5 THEN 0.85 ELSE 0.5 END + 0.1 * shared) AS DOUBLE), 3) AS strength FROM y"""


@query("txt_evidence", EVIDENCE_SQL)
def _(t):
    k = F.col("event_id")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    rows = t.events.select(
        "event_id", F.concat("event_type", F.lit(" report")).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("value is "), "event_type")).alias("description"),
        pick(["improving", "declining", "stable", None], F.col("user_id") % 4).alias("trend"),
        pick(["low", "medium", "high", "critical", None], k % 5).alias("severity"),
        pick(["Population is increasing", "decreasing click report", "a threat to view", "healthy and stable"], k % 4).alias("claim"),
    )
    supports, strength = op.evidence(*[F.col(c) for c in ("claim", "name", "description", "trend", "severity")])
    return rows.select("event_id", supports.alias("supports"), strength.alias("strength"))


def _terms(t):
    k = F.col("p_partkey")
    return t.part.select(
        F.concat(F.lit("T"), k.cast("string")).alias("uri"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        F.col("p_type").alias("domain"), F.when(k > 0, F.concat(F.lit("T"), F.floor(k / 20).cast("string"))).alias("parent_uri"),
        F.array(F.lower("p_brand"), F.concat(F.lit("item "), (k % 100).cast("string"))).alias("synonyms"),
    )


TERMS_SQL = """WITH terms AS (SELECT 'T' || p_partkey AS uri, p_name AS label, p_type || ' ' || p_brand AS description, p_type AS domain,
    CASE WHEN p_partkey > 0 THEN 'T' || (p_partkey // 20) END AS parent_uri, 'item ' || p_partkey % 100 AS synonym, lower(p_brand) AS brand FROM part)"""


@query("txt_ontology_search", TERMS_SQL + " SELECT uri FROM terms WHERE contains(lower(label), 'item 4') OR contains(lower(description), 'item 4') OR contains(synonym, 'item 4') OR contains(brand, 'item 4')")
def _(t):
    return op.search_terms(_terms(t), "ITEM 4").select("uri")


@query("ont_children", TERMS_SQL + " SELECT uri, label FROM terms WHERE parent_uri = 'T0' AND uri <> 'T0'")
def _(t):
    return op.children(_terms(t), "T0").select("uri", "label")


@query("ont_related", TERMS_SQL + """, me AS (SELECT parent_uri AS p, domain AS d FROM terms WHERE uri = 'T45') SELECT uri, CAST(CASE WHEN parent_uri = p THEN 0 ELSE 1 END AS INT) AS rank
    FROM terms, me WHERE uri <> 'T45' AND (coalesce(parent_uri = p, false) OR domain = d)""")
def _(t):
    return op.related(_terms(t), "T45").select("uri", "rank")


@query("vec_topk", """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
    q AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM c GROUP BY 1)
    SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings CROSS JOIN q)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10""")
def _(t):
    centres = op.mean_vectors(t.embeddings, "label", "embedding").withColumnRenamed("label", "query_id")
    out = op.vector_topk(t.embeddings, centres, 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"))

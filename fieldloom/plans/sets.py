"""Sort, limit, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import sets as op
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts


@query("topk", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def _(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    return op.topk(t.lineitem.select(*cols, "l_extendedprice"), [F.desc("l_extendedprice"), *cols], 50)


@query("topk_per_group", """SELECT region, species, n, rank FROM (SELECT region, species, n, row_number() OVER (PARTITION BY region ORDER BY n DESC, species) AS rank
    FROM (SELECT l_suppkey % 25 AS region, l_partkey % 200 AS species, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rank <= 5""")
def _(t):
    counts = t.occurrences.groupBy("region", "species").agg(F.count(F.lit(1)).alias("n"))
    return op.topk_per_group(counts, ["region"], [F.desc("n"), F.asc("species")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("union_domains", """SELECT 'climate' AS domain, event_id AS id, event_type AS kind, value, NULL AS segment FROM events WHERE value > 100
    UNION ALL SELECT 'health', o_orderkey, o_orderpriority, NULL, NULL FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'resources', c_custkey, NULL, c_acctbal, c_mktsegment FROM customer""")
def _(t):
    return op.union_domains({
        "climate": t.events.where("value > 100").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value"),
        "health": t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind")),
        "resources": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment")),
    }).select("domain", "id", "kind", "value", "segment")


@query("union_append", """SELECT o_custkey AS entity, o_totalprice AS price, NULL AS score FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
    UNION ALL SELECT o_custkey, o_totalprice, o_totalprice / 2 FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def _(t):
    cut = F.lit("1999-01-01").cast("timestamp")
    rows = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("price"), "o_orderdate")
    stored = rows.where(F.col("o_orderdate") < cut).drop("o_orderdate")
    new = rows.where(F.col("o_orderdate") >= cut).drop("o_orderdate").withColumn("score", F.col("price") / 2)
    return op.union_append(stored, new)


@query("set_intersect", "SELECT o_custkey AS entity FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    entity = F.col("o_custkey").alias("entity")
    return t.orders.where("o_orderstatus = 'F'").select(entity).intersect(t.orders.where("o_orderstatus = 'P'").select(entity))


@query("set_except", sql_with("edges", """SELECT DISTINCT src AS node, 'root' AS role FROM edges WHERE src NOT IN (SELECT dst FROM edges)
    UNION ALL SELECT DISTINCT dst, 'leaf' FROM edges WHERE dst NOT IN (SELECT src FROM edges)"""))
def _(t):
    return op.roots_and_leaves(t.edges)


@query("set_common_words", """WITH w AS (SELECT conv_id, turn, unnest(list_distinct([x for x in regexp_split_to_array(lower(text), '\\s+') if x <> ''])) AS word FROM conversations)
    SELECT a.conv_id, a.turn, count(b.word) AS shared FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.word = b.word GROUP BY 1, 2""")
def _(t):
    c = t.conversations.select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    both = c.join(before, ["conv_id", "turn"], "left")
    return both.select(
        "conv_id", "turn",
        F.coalesce(F.size(op.common_words(F.col("text"), F.coalesce("earlier", F.lit("")))), F.lit(0)).cast("long").alias("shared"),
    )


@query("distinct_values", "SELECT DISTINCT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day FROM events")
def _(t):
    return t.events.select("event_type", text_ts(F.date_trunc("day", "ts")).alias("day")).distinct()

"""op13: the prefix trie of all conversations, each begun again with turns of another."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored
from fieldloom.llm.registry import query
from fieldloom.llm.turn_blocks import digests, in_order, prefix_nodes

#: a conversation's number of borrowed turns is below this, and one of so many lends them
HEADS, LENDER = 9, 5

SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % {LENDER} AS base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % {HEADS} AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), o AS (
    SELECT c.conv_id, t.pos AS o, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
    UNION ALL SELECT c.conv_id, {HEADS} + t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h
), r AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS d, text, length(role) || ':' || length(text) || ':' || role || text AS said FROM o
), k AS (
    SELECT conv_id, d, strlen(text) AS bytes, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM r
), p AS (
    SELECT conv_id, d, bytes, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM k
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c
), n AS (
    SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node
), kids AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.node = kids.node),
under AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d),
s AS (
    SELECT top, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
    FROM under JOIN f ON under.node = f.node GROUP BY top
), e AS (
    SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(node, d) AS node FROM p GROUP BY conv_id) GROUP BY node
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN s ON f.node = s.top LEFT JOIN n up ON f.parent = up.node LEFT JOIN e ON f.node = e.node
"""


def rebuilt(turns: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Digests of the rebuilt conversations of ``turns``, and all their conv_ids.

    c begins with the first h turns of conversation c - c % 5 and goes on with its own after its first h, h = crc32(c) % 9.
    """
    placed = stored(in_order(digests(turns), "pos", hot_rows), "placed")
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = placed.select("conv_id").distinct()
    takers = convs.select(F.col("conv_id").alias("taker"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % LENDER).alias("conv_id"))
    heads = placed.where(F.col("pos") < HEADS).join(takers, "conv_id").where("pos <= h").select(F.col("taker").alias("conv_id"), F.col("pos").alias("turn"), "digest", "n_bytes")
    rest = placed.where(F.col("pos") > h).select("conv_id", (F.col("pos") + HEADS).alias("turn"), "digest", "n_bytes")
    return heads.unionByName(rest), convs


@query("op13_turn_blocks", SQL)
def op13(t):
    turns, convs = rebuilt(t.conversations)
    return prefix_nodes(turns, convs)

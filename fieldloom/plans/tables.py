"""The given tables, and the domain tables derived from them.

The given tables carry no coordinates, rasters or graph. Each domain table is
derived by a fixed rule, written here for Spark and in ``CTES`` as SQL, so that
both sides of a check read the same rows.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import shared_dir

# declared schemas: no inference pass, and timestamps are instants (session zone UTC)
BASE = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def text_ts(col: Column | str) -> Column:
    """Timestamp as text, so that both engines hand over the same value."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def lon_of(key: Column) -> Column:
    return (key * 7919 % 36000) / F.lit(100.0) - 180


def lat_of(key: Column) -> Column:
    return (key * 104729 % 18000) / F.lit(100.0) - 90


class Tables:
    """Lazy access to one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.schema(BASE[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        """event_id, variable, value, ts, station."""
        return self.events.select(
            "event_id", F.col("event_type").alias("variable"), "value", "ts", F.col("user_id").alias("station")
        )

    @cached_property
    def gappy(self) -> DataFrame:
        """Hourly mean per variable; hours with no reading are missing rows, some values are null."""
        e = self.observations
        return e.groupBy("variable", F.date_trunc("hour", "ts").alias("ts")).agg(
            F.avg(F.when(F.col("event_id") % 17 != 0, F.col("value"))).alias("value"),
            F.max("event_id").alias("last_id"),
        ).select("variable", "ts", F.when(F.col("last_id") % 5 != 0, F.col("value")).alias("value"))

    @cached_property
    def stations(self) -> DataFrame:
        u = self.events.select(F.col("user_id").alias("station")).distinct()
        return u.select("station", lon_of(F.col("station")).alias("lon"), lat_of(F.col("station")).alias("lat"))

    @cached_property
    def points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("id"), lon_of(k).alias("lon"), lat_of(k).alias("lat"), "c_acctbal", "c_nationkey", "c_mktsegment"
        )

    @cached_property
    def boxes(self) -> DataFrame:
        k = F.col("n_nationkey").cast("long")
        west = -180.0 + 72.0 * (k % 5)
        south = -90.0 + 36.0 * F.floor(k / 5)
        return self.nation.select(
            k.alias("box"), "n_name", west.alias("min_lon"), south.alias("min_lat"),
            (west + 72).alias("max_lon"), (south + 36).alias("max_lat"),
        )

    @cached_property
    def air(self) -> DataFrame:
        """event_id, station, ts, parameter, value."""
        p = F.col("user_id") % 4
        return self.events.select(
            "event_id", F.col("user_id").alias("station"), "ts",
            F.when(p == 0, "pm25").when(p == 1, "pm10").when(p == 2, "o3").otherwise("no2").alias("parameter"),
            "value", "event_type",
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        """species, region, observed_at, status, record id."""
        s = F.col("l_partkey") % 200
        codes = F.array(*[F.lit(c) for c in STATUS_CODES])
        return self.lineitem.select(
            s.alias("species"), (F.col("l_suppkey") % 25).alias("region"), F.col("l_shipdate").alias("observed_at"),
            F.element_at(codes, (s % 9 + 1).cast("int")).alias("status"),
            F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber",
        )

    @cached_property
    def treatment(self) -> DataFrame:
        """unit, treated 0/1, outcome, balance, nation."""
        o, c = self.orders, self.customer
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("unit"),
            F.substring("o_orderpriority", 1, 1).isin("1", "2").cast("int").alias("treated"),
            F.col("o_totalprice").alias("outcome"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_nationkey").cast("double").alias("nation"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"),
            F.col("l_extendedprice").alias("y_true"),
            (F.col("l_quantity") * 2000 * (1 - F.col("l_discount"))).alias("y_pred"),
            (20000 * (1 + F.col("l_tax"))).alias("y_std"),
        )

    @cached_property
    def classes(self) -> DataFrame:
        n = F.col("l_linenumber")
        return self.lineitem.select(
            (n % 3).cast("int").alias("y_true"),
            ((n + F.col("l_suppkey") % 2) % 3).cast("int").alias("y_pred"),
        )

    @cached_property
    def features(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("state"),
        )

    @cached_property
    def updates(self) -> DataFrame:
        """client, idx, value: one mean per coordinate, with the rows behind it."""
        return self.events.groupBy(F.col("event_type").alias("client"), (F.col("user_id") % 20).alias("idx")).agg(
            F.avg("value").alias("value"), F.count(F.lit(1)).alias("num_samples")
        )

    @cached_property
    def episodes(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("policy"), F.col("user_id").alias("episode"), "ts", "event_id",
            F.col("value").alias("reward"), (F.col("user_id") % 7).alias("sector"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """raster_id, band, row, col, value; 100 by 100 pixels a raster, some nodata (-9999)."""
        k = F.col("p_partkey")
        cell = self.part.select(
            F.floor(k / 10000).alias("raster_id"), F.floor(k % 10000 / 100).alias("row"), (k % 100).alias("col"),
            F.col("p_size").cast("double").alias("b3"), F.col("p_retailprice").alias("b4"), k.alias("k"),
        )
        band = F.explode(F.array(
            F.struct(F.lit(3).alias("band"), F.col("b3").alias("value")),
            F.struct(F.lit(4).alias("band"), F.when(F.col("k") % 37 == 0, F.lit(-9999.0)).otherwise(F.col("b4")).alias("value")),
        ))
        return cell.select("raster_id", "row", "col", band.alias("s")).select(
            "raster_id", F.col("s.band").alias("band"), "row", "col", F.col("s.value").alias("value")
        )

    # ---- property graph -------------------------------------------------
    @cached_property
    def nodes(self) -> DataFrame:
        """id, label, name, domain, status."""
        none = F.lit(None).cast("string")

        def rows(df, prefix, key, label, name, domain, status=none):
            return df.select(
                F.concat(F.lit(prefix), key.cast("string")).alias("id"), F.lit(label).alias("label"),
                name.alias("name"), domain.alias("domain"), status.alias("status"),
            )

        codes = F.array(*[F.lit(c) for c in STATUS_CODES])
        p = self.part
        threat = self.orders.select("o_orderpriority").distinct()
        policy = p.select("p_type").distinct()
        return (
            rows(self.region, "R", F.col("r_regionkey"), "Region", F.col("r_name"), none)
            .unionByName(rows(self.nation, "N", F.col("n_nationkey"), "Region", F.col("n_name"), none))
            .unionByName(rows(self.supplier, "S", F.col("s_suppkey"), "Habitat", F.col("s_name"), F.lit("biodiversity")))
            .unionByName(rows(
                self.customer, "C", F.col("c_custkey"), "Ecosystem", F.col("c_name"),
                F.when(F.col("c_custkey") % 2 == 0, "climate").otherwise("health"),
            ))
            .unionByName(rows(
                p, "P", F.col("p_partkey"), "Species", F.col("p_name"), F.lit("biodiversity"),
                F.element_at(codes, (F.col("p_partkey") % 9 + 1).cast("int")),
            ))
            .unionByName(rows(threat, "T", F.col("o_orderpriority"), "Threat", F.col("o_orderpriority"), F.lit("climate")))
            .unionByName(rows(policy, "L", F.col("p_type"), "Policy", F.col("p_type"), F.lit("resources")))
        )

    @cached_property
    def stored_edges(self) -> DataFrame:
        """The edges written once, as the rounds of a traversal need them."""
        path = f"{shared_dir(self.spark)}/edges-{uuid.uuid4().hex}"
        self.edges.write.parquet(path)
        return self.spark.read.schema(self.edges.schema).parquet(path)

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, type, strength (distinct)."""

        def rel(df, a, akey, b, bkey, kind, strength=F.lit(1.0)):
            return df.select(
                F.concat(F.lit(a), akey.cast("string")).alias("src"),
                F.concat(F.lit(b), bkey.cast("string")).alias("dst"),
                F.lit(kind).alias("type"), strength.cast("double").alias("strength"),
            )

        c, o, p = self.customer, self.orders, self.part
        inhabits = self.lineitem.select("l_partkey", "l_suppkey").distinct()
        threatens = o.where("o_orderstatus = 'F'").select("o_orderpriority", "o_custkey").distinct()
        ck = F.col("c_custkey")
        return (
            rel(self.nation, "N", F.col("n_nationkey"), "R", F.col("n_regionkey"), "LOCATED_IN")
            .unionByName(rel(self.supplier, "S", F.col("s_suppkey"), "N", F.col("s_nationkey"), "LOCATED_IN"))
            .unionByName(rel(c, "C", ck, "N", F.col("c_nationkey"), "LOCATED_IN"))
            .unionByName(rel(inhabits, "P", F.col("l_partkey"), "S", F.col("l_suppkey"), "INHABITS"))
            .unionByName(rel(threatens, "T", F.col("o_orderpriority"), "C", F.col("o_custkey"), "THREATENS"))
            .unionByName(rel(p, "L", F.col("p_type"), "P", F.col("p_partkey"), "PROTECTS"))
            .unionByName(rel(
                c.where("c_custkey > 0"), "C", ck, "C", F.floor(ck / 2), "DRAINS_TO", F.col("c_acctbal") / 10000
            ))
            .unionByName(rel(
                c.where("c_custkey > 0"), "C", ck, "C", F.floor(ck / 3), "INFLUENCES", F.col("c_acctbal") / 10000
            ))
            .unionByName(rel(
                c.where("c_custkey % 3 = 0"), "C", ck, "S", F.floor(ck / 15), "DEPENDS_ON", F.col("c_acctbal")
            ))
            .unionByName(rel(
                p.select("p_type").distinct().join(
                    o.select("o_orderpriority").distinct(),
                    F.length("p_type") % 5 + 1 == F.substring("o_orderpriority", 1, 1).cast("int"),
                ),
                "L", F.col("p_type"), "T", F.col("o_orderpriority"), "MITIGATES",
            ))
        )


# fixed values: conservation status codes
STATUS_CODES = ["LC", "NT", "VU", "EN", "CR", "EW", "EX", "DD", "NE"]

_codes_sql = "[" + ", ".join(f"'{c}'" for c in STATUS_CODES) + "]"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), "SELECT event_id, event_type AS variable, value, ts, user_id AS station FROM events"),
    "gappy": (("obs",), """SELECT variable, ts, CASE WHEN last_id % 5 <> 0 THEN value END AS value FROM (
        SELECT variable, date_trunc('hour', ts) AS ts, avg(CASE WHEN event_id % 17 <> 0 THEN value END) AS value,
               max(event_id) AS last_id FROM obs GROUP BY 1, 2)"""),
    "stations": ((), """SELECT station, (station * 7919 % 36000) / 100.0 - 180 AS lon,
        (station * 104729 % 18000) / 100.0 - 90 AS lat FROM (SELECT DISTINCT user_id AS station FROM events)"""),
    "points": ((), """SELECT c_custkey AS id, CAST((c_custkey * 7919 % 36000) / 100.0 - 180 AS DOUBLE) AS lon,
        CAST((c_custkey * 104729 % 18000) / 100.0 - 90 AS DOUBLE) AS lat, c_acctbal, c_nationkey, c_mktsegment FROM customer"""),
    "boxes": ((), """SELECT CAST(n_nationkey AS BIGINT) AS box, n_name, -180.0 + 72.0 * (n_nationkey % 5) AS min_lon,
        -90.0 + 36.0 * (n_nationkey // 5) AS min_lat, -108.0 + 72.0 * (n_nationkey % 5) AS max_lon,
        -54.0 + 36.0 * (n_nationkey // 5) AS max_lat FROM nation"""),
    "air": ((), """SELECT event_id, user_id AS station, ts, CASE user_id % 4 WHEN 0 THEN 'pm25' WHEN 1 THEN 'pm10'
        WHEN 2 THEN 'o3' ELSE 'no2' END AS parameter, value, event_type FROM events"""),
    "occ": ((), f"""SELECT l_partkey % 200 AS species, l_suppkey % 25 AS region, l_shipdate AS observed_at,
        ({_codes_sql})[CAST((l_partkey % 200) % 9 + 1 AS INT)] AS status, l_quantity AS quantity, l_orderkey, l_linenumber
        FROM lineitem"""),
    "treatment": ((), """SELECT o_orderkey AS unit, CAST(substr(o_orderpriority, 1, 1) IN ('1', '2') AS INT) AS treated,
        o_totalprice AS outcome, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "predictions": ((), """SELECT l_orderkey, l_linenumber, l_returnflag AS model, l_extendedprice AS y_true,
        l_quantity * 2000 * (1 - l_discount) AS y_pred, 20000 * (1 + l_tax) AS y_std FROM lineitem"""),
    "classes": ((), """SELECT l_linenumber % 3 AS y_true, CAST((l_linenumber + l_suppkey % 2) % 3 AS INT) AS y_pred
        FROM lineitem"""),
    "features": ((), """SELECT o_custkey AS entity, o_orderdate AS ts, o_orderkey AS seq,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS state FROM orders"""),
    "updates": ((), """SELECT event_type AS client, user_id % 20 AS idx, avg(value) AS value, count(*) AS num_samples
        FROM events GROUP BY 1, 2"""),
    "episodes": ((), """SELECT event_type AS policy, user_id AS episode, ts, event_id, value AS reward,
        user_id % 7 AS sector FROM events"""),
    "pixels": ((), """SELECT p_partkey // 10000 AS raster_id, band, (p_partkey % 10000) // 100 AS "row", p_partkey % 100 AS col,
        CASE WHEN band = 3 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 37 = 0 THEN -9999.0 ELSE p_retailprice END AS value
        FROM part CROSS JOIN (SELECT unnest([3, 4]) AS band)"""),
    "nodes": ((), f"""
        SELECT 'R' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL AS domain, NULL AS status FROM region
        UNION ALL SELECT 'N' || n_nationkey, 'Region', n_name, NULL, NULL FROM nation
        UNION ALL SELECT 'S' || s_suppkey, 'Habitat', s_name, 'biodiversity', NULL FROM supplier
        UNION ALL SELECT 'C' || c_custkey, 'Ecosystem', c_name, CASE WHEN c_custkey % 2 = 0 THEN 'climate' ELSE 'health' END, NULL FROM customer
        UNION ALL SELECT 'P' || p_partkey, 'Species', p_name, 'biodiversity', ({_codes_sql})[CAST(p_partkey % 9 + 1 AS INT)] FROM part
        UNION ALL SELECT DISTINCT 'T' || o_orderpriority, 'Threat', o_orderpriority, 'climate', NULL FROM orders
        UNION ALL SELECT DISTINCT 'L' || p_type, 'Policy', p_type, 'resources', NULL FROM part"""),
    "edges": ((), """
        SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'LOCATED_IN' AS type, 1.0 AS strength FROM nation
        UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN', 1.0 FROM supplier
        UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN', 1.0 FROM customer
        UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'INHABITS', 1.0 FROM lineitem
        UNION ALL SELECT DISTINCT 'T' || o_orderpriority, 'C' || o_custkey, 'THREATENS', 1.0 FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'L' || p_type, 'P' || p_partkey, 'PROTECTS', 1.0 FROM part
        UNION ALL SELECT 'C' || c_custkey, 'C' || (c_custkey // 2), 'DRAINS_TO', c_acctbal / 10000 FROM customer WHERE c_custkey > 0
        UNION ALL SELECT 'C' || c_custkey, 'C' || (c_custkey // 3), 'INFLUENCES', c_acctbal / 10000 FROM customer WHERE c_custkey > 0
        UNION ALL SELECT 'C' || c_custkey, 'S' || (c_custkey // 15), 'DEPENDS_ON', c_acctbal FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'L' || p_type, 'T' || o_orderpriority, 'MITIGATES', 1.0 FROM (SELECT DISTINCT p_type FROM part)
            CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)
            WHERE length(p_type) % 5 + 1 = CAST(substr(o_orderpriority, 1, 1) AS INT)"""),
}


def sql_with(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named derived tables (and what they need) before ``body``.

    ``body`` may start with further CTEs written as ``, name AS (...)``.
    """
    needed: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"

"""Evaluation, feature store and scoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.operators import evaluate as op
from fieldloom.operators import features as fs
from fieldloom.plans.aggregates import rounded
from fieldloom.plans.registry import query
from fieldloom.plans.scalars import ERF_SQL
from fieldloom.plans.tables import sql_with, text_ts
from fieldloom.session import shared_dir


@query("ev_regression", sql_with("predictions", """SELECT model, round(sqrt(avg((y_pred - y_true) ** 2)), 4) AS rmse, round(avg(abs(y_pred - y_true)), 4) AS mae,
    round(1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)), 6) AS r2, round(avg(CASE WHEN y_true <> 0 THEN abs((y_pred - y_true) / y_true) END) * 100, 6) AS mape,
    round(avg(y_pred - y_true), 4) AS bias, count(*) AS n FROM predictions GROUP BY 1"""))
def _(t):
    return rounded(rounded(op.regression(t.predictions, ["model"]), 4, "rmse", "mae", "bias"), 6, "r2", "mape")


CLASS_SQL = """, k AS (SELECT unnest(range({n})) AS c), s AS (SELECT c, (SELECT count(*) FROM classes WHERE y_true = c AND y_pred = c) AS tp,
    (SELECT count(*) FROM classes WHERE y_pred = c) AS pr, (SELECT count(*) FROM classes WHERE y_true = c) AS ac FROM k)"""


@query("ev_classification", sql_with("classes", CLASS_SQL.format(n=4) + """, m AS (SELECT sum(tp) / sum(ac) AS a, sum(coalesce(tp / nullif(pr, 0), 0)) / 4 AS p, sum(coalesce(tp / nullif(ac, 0), 0)) / 4 AS r FROM s)
    SELECT round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m"""))
def _(t):
    return rounded(op.classification(t.classes, 4), 6, "accuracy", "precision", "recall", "f1")


@query("ev_confusion", sql_with("classes", """SELECT CAST(a.c AS INT) AS y_true, CAST(b.c AS INT) AS y_pred, coalesce(n, 0) AS n FROM (SELECT unnest(range(4)) AS c) a CROSS JOIN (SELECT unnest(range(4)) AS c) b
    LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM classes GROUP BY 1, 2) ON a.c = y_true AND b.c = y_pred"""))
def _(t):
    return op.confusion(t.classes, 4)


@query("ev_segmentation", sql_with("classes", CLASS_SQL.format(n=10) + """ SELECT round(sum(tp) / sum(ac), 6) AS pixel_accuracy, round(sum(coalesce(tp / nullif(pr + ac - tp, 0), 0)) / 10, 6) AS mean_iou,
    round(sum(coalesce(2 * tp / nullif(pr + ac, 0), 0)) / 10, 6) AS mean_dice FROM s"""))
def _(t):
    return rounded(op.segmentation(t.classes, 10), 6, "pixel_accuracy", "mean_iou", "mean_dice")


PPF_975 = "(s - (2.515517 + 0.802853 * s + 0.010328 * s * s) / (1 + 1.432788 * s + 0.189269 * s * s + 0.001308 * s * s * s))"


@query("ev_forecast", sql_with("predictions", ", z AS (SELECT *, (y_true - y_pred) / y_std AS z, sqrt(-2 * ln(1 - 0.975)) AS s FROM predictions), e AS (SELECT *, " + ERF_SQL.format(x="(z / sqrt(2))") + f""" AS erf FROM z)
    SELECT model, round(avg(y_std * (z * erf + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 4) AS crps, round(avg(CASE WHEN abs(y_true - y_pred) <= {PPF_975} * y_std THEN 1 ELSE 0 END), 6) AS coverage,
      round(avg(y_std), 4) AS sharpness, round(1 - avg((y_true - y_pred) ** 2) / 1e9, 6) AS skill FROM e GROUP BY 1"""))
def _(t):
    out = op.forecast(t.predictions, ["model"], reference_mse=1e9)
    return rounded(rounded(out, 4, "crps", "sharpness"), 6, "coverage", "skill")


@query("ev_dispatch", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", op.argmax_class(F.col("embedding")).alias("class"))


def _store(t) -> fs.FeatureStore:
    """A store with three sets: what orders, their items and the accounts tell of a customer."""
    store = fs.FeatureStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}", "quarter")
    store.register("orders", "entity", "ts", ["price", "state"], "order facts", ["sales"], "seq")
    return store


def _three_sets(t) -> fs.FeatureStore:
    store = _store(t)
    store.register("items", "customer", "at", ["quantity", "flag"], "last item", seq="line")
    store.register("accounts", "entity", "ts", ["price", "segment"], "account facts")
    store.ingest("orders", t.features)
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer"), F.col("l_shipdate").alias("at"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("line"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")).alias("flag"),
    )
    store.ingest("items", items)
    opened = (F.lit("1994-01-01").cast("timestamp") + F.make_dt_interval(F.col("c_custkey") % 700)).alias("ts")
    store.ingest("accounts", t.customer.select(F.col("c_custkey").alias("entity"), opened, F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("segment")))
    return store


@query("fs_register", """SELECT 'orders_' || o_orderpriority AS name, 'o_custkey' AS entity, string_agg(DISTINCT 'total_' || o_orderstatus, ',' ORDER BY 'total_' || o_orderstatus) AS features
    FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'orders', 'entity', 'price,state'""")
def _(t):
    """A set for each order priority, with a feature for each status that orders of it have."""
    store = _store(t)
    found = t.orders.groupBy("o_orderpriority").agg(F.array_sort(F.collect_set(F.concat(F.lit("total_"), F.col("o_orderstatus")))).alias("features"))
    store.register_all(found.select(F.concat(F.lit("orders_"), F.col("o_orderpriority")).alias("name"), F.lit("o_custkey").alias("entity"), F.lit("o_orderdate").alias("ts"), "features"))
    return store.sets().select("name", "entity", F.array_join("features", ",").alias("features"))


@query("fs_ingest", sql_with("features", "SELECT entity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, price FROM features WHERE ts BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-06-30'"))
def _(t):
    store = _store(t)
    store.ingest("orders", t.features.where("ts >= TIMESTAMP '1998-12-01' AND ts < TIMESTAMP '1999-08-01'"))
    rows, _ = store.rows("orders", "1999-01-01", "1999-06-30")
    return rows.select("entity", text_ts("ts").alias("ts"), "price")


FS_GET = """SELECT entity, arg_max(price, row(ts, seq)) FILTER (price IS NOT NULL) AS price, arg_max(state, row(ts, seq)) FILTER (state IS NOT NULL) AS state
    FROM features WHERE ts <= TIMESTAMP '1999-06-30' GROUP BY 1"""


@query("fs_get", sql_with("features", FS_GET))
def _(t):
    store = _store(t)
    store.ingest("orders", t.features)
    return store.get("orders", "1999-06-30")


SETS_SQL = """, i AS (SELECT o_custkey AS entity, l_shipdate AS ts, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS quantity,
      CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    a AS (SELECT c_custkey AS entity, TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 700 AS INT)) AS ts, c_acctbal AS price_accounts, c_mktsegment AS segment FROM customer)"""


def _known(rows: str, column: str) -> str:
    """CTE of the values of a column by entity and time, the last by seq."""
    return f"k_{column} AS (SELECT entity, ts, arg_max({column}, seq) AS {column} FROM {rows} WHERE {column} IS NOT NULL GROUP BY 1, 2)"


COLUMNS = {"price": "features", "state": "features", "quantity": "i", "flag": "i", "price_accounts": "(SELECT *, 0 AS seq FROM a)", "segment": "(SELECT *, 0 AS seq FROM a)"}


@query("fs_training", sql_with("features", SETS_SQL + ", " + ", ".join(_known(r, c) for c, r in COLUMNS.items()) + """,
    l AS (SELECT o_orderkey AS label, o_custkey AS entity, o_orderdate - INTERVAL 1 DAY AS "at" FROM orders WHERE o_orderstatus = 'O')
    SELECT label, l.entity, """ + ", ".join(COLUMNS) + " FROM l " + " ".join(f"ASOF LEFT JOIN k_{c} ON l.entity = k_{c}.entity AND l.\"at\" >= k_{c}.ts" for c in COLUMNS)))
def _(t):
    labels = t.orders.where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("label"), (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("at")
    )
    return _three_sets(t).training_at(labels, ["orders", "items", "accounts"], "at").drop("at")


TIMELINE = SETS_SQL + """, u AS (SELECT entity, ts, 0 AS side, seq, price, state, NULL AS quantity, NULL AS flag, NULL AS price_accounts, NULL AS segment FROM features
      UNION ALL SELECT entity, ts, 1, seq, NULL, NULL, quantity, flag, NULL, NULL FROM i UNION ALL SELECT entity, ts, 2, 0, NULL, NULL, NULL, NULL, price_accounts, segment FROM a),
    c AS (SELECT entity, ts, side, seq, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in COLUMNS) + """ FROM u WHERE ts <= TIMESTAMP '1998-03-01' WINDOW w AS (PARTITION BY entity ORDER BY ts, side, seq ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity, ts ORDER BY side DESC, seq DESC) = 1), n AS (SELECT *, lead(ts) OVER (PARTITION BY entity ORDER BY ts) AS nx FROM d)
    SELECT entity, strftime(greatest(ts, TIMESTAMP '1998-01-01'), '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(coalesce(least(nx, TIMESTAMP '1998-03-01'), TIMESTAMP '1998-03-01'), '%Y-%m-%d %H:%M:%S') AS valid_to,
      """ + ", ".join(COLUMNS) + """ FROM n WHERE ts < TIMESTAMP '1998-03-01' AND (nx IS NULL OR nx > TIMESTAMP '1998-01-01')"""


@query("fs_timeline", sql_with("features", TIMELINE))
def _(t):
    known = _three_sets(t).timeline(["orders", "items", "accounts"], "1998-01-01", "1998-03-01")
    return known.withColumns({c: text_ts(c) for c in ("valid_from", "valid_to")})


@query("fs_online_latest", sql_with("features", """SELECT 'features:orders:' || entity AS key, state, price FROM (
    SELECT entity, arg_max(price, row(ts, seq)) FILTER (price IS NOT NULL) AS price, arg_max(state, row(ts, seq)) FILTER (state IS NOT NULL) AS state FROM features GROUP BY 1)"""))
def _(t):
    store = _store(t)
    store.ingest("orders", t.features)
    v = F.col("value")
    return store.online("orders").select("key", F.get_json_object(v, "$.state").alias("state"), F.get_json_object(v, "$.price").cast("double").alias("price"))


@query("ml_split", """SELECT o_orderkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS part FROM
    (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", op.split(F.col("o_orderkey")).alias("part"))


@query("ml_ensemble", """WITH m AS (SELECT l_orderkey AS row_id, l_linenumber AS model, avg(l_extendedprice) AS y_pred FROM lineitem GROUP BY 1, 2),
    w AS (SELECT model, model + 1.0::DOUBLE AS weight FROM (SELECT DISTINCT model FROM m)), t AS (SELECT sum(weight) AS s FROM w),
    j AS (SELECT row_id, y_pred, weight / s AS w FROM m JOIN w ON m.model = w.model, t), a AS (SELECT row_id, sum(w * y_pred) AS mean FROM j GROUP BY 1)
    SELECT a.row_id, round(mean, 4) AS mean, round(sqrt(sum(w * (y_pred - mean) ** 2)), 4) AS uncertainty FROM j JOIN a ON j.row_id = a.row_id GROUP BY 1, 2""")
def _(t):
    members = t.lineitem.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("model")).agg(F.avg("l_extendedprice").alias("y_pred"))
    weights = members.select("model").distinct().withColumn("weight", F.col("model") + 1.0)
    return rounded(op.ensemble(members, weights, ["row_id"]), 4, "mean", "uncertainty")


@query("ml_mc_stats", """SELECT l_partkey, round(avg(l_extendedprice * 0.7310585), 5) AS mean, round(stddev_pop(l_extendedprice * 0.7310585), 5) AS std,
    count(*) AS samples FROM lineitem GROUP BY 1""")
def _(t):
    scaled = t.lineitem.withColumn("sample", F.col("l_extendedprice") * 0.7310585)
    return rounded(op.sample_stats(scaled, ["l_partkey"], "sample"), 5, "mean", "std")


@query("ml_recon_score", """WITH l AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
    SELECT vec_id, round(avg((CAST(embedding[i] AS DOUBLE) - c) ** 2), 8) AS score FROM embeddings e JOIN l ON e.label = l.label GROUP BY 1""")
def _(t):
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    centres = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("x_hat"))
    return t.embeddings.join(centres, "label").select("vec_id", F.round(op.reconstruction_error(F.col("embedding"), F.col("x_hat")), 8).alias("score"))


@query("ml_registry_compare", sql_with("obs", """SELECT variable AS model, station % 5 AS version, round(avg(value), 6) AS rmse, round(max(value), 6) AS worst FROM obs GROUP BY 1, 2"""))
def _(t):
    runs = t.observations.groupBy(F.col("variable").alias("model"), (F.col("station") % 5).alias("version")).agg(
        F.avg("value").alias("a"), F.max("value").alias("m")
    ).select("model", "version", F.explode(F.create_map(F.lit("rmse"), "a", F.lit("worst"), "m")).alias("metric", "value"))
    return rounded(op.compare_versions(runs, "model", "version", "metric", "value", ["rmse", "worst"]), 6, "rmse", "worst")


BEST_SQL = """WITH h AS (SELECT event_type || '/' || user_id % 20 AS run, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) AS s, value AS l FROM events),
    m AS (SELECT *, min(l) OVER (PARTITION BY run ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM h),
    b AS (SELECT *, max(CASE WHEN low IS NULL OR l < low THEN s END) OVER (PARTITION BY run ORDER BY s ROWS UNBOUNDED PRECEDING) AS bs FROM m),
    x AS (SELECT run, coalesce(min(CASE WHEN s - bs >= 10 THEN s END), max(s)) AS stop_step FROM b GROUP BY 1),
    y AS (SELECT b.run, max(bs) AS best_step, any_value(stop_step) AS stop_step FROM b JOIN x ON b.run = x.run WHERE s <= stop_step GROUP BY 1)
    SELECT y.run, best_step, h.l AS best_loss, stop_step FROM y JOIN h ON y.run = h.run AND h.s = best_step"""


@query("ml_run_metrics", BEST_SQL)
def _(t):
    from fieldloom.operators.scale import with_position

    runs = t.events.select(
        F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string")).alias("run"), "ts", "event_id", F.col("value").alias("val_loss")
    )
    history = with_position(runs, ["run"], [F.col("ts"), F.col("event_id")], "epoch")
    return op.best_epochs(history, "run", "epoch", "val_loss", 10)


STACK_SQL = """, m AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, sum(y_true) AS y, sum(y_pred) AS a, sum(y_std * y_std / 20000) AS b FROM predictions GROUP BY 1),
    c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM m),
    w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb, * FROM c)
    SELECT row_id, round(my + wa * (a - ma) + wb * (b - mb), 2) AS stacked FROM m, w"""


@query("ml_stacking", sql_with("predictions", STACK_SQL))
def _(t):
    wide = t.predictions.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")).agg(
        F.sum("y_true").alias("y"), F.sum("y_pred").alias("a"), F.sum(F.col("y_std") * F.col("y_std") / 20000).alias("b")
    )
    scored, _ = op.stack(wide, ["a", "b"], "y")
    return scored.select("row_id", F.round("stacked", 2).alias("stacked"))

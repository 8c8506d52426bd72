"""Causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import bootstrap
from fieldloom.operators import causal as op
from fieldloom.operators.aggregates import pivot_series
from fieldloom.operators.bootstrap import weight_sql
from fieldloom.plans.aggregates import CORR_CTE, PAIRS, rounded
from fieldloom.plans.registry import query
from fieldloom.plans.scalars import ERF_SQL
from fieldloom.plans.tables import sql_with, text_ts

VARIABLES = ["click", "error", "purchase", "signup", "view"]
CHAIN = [("click", "error"), ("click", "purchase"), ("error", "purchase"), ("purchase", "view"), ("signup", "view")]

DIFF = """, d AS (SELECT avg(outcome) FILTER (treated = 1) - avg(outcome) FILTER (treated = 0) AS ate, sqrt(var_samp(outcome) FILTER (treated = 1) / count(*) FILTER (treated = 1)
    + var_samp(outcome) FILTER (treated = 0) / count(*) FILTER (treated = 0)) AS se, count(*) AS n FROM treatment)"""


def normal_p(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    return f"2 * (1 - 0.5 * (1 + {ERF_SQL.format(x=x)}))"


@query("ca_diff_means", sql_with("treatment", DIFF + f" SELECT round(ate, 4) AS ate, round(se, 4) AS se, n, round(ate - 1.96 * se, 4) AS lower, round(ate + 1.96 * se, 4) AS upper, round({normal_p('ate / se')}, 6) AS p_value FROM d"))
def _(t):
    return rounded(rounded(op.diff_means(t.treatment, "treated", "outcome"), 4, "ate", "se", "lower", "upper"), 6, "p_value")


OLS = """, c AS (SELECT count(*) AS n, var_pop(outcome) AS yy, var_pop(treated) AS tt, var_pop(balance) AS bb, var_pop(nation) AS cc, covar_pop(treated, balance) AS tb, covar_pop(treated, nation) AS tc,
      covar_pop(balance, nation) AS bc, covar_pop(treated, outcome) AS ty, covar_pop(balance, outcome) AS ly, covar_pop(nation, outcome) AS cy FROM treatment),
    s AS (SELECT *, tt * (bb * cc - bc * bc) - tb * (tb * cc - bc * tc) + tc * (tb * bc - bb * tc) AS det FROM c),
    b AS (SELECT *, (ty * (bb * cc - bc * bc) - tb * (ly * cc - bc * cy) + tc * (ly * bc - bb * cy)) / det AS b1, (tt * (ly * cc - cy * bc) - ty * (tb * cc - bc * tc) + tc * (tb * cy - ly * tc)) / det AS b2,
      (tt * (bb * cy - bc * ly) - tb * (tb * cy - ly * tc) + ty * (tb * bc - bb * tc)) / det AS b3, (bb * cc - bc * bc) / det AS inv FROM s),
    r AS (SELECT *, yy - b1 * ty - b2 * ly - b3 * cy AS rss FROM b)
    SELECT round(b1, 3) AS ate, round(sqrt(rss * n / (n - 4) * inv / n), 4) AS se, round(1 - rss / yy, 8) AS r2, n FROM r"""


@query("ca_regression", sql_with("treatment", OLS))
def _(t):
    out = op.regression_effect(t.treatment, "treated", "outcome", ["balance", "nation"])
    return out.select(F.round("ate", 3).alias("ate"), F.round("se", 4).alias("se"), F.round("r2", 8).alias("r2"), "n")


def _newton(rounds: int) -> str:
    """Newton steps of the penalised logistic regression with two standardised columns, unrolled."""
    ctes = [""", z AS MATERIALIZED (SELECT unit, treated AS t, outcome AS y, (balance - m1) / s1 AS x1, (nation - m2) / s2 AS x2 FROM treatment,
        (SELECT avg(balance) AS m1, stddev_pop(balance) AS s1, avg(nation) AS m2, stddev_pop(nation) AS s2 FROM treatment))""",
            "b0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c)"]
    for i in range(1, rounds + 1):
        ctes.append(f"""p{i} AS (SELECT t, x1, x2, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS p, a, b, c FROM z, b{i - 1}),
            h{i} AS MATERIALIZED (SELECT max(a) AS a, max(b) AS b, max(c) AS c, sum(t - p) AS g0, sum((t - p) * x1) - max(b) AS g1, sum((t - p) * x2) - max(c) AS g2, sum(p * (1 - p)) AS aa,
              sum(p * (1 - p) * x1) AS ab, sum(p * (1 - p) * x2) AS ac, sum(p * (1 - p) * x1 * x1) + 1 AS bb, sum(p * (1 - p) * x1 * x2) AS bc, sum(p * (1 - p) * x2 * x2) + 1 AS cc FROM p{i}),
            b{i} AS MATERIALIZED (SELECT a + (g0 * (bb * cc - bc * bc) - ab * (g1 * cc - bc * g2) + ac * (g1 * bc - bb * g2)) / d AS a, b + (aa * (g1 * cc - g2 * bc) - g0 * (ab * cc - bc * ac) + ac * (ab * g2 - g1 * ac)) / d AS b,
              c + (aa * (bb * g2 - bc * g1) - ab * (ab * g2 - g1 * ac) + g0 * (ab * bc - bb * ac)) / d AS c FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM h{i}))""")
    ctes.append(f"ps AS MATERIALIZED (SELECT unit, t, y, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS raw FROM z, b{rounds})")
    return ", ".join(ctes)


@query("ca_iptw", sql_with("treatment", _newton(6) + """, w AS (SELECT t, y, greatest(0.01, least(0.99, raw)) AS p FROM ps)
    SELECT round(sum(t / p * y) / sum(t / p) - sum((1 - t) / (1 - p) * y) / sum((1 - t) / (1 - p)), 3) AS ate, round(avg(y) FILTER (t = 1) - sum((1 - t) * p / (1 - p) * y) / sum((1 - t) * p / (1 - p)), 3) AS att,
      round(power(sum(t / p), 2) / sum(power(t / p, 2)), 3) AS ess_treated, round(power(sum((1 - t) / (1 - p)), 2) / sum(power((1 - t) / (1 - p), 2)), 3) AS ess_control, round(avg(p), 6) AS propensity_mean FROM w"""))
def _(t):
    out = op.iptw(t.treatment, "treated", "outcome", ["balance", "nation"])
    return rounded(rounded(out, 3, "ate", "att", "ess_treated", "ess_control"), 6, "propensity_mean")


MATCH = """, a AS (SELECT unit, balance AS s, outcome AS y FROM treatment WHERE treated = 1), b AS (SELECT unit, balance AS s, outcome AS y FROM treatment WHERE treated = 0),
    ax AS (SELECT s, min(unit) AS unit FROM a GROUP BY 1), bx AS (SELECT s, min(unit) AS unit FROM b GROUP BY 1),
    ab AS (SELECT ax.s, arg_min(bx.unit, row(abs(bx.s - ax.s), bx.unit)) AS m, min(abs(bx.s - ax.s)) AS d FROM ax CROSS JOIN bx GROUP BY 1),
    ba AS (SELECT bx.s, arg_min(ax.unit, row(abs(ax.s - bx.s), ax.unit)) AS m, min(abs(ax.s - bx.s)) AS d FROM bx CROSS JOIN ax GROUP BY 1),
    e AS (SELECT a.y - b.y AS e, d, 1 AS side FROM a JOIN ab ON a.s = ab.s JOIN b ON b.unit = ab.m UNION ALL SELECT a.y - b.y, d, -1 FROM b JOIN ba ON b.s = ba.s JOIN a ON a.unit = ba.m)
    SELECT round(avg(e) FILTER (side = 1), 4) AS att, round(avg(e), 4) AS ate, round(stddev_samp(e) FILTER (side = 1) / sqrt(count(*) FILTER (side = 1)), 4) AS se,
      round(avg(d) FILTER (side = 1), 6) AS mean_distance, round(max(d) FILTER (side = 1), 6) AS max_distance, count(*) AS n FROM e"""


@query("ca_matching", sql_with("treatment", MATCH))
def _(t):
    out = op.matching(t.treatment, "unit", "treated", "outcome", [], score="balance")
    return rounded(rounded(out, 4, "att", "ate", "se"), 6, "mean_distance", "max_distance")


PS_MATCH = MATCH.replace("balance AS s, outcome AS y FROM treatment WHERE treated", "raw AS s, y FROM ps WHERE t")


@query("ca_matching_propensity", sql_with("treatment", _newton(6) + PS_MATCH))
def _(t):
    out = op.matching(t.treatment, "unit", "treated", "outcome", ["balance", "nation"])
    return rounded(rounded(out, 4, "att", "ate", "se"), 6, "mean_distance", "max_distance")


REPLICATES = 200


def _weights(rows: str) -> str:
    """CTE of (unit, b, w): the rows as they are (b = -1) and every replicate."""
    return f"""w AS MATERIALIZED (SELECT unit, b, {weight_sql('unit', 'b', 7)} AS w FROM {rows}, (SELECT unnest(range({REPLICATES})) AS b) UNION ALL SELECT unit, -1, 1 FROM {rows})"""


INTERVALS = """round(max(e) FILTER (b = -1), 3) AS value, round(quantile_cont(e, 0.025) FILTER (b >= 0), 3) AS lower, round(quantile_cont(e, 0.975) FILTER (b >= 0), 3) AS upper,
    round(stddev_samp(e) FILTER (b >= 0), 3) AS se, round(least(1, 2 * least(avg(CAST(e <= 0 AS INT)) FILTER (b >= 0), avg(CAST(e >= 0 AS INT)) FILTER (b >= 0))), 6) AS p_value"""
EFFECTS = f""", c AS (SELECT avg(outcome) AS y, avg(treated) AS t, avg(balance) AS x, avg(nation) AS z FROM treatment), {_weights('treatment')},
    r AS (SELECT b, w, t.treated AS t0, t.outcome AS y0, t.outcome - c.y AS y, t.treated - c.t AS t, t.balance - c.x AS x, t.nation - c.z AS z, greatest(0.01, least(0.99, raw)) AS p FROM treatment t JOIN w USING (unit) JOIN ps USING (unit), c WHERE w > 0),
    m AS (SELECT b, sum(w * t0 * y0) / sum(w * t0) - sum(w * (1 - t0) * y0) / sum(w * (1 - t0)) AS difference,
      sum(w * t0 / p * y0) / sum(w * t0 / p) - sum(w * (1 - t0) / (1 - p) * y0) / sum(w * (1 - t0) / (1 - p)) AS weighting,
      sum(w) AS n, sum(w * y) AS sy, sum(w * t) AS st, sum(w * x) AS sx, sum(w * z) AS sz, sum(w * t * t) AS tt, sum(w * x * x) AS xx, sum(w * z * z) AS zz, sum(w * t * x) AS tx, sum(w * t * z) AS tz, sum(w * x * z) AS xz,
      sum(w * t * y) AS ty, sum(w * x * y) AS xy, sum(w * z * y) AS zy FROM r GROUP BY b),
    q AS (SELECT b, difference, weighting, tt - st * st / n AS tt, xx - sx * sx / n AS bb, zz - sz * sz / n AS cc, tx - st * sx / n AS tb, tz - st * sz / n AS tc, xz - sx * sz / n AS bc, ty - st * sy / n AS ty, xy - sx * sy / n AS ly, zy - sz * sy / n AS cy FROM m),
    e AS (SELECT b, 'difference' AS estimate, difference AS e FROM q UNION ALL SELECT b, 'weighting', weighting FROM q UNION ALL
      SELECT b, 'regression', (ty * (bb * cc - bc * bc) - tb * (ly * cc - bc * cy) + tc * (ly * bc - bb * cy)) / (tt * (bb * cc - bc * bc) - tb * (tb * cc - bc * tc) + tc * (tb * bc - bb * tc)) FROM q)
    SELECT estimate, {INTERVALS}, count(*) - 1 AS replicates FROM e GROUP BY estimate"""


@query("ca_bootstrap", sql_with("treatment", _newton(6) + EFFECTS))
def _(t):
    out = bootstrap.bootstrap_effects(t.treatment, "unit", "treated", "outcome", ["balance", "nation"], REPLICATES)
    return rounded(rounded(out, 3, "value", "lower", "upper", "se"), 6, "p_value")


@query("ca_sensitivity", sql_with("treatment", DIFF + f""", g AS (SELECT i AS step, 1 + 2.0::DOUBLE * i / 9 AS gamma FROM (SELECT unnest(range(10)) AS i)),
    p AS (SELECT step, round(gamma, 3) AS gamma, round({normal_p('(ate / se + ln(gamma))')}, 6) AS upper_p, round({normal_p('(ate / se - ln(gamma))')}, 6) AS lower_p FROM d, g)
    SELECT CAST(step AS INT) AS step, gamma, upper_p, lower_p, coalesce(step = (SELECT min(step) FROM p WHERE upper_p > 0.05), false) AS critical FROM p"""))
def _(t):
    return op.sensitivity(t.treatment, "treated", "outcome")


DOSE = """, q AS (SELECT unnest(quantile_cont(balance, [""" + ", ".join(f"{i / 10}" for i in range(11)) + """])) AS e FROM treatment), u AS (SELECT DISTINCT e FROM q),
    g AS (SELECT e AS hi, lag(e) OVER (ORDER BY e) AS lo, row_number() OVER (ORDER BY e) - 2 AS bin FROM u),
    r AS (SELECT bin, balance, outcome, nation FROM treatment JOIN g ON lo IS NOT NULL AND balance <= hi AND (balance > lo OR (bin = 0 AND balance = lo)))
    SELECT CAST(bin AS INT) AS bin, round(avg(balance), 4) AS dose, round({m}, 4) AS response, round({m} - 1.96 * sqrt({v} / count(*)), 4) AS lower, round({m} + 1.96 * sqrt({v} / count(*)), 4) AS upper, count(*) AS n FROM r GROUP BY 1"""


@query("ca_dose_response", sql_with("treatment", DOSE.format(m="avg(outcome)", v="var_samp(outcome)")))
def _(t):
    return rounded(op.dose_response(t.treatment, "balance", "outcome"), 4, "dose", "response", "lower", "upper")


@query("ca_dose_response_adjusted", sql_with("treatment", DOSE.format(m="regr_intercept(outcome, nation)", v="(var_samp(outcome) * (1 - regr_r2(outcome, nation)))")))
def _(t):
    return rounded(op.dose_response(t.treatment, "balance", "outcome", ["nation"]), 4, "dose", "response", "lower", "upper")


def hourly(t):
    return pivot_series(t.observations, F.date_trunc("hour", "ts"), VARIABLES, "variable", "value")


@query("ca_granger")
def _(t):
    return op.granger(hourly(t), VARIABLES, [F.col("at")], 5, 0.5)


@query("ca_correlation_graph", sql_with("obs", CORR_CTE + ", c AS (" + " UNION ALL ".join(
    f" SELECT '{a}' AS cause, '{b}' AS effect, abs(corr({a}, {b})) AS strength FROM h" for a, b in PAIRS) + ") SELECT cause, effect, round(strength, 6) AS strength FROM c WHERE strength > 0.01"))
def _(t):
    return rounded(op.correlation_graph(hourly(t), VARIABLES, 0.01), 6, "strength").drop("n")


@query("ca_pc")
def _(t):
    p = t.part.select(F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.col("p_partkey").cast("double").alias("key"))
    return op.pc_skeleton(p, ["price", "size", "key"])


FIT = """, f AS (SELECT regr_slope(error, click) AS s1, regr_intercept(error, click) AS i1 FROM h), w AS (SELECT covar_pop(click, purchase) AS cp, covar_pop(error, purchase) AS ep, covar_pop(click, error) AS ce, var_pop(click) AS cc, var_pop(error) AS ee,
      avg(purchase) AS mp, avg(click) AS mc, avg(error) AS me FROM h WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL),
    x AS (SELECT (cp * ee - ep * ce) / (cc * ee - ce * ce) AS pc, (ep * cc - cp * ce) / (cc * ee - ce * ce) AS pe, mp, mc, me FROM w),
    v AS (SELECT (pv * ss - sv * ps) / (pp * ss - ps * ps) AS vp, (sv * pp - pv * ps) / (pp * ss - ps * ps) AS vs, mv, mpp, mss FROM (SELECT covar_pop(purchase, view) AS pv, covar_pop(signup, view) AS sv,
      covar_pop(purchase, signup) AS ps, var_pop(purchase) AS pp, var_pop(signup) AS ss, avg(view) AS mv, avg(purchase) AS mpp, avg(signup) AS mss FROM h WHERE purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL)),
    y AS (SELECT s1, i1, pc, pe, mp - pc * mc - pe * me AS pi, vp, vs, mv - vp * mpp - vs * mss AS vi FROM f, x, v)"""


@query("ca_structural_fit", sql_with("obs", CORR_CTE + FIT + """ SELECT 'error' AS effect, 'click' AS cause, round(s1, 6) AS slope FROM y UNION ALL SELECT 'error', '', round(i1, 6) FROM y
    UNION ALL SELECT 'purchase', 'click', round(pc, 6) FROM y UNION ALL SELECT 'purchase', 'error', round(pe, 6) FROM y UNION ALL SELECT 'purchase', '', round(pi, 6) FROM y
    UNION ALL SELECT 'view', 'purchase', round(vp, 6) FROM y UNION ALL SELECT 'view', 'signup', round(vs, 6) FROM y UNION ALL SELECT 'view', '', round(vi, 6) FROM y"""))
def _(t):
    return rounded(op.structure_table(t.spark, op.fit_structure(hourly(t), CHAIN)), 6, "slope")


STEP = "vi + vp * (pi + pc * {c} + pe * (i1 + s1 * {c})) + vs * (SELECT avg(signup) FROM h)"


@query("ca_counterfactual", sql_with("obs", CORR_CTE + FIT + f""" SELECT 'view' AS outcome, round((SELECT avg(view) FROM h), 6) AS factual, round({STEP.format(c=80)}, 6) AS counterfactual,
    round({STEP.format(c=80)} - (SELECT avg(view) FROM h), 6) AS effect FROM y"""))
def _(t):
    out = op.counterfactual(t.spark, op.fit_structure(hourly(t), CHAIN), {"click": 80.0}, ["view"])
    return rounded(out, 6, "factual", "counterfactual", "effect")


def _weighted_fit(y: str, a: str, b: str, name: str) -> str:
    """CTE by replicate: slopes of ``y`` on ``a`` and ``b`` and the intercept, over rows where all are present."""
    return f"""{name} AS (SELECT b, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS s1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS s2, my, ma, mb FROM
      (SELECT b, sum(w * {y}) / sum(w) AS my, sum(w * {a}) / sum(w) AS ma, sum(w * {b}) / sum(w) AS mb, sum(w * {a} * {a}) / sum(w) - ma * ma AS aa, sum(w * {b} * {b}) / sum(w) - mb * mb AS bb,
        sum(w * {a} * {b}) / sum(w) - ma * mb AS ab, sum(w * {a} * {y}) / sum(w) - ma * my AS ay, sum(w * {b} * {y}) / sum(w) - mb * my AS yb FROM hw WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY b))"""


COUNTERFACTUAL = f""", u AS (SELECT *, strftime("at", '%Y-%m-%d %H:%M:%S') AS unit FROM h), {_weights('u')}, hw AS (SELECT u.*, b, w FROM u JOIN w USING (unit) WHERE w > 0),
    f1 AS (SELECT b, (ce - mc * me) / (cc - mc * mc) AS s1, mc, me FROM (SELECT b, sum(w * click) / sum(w) AS mc, sum(w * error) / sum(w) AS me, sum(w * click * error) / sum(w) AS ce,
      sum(w * click * click) / sum(w) AS cc FROM hw WHERE click IS NOT NULL AND error IS NOT NULL GROUP BY b)),
    {_weighted_fit('purchase', 'click', 'error', 'f2')}, {_weighted_fit('view', 'purchase', 'signup', 'f3')},
    g AS (SELECT b, sum(w * view) FILTER (view IS NOT NULL) / sum(w) FILTER (view IS NOT NULL) AS mv, sum(w * signup) FILTER (signup IS NOT NULL) / sum(w) FILTER (signup IS NOT NULL) AS ms FROM hw GROUP BY b),
    z AS (SELECT b, mv, f1.me + f1.s1 * (80 - f1.mc) AS error, f2.my + f2.s1 * (80 - f2.ma) + f2.s2 * (f1.me + f1.s1 * (80 - f1.mc) - f2.mb) AS purchase, ms FROM f1 JOIN f2 USING (b) JOIN g USING (b)),
    e AS (SELECT b, z.mv AS factual, f3.my + f3.s1 * (z.purchase - f3.ma) + f3.s2 * (z.ms - f3.mb) AS counterfactual, counterfactual - z.mv AS e FROM z JOIN f3 USING (b))
    SELECT 'view' AS outcome, round(max(factual) FILTER (b = -1), 3) AS factual, round(max(counterfactual) FILTER (b = -1), 3) AS counterfactual, {INTERVALS.replace("AS value", "AS effect")} FROM e"""


@query("ca_counterfactual_interval", sql_with("obs", CORR_CTE.replace("'hour'", "'day'") + COUNTERFACTUAL))
def _(t):
    daily = pivot_series(t.observations, F.date_trunc("day", "ts"), VARIABLES, "variable", "value")
    rows = daily.withColumn("unit", text_ts("at"))
    out = bootstrap.counterfactual_intervals(rows, "unit", CHAIN, {"click": 80.0}, ["view"], REPLICATES)
    return rounded(rounded(out, 3, "factual", "counterfactual", "effect", "lower", "upper", "se"), 6, "p_value")


@query("ca_counterfactual_rows", sql_with("obs", CORR_CTE + FIT + """ SELECT strftime("at", '%Y-%m-%d %H:%M:%S') AS "at", round(view + vp * (pc * (80 - click) + pe * s1 * (80 - click)), 6) AS counterfactual FROM h, y"""))
def _(t):
    rows = hourly(t)
    out = op.counterfactual_rows(rows, op.fit_structure(rows, CHAIN), {"click": F.lit(80.0)}, "view")
    return out.select(text_ts("at").alias("at"), F.round("counterfactual", 6).alias("counterfactual"))


@query("ca_policy_curve", sql_with("obs", CORR_CTE + FIT + f""", l AS (SELECT CAST(unnest([10, 30, 50, 70, 90]) AS DOUBLE) AS level), p AS (SELECT level, {STEP.format(c='level')} AS predicted FROM y, l),
    e AS (SELECT level, predicted, predicted - (SELECT avg(view) FROM h) AS effect FROM p)
    SELECT level, round(predicted, 6) AS predicted, round(effect, 6) AS effect, effect = (SELECT max(effect) FROM e) AS best FROM e"""))
def _(t):
    out = op.policy_curve(t.spark, op.fit_structure(hourly(t), CHAIN), "click", [10.0, 30.0, 50.0, 70.0, 90.0], "view")
    return rounded(out, 6, "predicted", "effect")


def _outcome(subset: str) -> str:
    """View after setting a subset of click (c), error (e) and signup (s)."""
    click = "80" if "c" in subset else "(SELECT avg(click) FROM h)"
    error = "20" if "e" in subset else f"(i1 + s1 * {click})"
    signup = "60" if "s" in subset else "(SELECT avg(signup) FROM h)"
    return f"(vi + vp * (pi + pc * {click} + pe * {error}) + vs * {signup})"


def _share(own: str, a: str, b: str) -> str:
    """Shapley value of one of three factors from the outcomes of all subsets."""
    steps = [(1 / 3, ""), (1 / 6, a), (1 / 6, b), (1 / 3, a + b)]
    return " + ".join(f"{w!r}::DOUBLE * ({_outcome(own + s)} - {_outcome(s)})" for w, s in steps)


@query("ca_shapley", sql_with("obs", CORR_CTE + FIT + f""", sv AS (SELECT 'click' AS factor, {_share('c', 'e', 's')} AS value FROM y UNION ALL SELECT 'error', {_share('e', 'c', 's')} FROM y UNION ALL SELECT 'signup', {_share('s', 'c', 'e')} FROM y)
    SELECT factor, round(value, 6) AS value, round(abs(value) / (SELECT sum(abs(value)) FROM sv), 6) AS share, CAST(row_number() OVER (ORDER BY abs(value) DESC) AS INT) AS rank FROM sv"""))
def _(t):
    model = op.fit_structure(hourly(t), CHAIN)
    return rounded(op.shapley(t.spark, model, {"click": 80.0, "error": 20.0, "signup": 60.0}, "view"), 6, "value", "share")


@query("ca_far", sql_with("obs", """, e AS (SELECT variable, value FROM obs WHERE ts >= TIMESTAMP '2024-01-25'), b AS (SELECT variable, value FROM obs WHERE ts < TIMESTAMP '2024-01-25'),
    m AS (SELECT variable, avg(value) AS em FROM e GROUP BY 1), x AS (SELECT b.variable, avg(value) AS bm, stddev_samp(value) AS s, avg(CASE WHEN value >= em THEN 1 ELSE 0 END) AS p0 FROM b JOIN m ON b.variable = m.variable GROUP BY 1),
    y AS (SELECT e.variable, avg(CASE WHEN value >= em THEN 1 ELSE 0 END) AS p1 FROM e JOIN m ON e.variable = m.variable GROUP BY 1)
    SELECT m.variable, round(em, 4) AS event_mean, round(bm, 4) AS baseline_mean, round((em - bm) / s, 4) AS z, round(p0, 6) AS p_baseline, round(p1, 6) AS p_current, round(greatest(0, least(1, 1 - p0 / p1)), 6) AS far
    FROM m JOIN x ON m.variable = x.variable JOIN y ON m.variable = y.variable"""))
def _(t):
    cut = F.lit("2024-01-25").cast("timestamp")
    out = op.attributable_risk(t.observations.where(F.col("ts") >= cut), t.observations.where(F.col("ts") < cut), "variable", "value")
    return rounded(rounded(out, 4, "event_mean", "baseline_mean", "z"), 6, "p_baseline", "p_current", "far")


def exact_round(x: str, digits: int) -> str:
    """Half-up rounding of a double's shortest decimal form, as Spark does it."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


@query("ca_impact_chain", f"""WITH r AS (SELECT event_id, value / 17 AS w, [1.2, 1.0, 1.8, 0.9, 1.0][CAST(user_id % 5 + 1 AS INT)]::DOUBLE AS f FROM events),
    a AS (SELECT event_id, f, {exact_round('w * 0.72::DOUBLE * f', 4)} AS sea_level, {exact_round('w * 0.8::DOUBLE * f', 4)} AS heat, {exact_round('w * -0.78::DOUBLE * f', 4)} AS glacier, {exact_round('w * 0.45::DOUBLE * f', 4)} AS rain FROM r),
    b AS (SELECT *, {exact_round('heat * 0.65::DOUBLE * f', 4)} AS mortality, {exact_round('glacier * -0.6::DOUBLE * f', 4)} AS river, {exact_round('rain * 0.75::DOUBLE * f', 4)} AS soil FROM a)
    SELECT event_id, sea_level, mortality, river, {exact_round('soil * 0.7::DOUBLE * f', 4)} AS crop FROM b""")
def _(t):
    region = F.element_at(F.array(*[F.lit(r) for r in ("Tropical", "temperate", "arctic", "arid", "elsewhere")]), (F.col("user_id") % 5 + 1).cast("int"))
    rows = t.events.select("event_id", (F.col("value") / 17).alias("warming"), region.alias("region"))
    i = F.col("impacts")
    return op.impact_chain(rows, "warming", "region").select(
        "event_id", i["sea_level"].alias("sea_level"), i["mortality_rate"].alias("mortality"), i["river_flow"].alias("river"), i["crop_yield"].alias("crop")
    )


@query("ca_deforestation", f"""WITH a AS (SELECT p_partkey, p_retailprice * 3 AS area, CASE p_partkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.2 ELSE 0.15 END::DOUBLE AS z, CASE p_partkey % 3 WHEN 0 THEN 15000 WHEN 1 THEN 8000 ELSE 6000 END::DOUBLE AS carbon FROM part)
    SELECT p_partkey, {exact_round('(1 - power(greatest(0, 1 - area / 10000), z))', 4)} AS species_loss, {exact_round('(area * carbon * 3.667::DOUBLE)', 0)} AS co2_tonnes, {exact_round('least(1, area / 10000 * 3)', 4)} AS erosion FROM a""")
def _(t):
    kind = F.element_at(F.array(F.lit("tropical"), F.lit("Temperate"), F.lit("boreal")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = t.part.select("p_partkey", (F.col("p_retailprice") * 3).alias("area"), kind.alias("forest"))
    return op.deforestation(rows, "area", "forest").select("p_partkey", "species_loss", "co2_tonnes", "erosion")


@query("ca_health_burden", """WITH r AS (SELECT event_id, 10000 + user_id * 137 AS people, value AS pm, value * 1.5 AS o3, event_id % 11 / 10 AS w FROM events), s AS (SELECT *, greatest(0, pm - 5) AS x, power(1.062, greatest(0, pm - 5) / 10) AS rr FROM r),
    d AS (SELECT event_id, CAST(trunc((rr - 1) / rr * (people * 0.008)) AS BIGINT) AS deaths, CAST(trunc(least(0.15, x / 100 * 0.10) * people) + trunc(least(0.10, x / 100 * 0.05) * people) + trunc(least(0.05, greatest(0, o3 - 50) / 100 * 0.02) * people)
      + trunc(least(0.05, w * 0.05) * people) AS BIGINT) AS cases FROM s) SELECT event_id, deaths, cases, round(deaths * 12.0::DOUBLE + cases * 0.5::DOUBLE, 0) AS daly FROM d""")
def _(t):
    rows = t.events.select(
        "event_id", (10000 + F.col("user_id") * 137).alias("people"), F.col("value").alias("pm"), (F.col("value") * 1.5).alias("o3"), (F.col("event_id") % 11 / 10).alias("w")
    )
    return op.health_burden(rows, "people", "pm", "o3", "w").select("event_id", "deaths", "cases", "daly")

"""Causal and statistical estimates.

One pattern throughout: Spark reduces the rows to small sufficient statistics
(counts, means, centred cross products), and the driver solves the p × p
problem that is left. No row reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.stats import f_upper_p, norm_cdf, t_p_driver, two_sided_normal_p
from fieldloom.operators.joins import join_nearest
from fieldloom.operators.scale import quantiles
from fieldloom.operators.windows import lags
from fieldloom.session import checkpointed

# ---- sufficient statistics ------------------------------------------------------


@dataclass
class Moments:
    """Count, means and centred cross products of some columns over the rows where all are present."""

    columns: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def pick(self, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        i = [self.columns.index(c) for c in names]
        return self.mean[i], self.cross[np.ix_(i, i)]

    def regress(self, y: str, xs: Sequence[str]) -> tuple[np.ndarray, float, float, np.ndarray]:
        """Least squares with intercept: (slopes, intercept, residual sum of squares, inverse of the x cross products)."""
        mean, cross = self.pick([y, *xs])
        inverse = np.linalg.pinv(cross[1:, 1:])
        slopes = inverse @ cross[1:, 0]
        rss = float(cross[0, 0] - cross[1:, 0] @ slopes)
        return slopes, float(mean[0] - slopes @ mean[1:]), max(rss, 0.0), inverse


def moments(df: DataFrame, samples: dict[str, Sequence[str]]) -> dict[str, Moments]:
    """Moments of several column sets, each over its own complete rows, in two passes.

    The first pass takes the means. In the second each Arrow batch becomes one
    small matrix product per set, centred at those means so nothing cancels,
    and only those products are shuffled.
    """
    every = sorted({c for cols in samples.values() for c in cols})
    doubles = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in every])
    centre_row = doubles.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in every]).first()
    centre = {c: centre_row[c] for c in every}
    sets = {name: list(cols) for name, cols in samples.items()}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {name: np.zeros((len(cols) + 1, len(cols) + 1)) for name, cols in sets.items()}
        for pdf in frames:
            for name, cols in sets.items():
                x = pdf[cols].to_numpy(dtype=np.float64) - np.array([centre[c] for c in cols])
                x = x[~np.isnan(x).any(axis=1)]
                one = np.hstack([np.ones((len(x), 1)), x])
                totals[name] += one.T @ one
        out = []
        for name, m in totals.items():
            i, j = np.indices(m.shape)
            out.append(pd.DataFrame({"name": name, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()}))
        yield pd.concat(out)

    sums = doubles.mapInPandas(partial, "name string, i int, j int, v double").groupBy("name", "i", "j").agg(F.sum("v").alias("v")).collect()
    raw = {name: np.zeros((len(cols) + 1, len(cols) + 1)) for name, cols in sets.items()}
    for r in sums:
        raw[r["name"]][r["i"], r["j"]] = r["v"]
    out = {}
    for name, cols in sets.items():
        n = raw[name][0, 0]
        shift = raw[name][0, 1:] / n if n else raw[name][0, 1:]
        cross = raw[name][1:, 1:] - n * np.outer(shift, shift)
        out[name] = Moments(cols, n, np.array([centre[c] for c in cols]) + shift, cross)
    return out


# ---- treatment effects --------------------------------------------------------------


def diff_means(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """ATE as a difference of means with Welch's error, 95 % interval and two-sided normal p; one aggregate."""
    y, t = F.col(outcome), F.col(treatment)
    one, zero = F.when(t == 1, y), F.when(t == 0, y)
    sums = df.where(t.isNotNull() & y.isNotNull()).agg(
        (F.avg(one) - F.avg(zero)).alias("ate"),
        F.sqrt(F.var_samp(one) / F.count(one) + F.var_samp(zero) / F.count(zero)).alias("se"), F.count(F.lit(1)).alias("n"),
    )
    ate, se = F.col("ate"), F.col("se")
    return sums.withColumn("lower", ate - 1.96 * se).withColumn("upper", ate + 1.96 * se).withColumn(
        "p_value", F.when(se > 0, two_sided_normal_p(ate / F.nullif(se, F.lit(0.0)))).otherwise(1.0)
    )


def regression_effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """Coefficient of the treatment with its error (intercept included), interval and R².

    Scaling the confounders does not change the treatment's coefficient, so it is not done.
    """
    m = moments(df, {"all": [outcome, treatment, *confounders]})["all"]
    slopes, _, rss, inverse = m.regress(outcome, [treatment, *confounders])
    k = 1 + len(confounders)
    total = float(m.pick([outcome])[1][0, 0])
    se = math.sqrt(rss / (m.n - k - 1) * inverse[0, 0]) if m.n > k + 1 else 0.0
    row = (float(slopes[0]), se, float(slopes[0] - 1.96 * se), float(slopes[0] + 1.96 * se), 1 - rss / total if total else 0.0, int(m.n))
    return df.sparkSession.createDataFrame([row], "ate double, se double, lower double, upper double, r2 double, n long")


def propensity(
    df: DataFrame, treatment: str, confounders: Sequence[str], name: str = "propensity", rounds: int = 25, tolerance: float = 1e-10
) -> tuple[DataFrame, np.ndarray]:
    """Logistic propensity score by Newton steps; ridge penalty ½‖w‖² on standardised confounders, none on the intercept.

    A step is one aggregate (gradient and Hessian sums, p(p+3)/2 numbers) and a p × p solve.
    """
    scale = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(confounders) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    xs: list[Column] = [F.lit(1.0)]
    for i, c in enumerate(confounders):
        xs.append((F.col(c) - F.lit(scale[f"m{i}"])) / F.lit(scale[f"s{i}"] or 1.0))
    beta = np.zeros(len(xs))
    # every step reads these columns again, so they are computed once
    scaled = checkpointed(df.select(F.col(treatment).cast("double").alias("_t"), *[x.alias(f"_x{i}") for i, x in enumerate(xs)]))
    penalty = np.diag([0.0] + [1.0] * len(confounders))

    def logit(b: np.ndarray, columns: list[Column]) -> Column:
        z = None
        for w, x in zip(b, columns):
            z = F.lit(float(w)) * x if z is None else z + F.lit(float(w)) * x
        return 1 / (1 + F.exp(-z))

    cols = [F.col(f"_x{i}") for i in range(len(xs))]
    for _ in range(rounds):
        step = scaled.withColumn("_p", logit(beta, cols)).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        aggs = [F.sum((F.col("_t") - F.col("_p")) * x).alias(f"g{i}") for i, x in enumerate(cols)]
        aggs += [F.sum(F.col("_w") * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
        r = step.agg(*aggs).first()
        grad = np.array([r[f"g{i}"] for i in range(len(cols))]) - penalty @ beta
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))]) + penalty
        delta = np.linalg.solve(hess, grad)
        beta = beta + delta
        if np.abs(delta).max() < tolerance:
            return df.withColumn(name, logit(beta, xs)), beta
    raise ArithmeticError(f"the propensity score did not converge in {rounds} rounds")


def iptw(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """Inverse propensity weighting (scores kept within 0.01..0.99): ATE, ATT, effective sample sizes."""
    scored, _ = propensity(df, treatment, confounders)
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("propensity")))
    t, y = F.col(treatment), F.col(outcome)
    w1, w0 = t / F.col("_p"), (1 - t) / (1 - F.col("_p"))
    odds = (1 - t) * F.col("_p") / (1 - F.col("_p"))
    return scored.withColumn("_p", p).agg(
        (F.sum(w1 * y) / F.sum(w1) - F.sum(w0 * y) / F.sum(w0)).alias("ate"),
        (F.avg(F.when(t == 1, y)) - F.sum(odds * y) / F.sum(odds)).alias("att"),
        (F.sum(w1) * F.sum(w1) / F.sum(w1 * w1)).alias("ess_treated"), (F.sum(w0) * F.sum(w0) / F.sum(w0 * w0)).alias("ess_control"),
        F.avg("_p").alias("propensity_mean"),
    )


def matching(df: DataFrame, unit: str, treatment: str, outcome: str, confounders: Sequence[str], score: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """1-nearest-neighbour matching on the propensity score, both ways: ATT, ATE, error and distances.

    ``score`` names a column to match on instead of a fitted score.
    """
    scored = df.withColumn("_score", F.col(score)) if score else propensity(df, treatment, confounders, "_score")[0]
    # four narrow columns, written once: both directions read them several times
    rows = checkpointed(scored.select(F.col(unit).alias("_u"), F.col(treatment).alias("_t"), F.col(outcome).alias("_y"), "_score"))
    treated, control = rows.where("_t = 1"), rows.where("_t = 0")

    def effects(own: DataFrame, other: DataFrame, sign: int) -> DataFrame:
        pairs = join_nearest(own, other.withColumnRenamed("_u", "_m"), "_u", "_m", "_score", hot_rows)
        mine = own.select("_u", "_y")
        theirs = other.select(F.col("_u").alias("_m"), F.col("_y").alias("_ym"))
        return pairs.join(mine, "_u").join(theirs, "_m").select((sign * (F.col("_y") - F.col("_ym"))).alias("e"), "distance", F.lit(sign).alias("side"))

    both = effects(treated, control, 1).unionByName(effects(control, treated, -1))
    first = F.when(F.col("side") == 1, F.col("e"))
    return both.agg(
        F.avg(first).alias("att"), F.avg("e").alias("ate"), (F.stddev_samp(first) / F.sqrt(F.count(first))).alias("se"),
        F.avg(F.when(F.col("side") == 1, F.col("distance"))).alias("mean_distance"),
        F.max(F.when(F.col("side") == 1, F.col("distance"))).alias("max_distance"), F.count(F.lit(1)).alias("n"),
    )


def sensitivity(df: DataFrame, treatment: str, outcome: str, low: float = 1.0, high: float = 3.0, steps: int = 10) -> DataFrame:
    """Bounds under hidden bias Γ: two-sided p when the statistic is moved by ±ln Γ·se.

    ``critical`` marks the first Γ whose upper p exceeds 0.05.
    """
    base = diff_means(df, treatment, outcome).select("ate", "se")
    gammas = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    rows = base.select("ate", "se", F.posexplode(F.array(*[F.lit(g) for g in gammas])).alias("step", "gamma"))
    z, shift = F.coalesce(F.try_divide("ate", "se"), F.lit(0.0)), F.log("gamma")
    shift = F.when(F.col("se") > 0, shift).otherwise(0.0)
    out = rows.select(
        "step", F.round("gamma", 3).alias("gamma"), F.round(two_sided_normal_p(z + shift), 6).alias("upper_p"), F.round(two_sided_normal_p(z - shift), 6).alias("lower_p")
    )
    first = out.where("upper_p > 0.05").agg(F.min("step")).scalar()
    return out.withColumn("critical", F.coalesce(F.col("step") == first, F.lit(False)))


def dose_response(
    df: DataFrame, dose: str, outcome: str, confounders: Sequence[str] = (), bins: int = 10, hot_rows: int | None = None
) -> DataFrame:
    """Per quantile bin of the dose: mean dose, (adjusted) mean response, ±1.96 se, count.

    ``bins`` quantile bins whatever the number of rows; equal edges are merged, bins without rows and empty input give none. With confounders the response of a bin is the
    intercept of its own regression, its spread that of the residuals.
    """
    clean = df.select(dose, outcome, *confounders).na.drop()
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edge_row = quantiles(clean, [], dose, probs, hot_rows).first()
    edges = sorted({edge_row[k] for k in probs if edge_row is not None and edge_row[k] is not None})
    if not edges:
        return df.sparkSession.createDataFrame([], "bin int, dose double, response double, lower double, upper double, n long")
    index = F.lit(len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        index = F.when(F.col(dose) <= edges[i + 1], i).otherwise(index)
    y = F.col(outcome)
    aggs = [F.avg(dose).alias("dose"), F.avg(y).alias("response"), F.var_samp(y).alias("_var"), F.count(F.lit(1)).alias("n")]
    k = len(confounders)
    for i, c in enumerate(confounders):
        aggs += [F.avg(c).alias(f"m{i}"), F.covar_pop(c, y).alias(f"y{i}")]
        aggs += [F.covar_pop(c, confounders[j]).alias(f"x{i}_{j}") for j in range(i, k)]
    rows = clean.groupBy(index.alias("bin")).agg(*aggs).collect()
    out = []
    for r in rows:
        mean, var = r["response"], r["_var"] or 0.0
        if k and r["n"] > k + 1:
            xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            xy = np.array([r[f"y{i}"] for i in range(k)])
            slopes = np.linalg.pinv(xx) @ xy
            mean = mean - float(slopes @ np.array([r[f"m{i}"] for i in range(k)]))
            var = max(var - float(slopes @ xy) * r["n"] / (r["n"] - 1), 0.0)
        se = math.sqrt(var / r["n"])
        out.append((r["bin"], r["dose"], float(mean), float(mean - 1.96 * se), float(mean + 1.96 * se), r["n"]))
    return df.sparkSession.createDataFrame(out, "bin int, dose double, response double, lower double, upper double, n long")


# ---- structure ---------------------------------------------------------------------------

EDGE = "cause string, effect string, strength double, confidence double, lag int"


def granger(df: DataFrame, variables: Sequence[str], order: Sequence[Column], max_lag: int = 5, alpha: float = 0.05, hot_rows: int | None = None) -> DataFrame:
    """Ordered pairs where lags of one variable help to predict another: F of the best lag, 1 − p, lag.

    Rows with a null are dropped first. One ordered pass adds the lags, one pass
    over it gives the cross products of every lag depth.
    """
    spark = df.sparkSession
    clean = df.na.drop(subset=list(variables))
    # read twice, for the means and for the cross products
    lagged = checkpointed(lags(clean, [], order, variables, max_lag, hot_rows))
    samples = {str(l): [*variables, *[f"{v}_lag{i}" for v in variables for i in range(1, l + 1)]] for l in range(1, max_lag + 1)}
    by_lag = moments(lagged, samples)
    edges = []
    for cause, effect in permutations(variables, 2):
        best = (1.0, 0, 0.0)
        for lag in range(1, max_lag + 1):
            m = by_lag[str(lag)]
            own = [f"{effect}_lag{i}" for i in range(1, lag + 1)]
            full = own + [f"{cause}_lag{i}" for i in range(1, lag + 1)]
            df2 = m.n - (2 * lag + 1)
            if m.n < 2 * lag + 2 or df2 <= 0:
                continue
            rss_r, rss_f = m.regress(effect, own)[2], m.regress(effect, full)[2]
            if rss_f <= 0:
                continue
            f = ((rss_r - rss_f) / lag) / (rss_f / df2)
            p = f_upper_p(spark, f, lag, df2)
            if p < best[0]:
                best = (p, lag, f)
        if best[0] < alpha:
            edges.append((cause, effect, round(float(best[2]), 4), round(float(1 - best[0]), 6), best[1]))
    return spark.createDataFrame(edges, EDGE)


def correlation_graph(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Edges a -> b (a before b) with |r| above the threshold."""
    from fieldloom.operators.aggregates import correlations

    return correlations(df, columns).where(F.abs("r") > threshold).select(F.col("a").alias("cause"), F.col("b").alias("effect"), F.abs("r").alias("strength"), "n")


def pc_skeleton(df: DataFrame, variables: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Edges left after conditional-independence tests with growing conditioning sets; not oriented (a before b).

    The tests need second moments only. As in the definition, the conditioning
    regressions have no intercept and the residuals are then correlated.
    """
    spark = df.sparkSession
    m = moments(df, {"all": list(variables)})["all"]
    k, n = len(variables), m.n
    total = m.mean * n
    raw = m.cross + n * np.outer(m.mean, m.mean)

    def p_value(i: int, j: int, given: Sequence[int]) -> float:
        g = list(given)

        def residual(a: int) -> tuple[np.ndarray, float]:
            w = np.zeros(k)
            w[a] = 1.0
            if g:
                w[g] = -(np.linalg.pinv(raw[np.ix_(g, g)]) @ raw[g, a])
            return w, float(w @ total)

        (wi, si), (wj, sj) = residual(i), residual(j)
        cij, cii, cjj = wi @ raw @ wj - si * sj / n, wi @ raw @ wi - si * si / n, wj @ raw @ wj - sj * sj / n
        if cii <= 0 or cjj <= 0:
            return 1.0
        r = float(np.clip(cij / math.sqrt(cii * cjj), -1.0, 1.0))
        if abs(r) >= 1.0:
            return 0.0
        return t_p_driver(spark, r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    # order-independent form: a depth's tests all use the neighbours that the depth began with
    edges = {frozenset(pair) for pair in combinations(range(k), 2)}
    depth = 0
    while True:
        near = {v: {w for e in edges if v in e for w in e if w != v} for v in range(k)}
        tests = {e: [(v, s) for v in sorted(e) for s in combinations(sorted(near[v] - e), depth)] for e in edges}
        if not any(tests.values()):
            break
        edges -= {e for e, sets in tests.items() if any(p_value(*sorted(e), s) > alpha for _, s in sets)}
        depth += 1
    linked = np.array([[frozenset((i, j)) in edges for j in range(k)] for i in range(k)])
    std = np.sqrt(np.diag(m.cross))
    rows = [
        (variables[i], variables[j], round(abs(float(m.cross[i, j] / (std[i] * std[j]))), 4), round(1 - alpha, 4), 0)
        for i, j in combinations(range(k), 2) if linked[i, j]
    ]
    return spark.createDataFrame(rows, EDGE)


@dataclass
class StructuralModel:
    """Linear equations of variables on their causes, with the means of all variables."""

    edges: list[tuple[str, str]]
    mean: dict[str, float]
    equations: dict[str, tuple[list[str], np.ndarray, float]]

    def order(self) -> list[str]:
        """Causes before effects; a cycle is an error."""
        graph = {v: set() for v in sorted({v for e in self.edges for v in e} | set(self.mean))}
        for a, b in sorted(self.edges):
            graph[b].add(a)
        return list(TopologicalSorter(graph).static_order())

    def propagate(self, interventions: dict[str, float]) -> dict[str, float]:
        """Mean of every variable after setting some: causes first, each by its equation."""
        values = dict(interventions)
        for v in self.order():
            if v in values:
                continue
            if v in self.equations:
                parents, slopes, intercept = self.equations[v]
                values[v] = intercept + float(sum(s * values.get(p, self.mean.get(p, 0.0)) for s, p in zip(slopes, parents)))
            else:
                values[v] = self.mean.get(v, 0.0)
        return values


def fit_structure(df: DataFrame, edges: Sequence[tuple[str, str]]) -> StructuralModel:
    """Least-squares equation of every variable that has causes, from one pass of moments."""
    names = sorted({v for e in edges for v in e})
    samples: dict[str, list[str]] = {f"mean:{v}": [v] for v in names}
    for v in names:
        parents = [a for a, b in edges if b == v]
        if parents:
            samples[f"fit:{v}"] = [v, *parents]
    return structure_from(moments(df, samples), edges)


def structure_from(found: dict[str, Moments], edges: Sequence[tuple[str, str]]) -> StructuralModel:
    """The model that moments give: ``mean:v`` for every variable, ``fit:v`` for those with causes."""
    names = sorted({v for e in edges for v in e})
    equations = {}
    for v in names:
        parents = [a for a, b in edges if b == v]
        m = found.get(f"fit:{v}")
        if m is not None and m.n >= len(parents) + 2:
            slopes, intercept, _, _ = m.regress(v, parents)
            equations[v] = (parents, slopes, intercept)
    return StructuralModel(list(edges), {v: float(found[f"mean:{v}"].mean[0]) for v in names}, equations)


def structure_table(spark: SparkSession, model: StructuralModel) -> DataFrame:
    """(effect, cause, slope) rows; the intercept has an empty cause."""
    rows = []
    for v, (parents, slopes, intercept) in model.equations.items():
        rows += [(v, p, float(s)) for p, s in zip(parents, slopes)] + [(v, "", float(intercept))]
    return spark.createDataFrame(rows, "effect string, cause string, slope double")


def counterfactual(spark: SparkSession, model: StructuralModel, interventions: dict[str, float], outcomes: Sequence[str]) -> DataFrame:
    """(outcome, factual, counterfactual, effect) of setting the intervened variables."""
    values = model.propagate(interventions)
    rows = [(o, model.mean[o], float(values[o]), float(values[o] - model.mean[o])) for o in outcomes]
    return spark.createDataFrame(rows, "outcome string, factual double, counterfactual double, effect double")


def counterfactual_rows(df: DataFrame, model: StructuralModel, interventions: dict[str, Column], outcome: str) -> DataFrame:
    """Per row: set the intervened variables and let every equation act on the row's own values, as column expressions."""
    shifts: dict[str, Column] = {v: c - F.col(v) for v, c in interventions.items()}
    for v in model.order():
        if v in shifts or v not in model.equations:
            continue
        parents, slopes, _ = model.equations[v]
        moved = [F.lit(float(s)) * shifts[p] for s, p in zip(slopes, parents) if p in shifts]
        if moved:
            total = moved[0]
            for m in moved[1:]:
                total = total + m
            shifts[v] = total
    if outcome in interventions:
        return df.withColumn("counterfactual", interventions[outcome])
    return df.withColumn("counterfactual", F.col(outcome) + shifts[outcome] if outcome in shifts else F.col(outcome))


def policy_curve(spark: SparkSession, model: StructuralModel, variable: str, levels: Sequence[float], outcome: str) -> DataFrame:
    """(level, predicted, effect, best): outcome for each level of a policy variable; the first largest effect is best."""
    effects = [float(model.propagate({variable: x})[outcome] - model.mean[outcome]) for x in levels]
    best = int(np.argmax(effects)) if effects else -1
    rows = [(float(x), model.mean[outcome] + e, e, i == best) for i, (x, e) in enumerate(zip(levels, effects))]
    return spark.createDataFrame(rows, "level double, predicted double, effect double, best boolean")


def shapley(spark: SparkSession, model: StructuralModel, targets: dict[str, float], outcome: str, samples: int | None = None, seed: int = 7) -> DataFrame:
    """(factor, value, share, rank): contributions of moving each factor to its target, averaged over all orders.

    Exact: each subset of the other factors counts with the share of orders that put it first. With ``samples`` the
    average is over so many random orders instead, for more factors than 2^n outcomes allow.
    """
    factors = list(targets)
    known: dict[frozenset, float] = {}

    def outcome_of(subset: frozenset) -> float:
        if subset not in known:
            known[subset] = model.propagate({f: targets[f] for f in subset})[outcome]
        return known[subset]

    n, sums, count = len(factors), dict.fromkeys(factors, 0.0), 1
    if samples is None:
        for f in factors:
            others = [g for g in factors if g != f]
            for size in range(n):
                share = 1 / (n * math.comb(n - 1, size))
                sums[f] += share * sum(outcome_of(frozenset(s) | {f}) - outcome_of(frozenset(s)) for s in combinations(others, size))
    else:
        rng, count = np.random.default_rng(seed), samples
        for _ in range(samples):
            have: frozenset = frozenset()
            for f in rng.permutation(factors).tolist():
                sums[f] += outcome_of(have | {f}) - outcome_of(have)
                have = have | {f}
    values = {f: s / count for f, s in sums.items()}
    total = sum(abs(v) for v in values.values())
    ranked = sorted(factors, key=lambda f: -abs(values[f]))
    rows = [(f, float(values[f]), abs(values[f]) / total if total else 0.0, i + 1) for i, f in enumerate(ranked)]
    return spark.createDataFrame(rows, "factor string, value double, share double, rank int")


# ---- environmental models -------------------------------------------------------------------


def attributable_risk(event: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """Per variable: means, z, P(value ≥ event mean) in both samples, and the attributable fraction within 0..1."""
    e = event.groupBy(key).agg(F.avg(value).alias("event_mean"))
    b = baseline.groupBy(key).agg(F.avg(value).alias("baseline_mean"), F.coalesce(F.stddev_samp(value), F.lit(1.0)).alias("_s"))

    def share(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(value).isNotNull()).join(e, key).groupBy(key).agg(F.avg((F.col(value) >= F.col("event_mean")).cast("double")).alias(name))

    out = e.join(b, key).join(share(baseline, "p_baseline"), key).join(share(event, "p_current"), key).where("_s > 0")
    far = F.coalesce(1 - F.try_divide("p_baseline", "p_current"), F.lit(0.0))
    return out.select(
        key, "event_mean", "baseline_mean", ((F.col("event_mean") - F.col("baseline_mean")) / F.col("_s")).alias("z"), "p_baseline", "p_current",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), far)).alias("far"),
    )


# fixed values: expert edges (cause, effect, strength)
CLIMATE_EDGES = [
    ("co2_concentration", "global_temperature", 0.85),
    ("global_temperature", "sea_level", 0.72),
    ("global_temperature", "heat_wave_frequency", 0.80),
    ("heat_wave_frequency", "mortality_rate", 0.65),
    ("global_temperature", "glacial_mass", -0.78),
    ("glacial_mass", "river_flow", -0.60),
    ("precipitation", "soil_moisture", 0.75),
    ("soil_moisture", "crop_yield", 0.70),
    ("global_temperature", "precipitation", 0.45),
    ("co2_concentration", "ocean_ph", -0.80),
    ("ocean_ph", "coral_coverage", 0.70),
    ("global_temperature", "coral_coverage", -0.60),
]
# fixed values: regional factor
REGION_FACTOR = {"tropical": 1.2, "temperate": 1.0, "arctic": 1.8, "arid": 0.9, "global": 1.0}


def impact_chain(df: DataFrame, warming: str, region: str, start: str = "global_temperature") -> DataFrame:
    """Rows with ``impacts``: change of every variable downstream of a warming, as a map.

    The walk over the fixed edges is the same for every row, so it becomes one
    chain of expressions: parent × strength × regional factor, rounded to 4
    digits at each step, the first edge to reach a variable counting.
    """
    pairs = [x for k, v in REGION_FACTOR.items() for x in (F.lit(k), F.lit(v))]
    factor = F.coalesce(F.element_at(F.create_map(*pairs), F.lower(region)), F.lit(1.0))
    df = df.withColumn("_factor", factor).withColumn(f"_i_{start}", F.col(warming).cast("double"))
    reached, queue = [start], [start]
    while queue:
        level, queue = queue, []
        new: dict[str, Column] = {}
        for current in level:
            for cause, effect, strength in CLIMATE_EDGES:
                if cause == current and effect not in reached:
                    new[f"_i_{effect}"] = F.round(F.col(f"_i_{cause}") * strength * F.col("_factor"), 4)
                    reached.append(effect)
                    queue.append(effect)
        if new:
            df = df.withColumns(new)
    impacts = F.create_map(*[x for v in reached for x in (F.lit(v), F.col(f"_i_{v}"))])
    return df.withColumn("impacts", impacts).drop("_factor", *[f"_i_{v}" for v in reached])


# fixed values: forest type -> (species-area exponent, species density, tonnes of carbon a km²)
FORESTS = {"tropical": (0.25, 200.0, 15000.0), "temperate": (0.20, 80.0, 8000.0), "boreal": (0.15, 40.0, 6000.0)}
BASE_AREA_KM2 = 10000.0  # fixed value: reference area
CARBON_TO_CO2 = 3.667  # fixed value


def deforestation(df: DataFrame, area: str, forest: str) -> DataFrame:
    """Species loss by the species-area relation, carbon, erosion and water quality of a cleared area."""

    def of(i: int) -> Column:
        out = F.lit(FORESTS["tropical"][i])
        for name, values in FORESTS.items():
            out = F.when(F.lower(forest) == name, F.lit(values[i])).otherwise(out)
        return out

    left = F.greatest(F.lit(0.0), 1 - F.col(area) / BASE_AREA_KM2)
    loss = 1 - F.when(left > 0, F.pow(left, of(0))).otherwise(0.0)
    erosion = F.least(F.lit(1.0), F.col(area) / BASE_AREA_KM2 * 3)
    return df.select(
        "*", F.round(loss, 4).alias("species_loss"), F.round(loss * of(1) * (BASE_AREA_KM2 / 100), 0).alias("species_at_risk"),
        F.round(F.col(area) * of(2) * CARBON_TO_CO2, 0).alias("co2_tonnes"), F.round(erosion, 4).alias("erosion"), F.round(erosion * 0.65, 4).alias("water_quality_loss"),
    )


def health_burden(df: DataFrame, population: str, pm25: str, ozone: str, water: str) -> DataFrame:
    """Deaths and cases a year attributable to fine particles, ozone and water pollution; parts are cut to whole numbers."""
    people = F.col(population)
    over = F.greatest(F.lit(0.0), F.coalesce(F.col(pm25), F.lit(0.0)) - 5.0)
    rr = F.pow(F.lit(1.062), over / 10)  # fixed value: relative risk per 10 µg/m³

    def whole(x: Column) -> Column:
        return x.cast("long")

    deaths = whole((rr - 1) / rr * (people * 0.008))
    respiratory = whole(F.least(F.lit(0.15), over / 100 * 0.10) * people)
    cardiac = whole(F.least(F.lit(0.10), over / 100 * 0.05) * people)
    high_ozone = F.greatest(F.lit(0.0), F.coalesce(F.col(ozone), F.lit(0.0)) - 50.0)
    asthma = whole(F.least(F.lit(0.05), high_ozone / 100 * 0.02) * people)
    waterborne = whole(F.least(F.lit(0.05), F.greatest(F.coalesce(F.col(water), F.lit(0.0)), F.lit(0.0)) * 0.05) * people)
    return df.where(people > 0).select("*", deaths.alias("deaths"), (respiratory + cardiac + asthma + waterborne).alias("cases")).withColumn(
        "daly", F.round(F.col("deaths") * 12.0 + F.col("cases") * 0.5, 0)
    )

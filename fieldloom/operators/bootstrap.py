"""Bootstrap intervals from one pass over the rows.

A replicate weighs every row by a Poisson(1) number instead of drawing rows, so no row is ever copied or moved. The
weights are digits of MD5 of the row's unit: the same on every machine, in every run, and in SQL. A task turns its rows
into one small moment matrix for each replicate and column set (a single matrix product a batch); these are summed, and
whatever is estimated from moments is estimated again for each replicate on the driver, from a few numbers each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.causal import Moments, propensity, structure_from

#: 16-bit numbers from which on a weight is above 0, 1, 2, …: the Poisson(1) distribution in steps of 1/65536
STEPS = [t for t in (math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)) if t < 65536]
#: replicates that one digest gives
PER_DIGEST = 8


def weight_digits(unit: Column, replicates: int, seed: int) -> Column:
    """The 16-bit numbers of a row, one a replicate, as big-endian binary."""
    each = F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // PER_DIGEST) - 1)), lambda j: F.md5(F.concat_ws(":", unit.cast("string"), F.lit(str(seed)), j.cast("string"))))
    return F.unhex(F.array_join(each, ""))


def weight_sql(unit: str, replicate: str, seed: int) -> str:
    """The weight of a row in a replicate, in SQL."""
    u = f"CAST('0x' || substr(md5({unit} || ':{seed}:' || ({replicate} // {PER_DIGEST})), CAST({replicate} % {PER_DIGEST} * 4 + 1 AS INT), 4) AS INT)"
    return " + ".join(f"CAST({u} >= {t} AS INT)" for t in STEPS)


def replicate_moments(df: DataFrame, unit: Column, samples: dict[str, Sequence[str]], replicates: int, seed: int = 7) -> list[dict[str, Moments]]:
    """Moments of several column sets, each over its own complete rows: of the rows as they are, then of each replicate.

    ``unit`` tells rows apart; rows of one unit get the same weights (a cluster bootstrap). The driver receives
    one number for each replicate and pair of columns of a set.
    """
    every = sorted({c for cols in samples.values() for c in cols})
    doubles = df.select(unit.alias("_unit"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in every])
    centre_row = doubles.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in every]).first()
    centre = {c: centre_row[c] for c in every}
    sets = {name: list(cols) for name, cols in samples.items()}
    pairs = {name: np.triu_indices(len(cols) + 1) for name, cols in sets.items()}
    width = sum(len(i) for i, _ in pairs.values())
    table = np.searchsorted(np.array(STEPS), np.arange(65536), side="right").astype(np.float64)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((replicates + 1, width))
        for pdf in frames:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                digits = np.frombuffer(b"".join(part["_digits"]), ">u2").reshape(len(part), -1)[:, :replicates]
                weights = np.hstack([np.ones((len(part), 1)), table[digits]])
                terms = []
                for name, cols in sets.items():
                    x = part[cols].to_numpy(np.float64) - np.array([centre[c] for c in cols])
                    one = np.hstack([np.ones((len(x), 1)), x])
                    one[np.isnan(x).any(axis=1)] = 0.0
                    i, j = pairs[name]
                    terms.append(one[:, i] * one[:, j])
                sums += weights.T @ np.hstack(terms)
        yield pd.DataFrame({"b": np.arange(-1, replicates)} | {f"s{k}": sums[:, k] for k in range(width)})

    rows = doubles.select(weight_digits(F.col("_unit"), replicates, seed).alias("_digits"), *every)
    names = [f"s{k}" for k in range(width)]
    summed = rows.mapInPandas(partial, "b int, " + ", ".join(f"{n} double" for n in names)).groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).orderBy("b").collect()
    out = []
    for r in summed:
        values, at, found = np.array(r[1:], np.float64), 0, {}
        for name, cols in sets.items():
            i, j = pairs[name]
            raw = np.zeros((len(cols) + 1, len(cols) + 1))
            raw[i, j] = raw[j, i] = values[at : at + len(i)]
            at += len(i)
            n = raw[0, 0]
            shift = raw[0, 1:] / n if n else raw[0, 1:]
            found[name] = Moments(cols, n, np.array([centre[c] for c in cols]) + shift, raw[1:, 1:] - n * np.outer(shift, shift))
        out.append(found)
    return out


def interval(values: Sequence[float]) -> tuple[float, float, float, float]:
    """(lower, upper, standard error, p) of replicates of an estimate: 95 % percentiles, twice the smaller tail about 0."""
    v = np.array(values, np.float64)
    v = v[~np.isnan(v)]
    if len(v) < 2:
        return math.nan, math.nan, math.nan, math.nan
    low, high = np.percentile(v, [2.5, 97.5])
    return float(low), float(high), float(v.std(ddof=1)), min(1.0, 2 * min(float((v <= 0).mean()), float((v >= 0).mean())))


def bootstrap_effects(df: DataFrame, unit: str, treatment: str, outcome: str, confounders: Sequence[str] = (), replicates: int = 200, seed: int = 7) -> DataFrame:
    """(estimate, value, lower, upper, se, p_value, replicates) of the treatment's effect: difference of means, and, with
    confounders, the regression coefficient and inverse propensity weighting (scores within 0.01..0.99, fitted once).

    All estimates and replicates come from one pass.
    """
    t, y = F.col(treatment), F.col(outcome)
    rows = df
    samples: dict[str, list[str]] = {"one": ["_y1"], "zero": ["_y0"]}
    if confounders:
        rows, _ = propensity(df, treatment, confounders, "_p")
        p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("_p")))
        rows = rows.withColumns({"_w1": t / p, "_w0": (1 - t) / (1 - p)})
        rows = rows.withColumns({"_v1": F.col("_w1") * y, "_v0": F.col("_w0") * y})
        samples |= {"all": [outcome, treatment, *confounders], "weights": ["_w1", "_v1", "_w0", "_v0"]}
    rows = rows.withColumns({"_y1": F.when(t == 1, y), "_y0": F.when(t == 0, y)})

    def difference(m: dict[str, Moments]) -> float:
        return float(m["one"].mean[0] - m["zero"].mean[0]) if m["one"].n and m["zero"].n else math.nan

    def regression(m: dict[str, Moments]) -> float:
        return float(m["all"].regress(outcome, [treatment, *confounders])[0][0])

    def weighting(m: dict[str, Moments]) -> float:
        w1, v1, w0, v0 = m["weights"].mean
        return float(v1 / w1 - v0 / w0) if w1 and w0 else math.nan

    chosen: dict[str, Callable] = {"difference": difference} | ({"regression": regression, "weighting": weighting} if confounders else {})
    found = replicate_moments(rows, F.col(unit), samples, replicates, seed)
    out = []
    for name, estimate in chosen.items():
        values = [estimate(m) for m in found]
        out.append((name, values[0], *interval(values[1:]), int(np.sum(~np.isnan(values[1:])))))
    return df.sparkSession.createDataFrame(out, "estimate string, value double, lower double, upper double, se double, p_value double, replicates long")


def bootstrap_diff(df: DataFrame, unit: str, treatment: str, outcome: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Bootstrap of the difference of means alone."""
    return bootstrap_effects(df, unit, treatment, outcome, (), replicates, seed).drop("estimate", "value")


def counterfactual_intervals(
    df: DataFrame, unit: str, edges: Sequence[tuple[str, str]], interventions: dict[str, float], outcomes: Sequence[str], replicates: int = 200, seed: int = 7
) -> DataFrame:
    """(outcome, factual, counterfactual, effect, lower, upper, se, p_value): effects of setting the intervened variables,
    with intervals over replicates of the whole model: every equation and mean is fitted again in each."""
    names = sorted({v for e in edges for v in e})
    samples: dict[str, list[str]] = {f"mean:{v}": [v] for v in names}
    samples |= {f"fit:{v}": [v, *[a for a, b in edges if b == v]] for v in names if any(b == v for _, b in edges)}
    models = [structure_from(found, edges) for found in replicate_moments(df, F.col(unit), samples, replicates, seed)]
    moved = [m.propagate(interventions) for m in models]
    out = []
    for o in outcomes:
        effects = [v[o] - m.mean[o] for m, v in zip(models, moved, strict=True)]
        out.append((o, models[0].mean[o], float(moved[0][o]), float(effects[0]), *interval(effects[1:])))
    return df.sparkSession.createDataFrame(out, "outcome string, factual double, counterfactual double, effect double, lower double, upper double, se double, p_value double")

"""Normal and t distribution as column expressions, and small driver-side helpers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def erf(x: Column) -> Column:
    """Error function, Abramowitz and Stegun formula 7.1.26."""
    # fixed values: published coefficients
    p = 0.3275911
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = F.lit(a[4])
    for coefficient in reversed(a[:4]):
        poly = poly * t + coefficient
    return F.signum(x) * (1.0 - poly * t * F.exp(-x * x))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / F.sqrt(F.lit(2.0) * F.pi())


def norm_ppf(p: Column) -> Column:
    """Normal quantile by the rational formula 26.2.23 of Abramowitz and Stegun; ±6 at the ends."""
    # fixed values: published coefficients
    c0, c1, c2 = 2.515517, 0.802853, 0.010328
    d1, d2, d3 = 1.432788, 0.189269, 0.001308
    tail = F.least(p, 1.0 - p)
    t = F.sqrt(-2.0 * F.log(F.when(tail > 0, tail)))
    size = t - (c0 + t * (c1 + t * c2)) / (1.0 + t * (d1 + t * (d2 + t * d3)))
    return (
        F.when(p <= 0, -6.0).when(p >= 1, 6.0).when(p == 0.5, 0.0).otherwise(F.when(p > 0.5, size).otherwise(-size))
    )


def two_sided_normal_p(z: Column) -> Column:
    return 2.0 * (1.0 - norm_cdf(F.abs(z)))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t by the normal approximation of Wallace (error below 2e-3 for df >= 3)."""
    z = F.sqrt(df * F.log(1.0 + t * t / df)) * (8.0 * df + 1.0) / (8.0 * df + 3.0)
    return 2.0 * (1.0 - norm_cdf(z))


def f_upper_p(spark: SparkSession, f: float, df1: float, df2: float) -> float:
    """P(F > f), by the commons-math class on Spark's own classpath (driver only)."""
    if f != f or f <= 0:
        return 1.0
    jvm = spark.sparkContext._jvm
    dist = jvm.org.apache.commons.math3.distribution.FDistribution(float(df1), float(df2))
    return 1.0 - dist.cumulativeProbability(float(f))


def t_p_driver(spark: SparkSession, t: float, df: float) -> float:
    """Exact two-sided p of Student's t (driver only)."""
    jvm = spark.sparkContext._jvm
    dist = jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    return 2.0 * (1.0 - dist.cumulativeProbability(abs(float(t))))

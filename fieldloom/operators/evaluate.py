"""Model evaluation as one aggregate over prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.stats import norm_cdf, norm_pdf, norm_ppf
from fieldloom.operators.scale import same_keys


def regression(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """RMSE, MAE, R², MAPE (zero targets left out), bias; no rows give 0, a constant target gives 1 − SSres.

    R² takes the total from centred moments, so one pass is enough.
    """
    e = F.col(p) - F.col(y)
    n = F.count(F.when(F.col(y).isNotNull() & F.col(p).isNotNull(), 1))
    zero = F.lit(0.0)
    ss_res, ss_tot = F.sum(e * e), F.var_pop(F.when(F.col(p).isNotNull(), F.col(y))) * n
    return df.groupBy(*keys).agg(
        F.coalesce(F.sqrt(F.avg(e * e)), zero).alias("rmse"), F.coalesce(F.avg(F.abs(e)), zero).alias("mae"),
        F.coalesce(F.when(ss_tot == 0, 1.0 - ss_res).otherwise(1.0 - ss_res / ss_tot), zero).alias("r2"),
        F.coalesce(F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), zero)))) * 100, zero).alias("mape"),
        F.coalesce(F.avg(e), zero).alias("bias"), n.alias("n"),
    )


def confusion(df: DataFrame, classes: int, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n) for every pair of classes, 0 where none."""
    counts = df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(classes * classes).select(
        F.floor(F.col("id") / classes).cast("int").alias(y), (F.col("id") % classes).cast("int").alias(p)
    )
    return spine.join(counts, [y, p], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(df: DataFrame, classes: int, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per class 0..classes−1: true positives, predicted, actual, precision, recall, IoU, Dice; an absent class has 0."""
    m = confusion(df, classes, y, p)
    both = m.select(F.explode(F.array(
        F.struct(F.col(y).alias("c"), F.col("n").alias("actual"), F.lit(0).alias("predicted"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(p).alias("c"), F.lit(0).alias("actual"), F.col("n").alias("predicted"), F.lit(0).alias("tp")),
    )).alias("s")).select("s.*")
    sums = both.groupBy(F.col("c").alias("class")).agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, pr, ac = F.col("tp"), F.col("predicted"), F.col("actual")
    return sums.select(
        "class", "tp", "predicted", "actual", ratio(tp, pr).alias("precision"), ratio(tp, ac).alias("recall"),
        ratio(tp, pr + ac - tp).alias("iou"), ratio(2 * tp, pr + ac).alias("dice"),
    )


def classification(df: DataFrame, classes: int, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Accuracy, macro precision and recall over all classes, and the harmonic mean of the two macros."""
    c = per_class(df, classes, y, p).agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("actual")), F.lit(0.0)).alias("accuracy"), (F.sum("precision") / classes).alias("precision"), (F.sum("recall") / classes).alias("recall")
    )
    total = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def segmentation(df: DataFrame, classes: int = 10, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Pixel accuracy, mean IoU and mean Dice over all classes, absent ones as 0."""
    return per_class(df, classes, y, p).agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("actual")), F.lit(0.0)).alias("pixel_accuracy"), (F.sum("iou") / classes).alias("mean_iou"), (F.sum("dice") / classes).alias("mean_dice")
    )


def crps_gaussian(y: Column, mean: Column, std: Column) -> Column:
    """CRPS of a normal forecast; the spread is at least 1e-8."""
    s = F.greatest(std, F.lit(1e-8))
    z = (y - mean) / s
    return s * (z * (2 * norm_cdf(z) - 1) + 2 * norm_pdf(z) - 1 / F.sqrt(F.pi()))


def forecast(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", std: str = "y_std", level: float = 0.95,
    reference_mse: float | None = None,
) -> DataFrame:
    """Mean CRPS, coverage of the central interval, sharpness (mean spread), skill against a reference MSE (0 without one)."""
    s = F.greatest(F.col(std), F.lit(1e-8))
    half = norm_ppf(F.lit(0.5 + level / 2)) * s
    e = F.col(y) - F.col(p)
    skill = F.lit(0.0) if not reference_mse else 1 - F.avg(e * e) / reference_mse
    return df.groupBy(*keys).agg(
        F.avg(crps_gaussian(F.col(y), F.col(p), F.col(std))).alias("crps"), F.avg((F.abs(e) <= half).cast("double")).alias("coverage"),
        F.avg(s).alias("sharpness"), skill.alias("skill"),
    )


def argmax_class(scores: Column) -> Column:
    """0-based index of the greatest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def evaluate(df: DataFrame, task: str, classes: int = 10) -> DataFrame:
    """Metrics of a task: regression, classification, segmentation or forecast; score arrays become classes first."""
    if task == "regression":
        return regression(df)
    if task == "forecast":
        return forecast(df)
    if df.schema["y_pred"].dataType.typeName() == "array":
        df = df.withColumn("y_pred", argmax_class(F.col("y_pred")))
    if task == "classification":
        return classification(df, classes)
    if task == "segmentation":
        return segmentation(df, classes)
    raise ValueError(f"unknown task {task}")


def split(key: Column, train: float = 0.7, validation: float = 0.15) -> Column:
    """train, val or test by a hash of the row's key: the same row always lands in the same part."""
    u = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") / F.lit(float(16**7))
    return F.when(u < train, "train").when(u < train + validation, "val").otherwise("test")


def ensemble(members: DataFrame, weights: DataFrame, row: Sequence[str], member: str = "model", p: str = "y_pred") -> DataFrame:
    """Weighted mean of member predictions (weights normalised) and the weighted population std."""
    total = weights.agg(F.sum("weight")).scalar()
    w = members.join(weights.withColumn("_w", F.col("weight") / total), member)
    # around the unweighted mean the squares stay small, so the variance does not cancel
    out = w.groupBy(*row).agg(F.sum(F.col("_w") * F.col(p)).alias("mean"), F.collect_list(F.struct(F.col("_w"), F.col(p).alias("_p"))).alias("_m"))
    var = F.aggregate("_m", F.lit(0.0), lambda acc, x: acc + x["_w"] * (x["_p"] - F.col("mean")) * (x["_p"] - F.col("mean")))
    return out.select(*row, "mean", F.sqrt(var).alias("uncertainty"))


def sample_stats(df: DataFrame, row: Sequence[str], value: str) -> DataFrame:
    """Mean and population std over repeated predictions of a row."""
    return df.groupBy(*row).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("samples"))


def reconstruction_error(x: Column, x_hat: Column) -> Column:
    """Mean squared difference of two arrays."""
    squares = F.zip_with(x, x_hat, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def compare_versions(metrics: DataFrame, model: str, version: str, metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per model version with the listed metrics as columns."""
    return metrics.groupBy(model, version).agg(*[F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names])


def best_epochs(history: DataFrame, run: str, step: str, loss: str, patience: int = 10) -> DataFrame:
    """Per run: best step and loss up to the stop, and the step where ``patience`` epochs passed without a better loss.

    A new best is a strictly lower loss. The stop is the first step that is
    ``patience`` steps after the best so far; without one it is the last step.
    """
    from fieldloom.operators.scale import carry_forward

    rows = history.select(run, F.col(step).alias("_s"), F.col(loss).alias("_l"))
    from pyspark.sql import Window

    # one row per epoch of a run: a run is a few thousand rows at most
    w = Window.partitionBy(run).orderBy("_s")
    low = F.min("_l").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(low.isNull() | (F.col("_l") < low), F.struct(F.col("_s").alias("s"), F.col("_l").alias("l"))))
    best = carry_forward(marked, [run], [F.col("_s")], {"_best": F.col("_new")})
    out_of_patience = F.col("_s") - F.col("_best.s") >= patience
    stops = best.groupBy(run).agg(F.coalesce(F.min(F.when(out_of_patience, F.col("_s"))), F.max("_s")).alias("stop_step"))
    kept = same_keys(best, stops, [run]).where(F.col("_s") <= F.col("stop_step"))
    return kept.groupBy(run).agg(
        F.max_by("_best.s", "_s").alias("best_step"), F.max_by("_best.l", "_s").alias("best_loss"), F.max("stop_step").alias("stop_step")
    )


def stack(df: DataFrame, members: Sequence[str], y: str = "y_true", name: str = "stacked") -> tuple[DataFrame, list[float]]:
    """Linear meta-learner on member predictions: rows with the stacked prediction, and [intercept, weights...].

    Least squares from one pass of moments; scoring is a column expression.
    """
    from fieldloom.operators.causal import moments

    slopes, intercept, _, _ = moments(df, {"all": [y, *members]})["all"].regress(y, list(members))
    out = F.lit(float(intercept))
    for weight, member in zip(slopes, members):
        out = out + F.lit(float(weight)) * F.col(member)
    return df.withColumn(name, out), [float(intercept), *[float(s) for s in slopes]]

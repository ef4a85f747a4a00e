"""Convex blend of two component predictions and its coefficient."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import is_finite, to_column
from .checks import enforce_label_access

DEFAULT_ALPHA = 0.5
TOLERANCE = 1e-12


def blend(first, second, alpha) -> Column:
    """(1 - alpha) * first + alpha * second; a number outside [0, 1] is refused."""
    if not isinstance(alpha, Column):
        alpha = float(alpha)
        if not 0.0 <= alpha <= 1.0:
            raise ContractViolation("alpha must be a finite number in [0, 1]")
        alpha = F.lit(alpha)
    return (F.lit(1.0) - alpha) * to_column(first) + alpha * to_column(second)


def alpha_sums(first, second, target) -> list[Column]:
    """The two sums the weight needs, and the row count."""
    direction = to_column(second) - to_column(first)
    return [
        F.sum(direction * (to_column(target) - to_column(first))).alias("_num"),
        F.sum(direction * direction).alias("_den"),
        F.count(F.lit(1)).alias("coefficient_rows"),
    ]


def alpha_value(default: float = DEFAULT_ALPHA, tolerance: float = TOLERANCE) -> Column:
    if not 0.0 <= float(default) <= 1.0:
        raise ContractViolation("the default weight must be in [0, 1]")
    ratio = F.try_divide(F.col("_num"), F.col("_den"))
    weight = F.when(F.col("_den") <= F.lit(float(tolerance)), F.lit(float(default))).otherwise(
        F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    )
    return weight.alias("alpha")


def fit_alpha(
    df: DataFrame,
    by: Iterable[str] = ("deployment_fold",),
    first: str = "descriptor_prediction",
    second: str = "neural_prediction",
    target: str = "target",
    default: float = DEFAULT_ALPHA,
    tolerance: float = TOLERANCE,
    role: str = "coefficient_development",
) -> DataFrame:
    """Weight with the least squared error per group: clip(sum(d*(y-a)) / sum(d*d), 0, 1)."""
    enforce_label_access(role, "coefficient_fitting")
    by = list(by)
    sums = df.groupBy(*by).agg(*alpha_sums(first, second, target))
    return sums.select(*by, alpha_value(default, tolerance), "coefficient_rows")


def fit_crossfit_alpha(
    df: DataFrame,
    fold: str = "fold_index",
    first: str = "descriptor_prediction",
    second: str = "neural_prediction",
    target: str = "target",
    default: float = DEFAULT_ALPHA,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Weight of each deployment fold from all rows of the other folds.

    Sums are taken once per fold; a fold's own sums are subtracted from the totals of the handful of
    folds, so the table is never copied fold by fold.
    """
    sums = df.groupBy(F.col(fold).alias("deployment_fold")).agg(*alpha_sums(first, second, target))
    whole = Window.partitionBy(F.lit(0))
    others = sums.select(
        "deployment_fold",
        *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("_num", "_den", "coefficient_rows")],
    )
    return others.select("deployment_fold", alpha_value(default, tolerance), "coefficient_rows")


def fit_bound_alpha(
    predictions: DataFrame,
    labels: DataFrame,
    scored: DataFrame,
    single: bool = False,
    first: str = "descriptor_prediction",
    second: str = "neural_prediction",
    target: str = "target",
    key: str = "record_id",
    fold: str = "fold_index",
) -> DataFrame:
    """Bind, check and fit in one shuffle: deployment_fold, alpha, coefficient_rows, problems, overlaps.

    The three tables are united by (deployment fold, record) and reduced to one row per key, which
    shows whether it has exactly one finite prediction and one finite label (else it counts under
    ``problems``) and whether the same deployed model scores it (``overlaps``). With a single weight
    the rows scored in any fold count.
    """
    def side(df, columns, **flags):
        values = [(F.col(c) if c in columns else F.lit(None)).cast("double").alias(c) for c in (first, second, target)]
        marks = [F.lit(flags.get(m, 0)).cast("bigint").alias(m) for m in ("_p", "_l", "_s")]
        bad = F.lit(False)
        for c in columns:
            bad = bad | ~is_finite(c)
        place = F.lit(0).alias("deployment_fold") if single else F.col("deployment_fold").cast("int").alias("deployment_fold")
        return df.select(place, F.col(key).cast("string").alias(key), *values, *marks, bad.cast("bigint").alias("_bad"))

    united = side(predictions, [first, second], _p=1).unionByName(side(labels, [target], _l=1))
    united = united.unionByName(side(scored.withColumn("deployment_fold", F.col(fold)), [], _s=1))
    per_key = united.groupBy("deployment_fold", key).agg(
        *[F.max(c).alias(c) for c in (first, second, target)], *[F.sum(c).alias(c) for c in ("_p", "_l", "_s", "_bad")]
    )
    used = (F.col("_p") > 0) | (F.col("_l") > 0)
    good = (F.col("_p") == 1) & (F.col("_l") == 1) & (F.col("_bad") == 0) & F.col(key).isNotNull()
    sums = per_key.filter(used).groupBy("deployment_fold").agg(
        *alpha_sums(first, second, target),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("problems"),
        F.count_if(F.col("_s") > 0).alias("overlaps"),
    )
    return sums.select("deployment_fold", alpha_value(), "coefficient_rows", "problems", "overlaps")


def crossfit_rows(df: DataFrame, folds: Iterable[int], fold: str = "fold_index") -> DataFrame:
    """Every row once for each fold other than its own, as ``deployment_fold``."""
    others = F.array_except(F.array(*[F.lit(int(f)) for f in folds]), F.array(F.col(fold).cast("int")))
    return df.withColumn("deployment_fold", F.explode(others))


def attach_alpha(scored: DataFrame, coefficients: DataFrame, single: bool = False, fold: str = "fold_index") -> DataFrame:
    """Give each scored row the weight of its fold, or the single weight.

    Weights are model parameters, one per fold: a map made once, as a scalar subquery, so the scored rows are not
    shuffled. A fold with two weights or without one is an error.
    """
    first = coefficients.select("alpha").head(2)
    if not first:
        raise ContractViolation("there are no coefficients")
    if single:
        if len(first) != 1:
            raise ContractViolation("a single-coefficient policy needs exactly one coefficient")
        return scored.withColumn("alpha", F.lit(float(first[0][0])))
    entry = F.struct(F.col("deployment_fold").cast("int").alias("key"), F.col("alpha").cast("double").alias("value"))
    table = coefficients.agg(F.map_from_entries(F.collect_list(entry)).alias("weights")).scalar()
    weight = F.try_element_at(table, F.col(fold).cast("int"))
    error = F.raise_error(F.concat(F.lit("no coefficient for fold "), F.coalesce(F.col(fold).cast("string"), F.lit("null"))))
    return scored.withColumn("alpha", F.coalesce(weight, error.cast("double")))

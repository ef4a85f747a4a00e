"""Regression metrics, overall and by subgroup, in one pass for all predictors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_column

SPARSE_ROWS = 100


def _metric_struct(name: str, observed: Column, prediction: Column) -> Column:
    error = prediction - observed
    return F.struct(
        F.lit(name).alias("predictor"),
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        F.sum(error * error).alias("sse"),
    )


def regression_metrics(
    df: DataFrame, observed: str, predictions: Mapping[str, str] | Iterable[str], by: Iterable[str] = ()
) -> DataFrame:
    """Rows (by, predictor, n, rmse, mae, bias, sse); bias is mean prediction minus observation."""
    names = dict(predictions) if isinstance(predictions, Mapping) else {p: p for p in predictions}
    by = list(by)
    structs = [_metric_struct(n, to_column(observed), to_column(c)) for n, c in names.items()]
    return df.groupBy(*by).agg(F.array(*structs).alias("_m")).select(*by, F.inline("_m"))


def band(value, limits: Iterable[float], labels: Iterable[str]) -> Column:
    """Label of the half-open band [limit, next limit) that a number falls into."""
    limits, labels = list(limits), list(labels)
    column = to_column(value)
    expression = F.when(column.isNotNull(), F.lit(labels[-1]))
    for limit, label in reversed(list(zip(limits, labels))):
        expression = F.when(column < F.lit(float(limit)), F.lit(label)).otherwise(expression)
    return expression


def unpivot_axes(df: DataFrame, axes: Mapping[str, Column], kept: Iterable[str]) -> DataFrame:
    """One row per record and axis: kept columns, axis, level."""
    pairs = [F.struct(F.lit(a).alias("axis"), c.cast("string").alias("level")) for a, c in axes.items()]
    return df.select(*kept, F.inline(F.array(*pairs)))


def subgroup_metrics(
    df: DataFrame, axes: Mapping[str, Column], observed: str, predictions: Iterable[str], sparse: int = SPARSE_ROWS
) -> DataFrame:
    """Metrics per (axis, level, predictor); ``sparse`` flags levels with too few records."""
    predictions = list(predictions)
    long = unpivot_axes(df, axes, [observed, *predictions])
    result = regression_metrics(long, observed, predictions, ["axis", "level"])
    return result.withColumn("sparse", F.col("n") < sparse)

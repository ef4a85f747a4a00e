"""Comparator reports: grids with holes, reference values, lowest flags, significance tiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import display_text
from .checks import require_empty


def report_grid(
    models: DataFrame, panels: DataFrame, results: DataFrame, model: str = "model", panel: str = "panel"
) -> DataFrame:
    """Every model with every panel, left-joined to the results; ``available`` marks the holes.

    Panels are the columns of a report: gathered once, as a scalar subquery, and expanded per model.
    """
    names = panels.agg(F.array_sort(F.collect_set(panel)).alias("panels")).scalar()
    grid = models.select(model).distinct().withColumn(panel, F.explode(names))
    marked = results.withColumn("available", F.lit(True))
    return grid.join(marked, [model, panel], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def single_value(df: DataFrame, by: Iterable[str], column: str, check: bool = True) -> DataFrame:
    """The one value a column must have in each group; raises on none or on several."""
    by = list(by)
    grouped = df.groupBy(*by).agg(F.min(column).alias(column), F.max(column).alias("_max"))
    if check:
        bad = grouped.filter(F.col(column).isNull() | (F.col(column) != F.col("_max")))
        require_empty(bad, f"expected one consistent {column}")
    return grouped.drop("_max")


def flag_lowest(
    df: DataFrame, by: Iterable[str], column: str, tolerance: float = 1e-12, name: str = "is_lowest"
) -> DataFrame:
    """Mark the rows at the lowest value of their group, ties within the tolerance included.

    The minimum is one aggregation with map-side combine, joined back; no group is sorted.
    """
    by = list(by)
    lowest = df.groupBy(*by).agg(F.min(column).alias("_min"))
    flagged = F.coalesce(F.abs(F.col(column) - F.col("_min")) <= F.lit(float(tolerance)), F.lit(False))
    return df.join(lowest, by, "left").withColumn(name, flagged).drop("_min")


def panel_tier(df: DataFrame, by: Iterable[str] = ("panel",), high95: str = "ci95_high", high99: str = "ci99_high") -> DataFrame:
    """``***`` if every 99% upper bound of the panel is below 0, ``**`` if every 95% one is, else empty."""
    grouped = df.groupBy(*by).agg(
        F.bool_and(F.col(high99) < 0).alias("_99"), F.bool_and(F.col(high95) < 0).alias("_95")
    )
    tier = F.when(F.col("_99"), F.lit("***")).when(F.col("_95"), F.lit("**")).otherwise(F.lit(""))
    return grouped.withColumn("tier", tier).drop("_99", "_95")


def display_differences(df: DataFrame, value: str, locked: str, decimals: int = 3) -> DataFrame:
    """Rows whose fixed-decimal text differs from the locked text."""
    return df.withColumn("display", display_text(value, decimals)).filter(
        ~F.coalesce(F.col("display") == F.col(locked), F.lit(False))
    )


def sort_report(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Report order; use only at the sink."""
    return df.orderBy(*columns)

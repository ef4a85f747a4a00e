"""Comparator report: models by panels, with holes, lowest flags, tiers and report order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import display_text
from ..operators.checks import require_empty, result_violations
from ..operators.reports import flag_lowest, panel_tier, report_grid, single_value


def comparator_report(models: DataFrame, panels: DataFrame, results: DataFrame, check: bool = True) -> DataFrame:
    """One row per (model, panel): n, rmse, its display text, delta with bounds, availability, lowest
    flag and the significance tier of the panel.

    ``results`` needs model, panel, n, rmse, delta and the ci95/ci99 bounds; n must agree in a panel.
    """
    if check:
        require_empty(result_violations(results, ["model", "panel"]), "intervals are not valid")
        single_value(results, ["panel"], "n")
    grid = report_grid(models, panels, results)
    flagged = flag_lowest(grid, ["panel"], "rmse")
    tiers = panel_tier(results)
    return (
        flagged.join(tiers, "panel", "left")
        .withColumn("display", F.when(F.col("available"), display_text("rmse")).otherwise(F.lit("")))
        .withColumn("is_lowest", F.col("is_lowest") & F.col("available"))
    )

"""Sinks: stages without scored labels, predictions with a run summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import is_finite
from ..operators.checks import TARGET_COLUMNS, ensure_label_free, require_empty, prediction_violations

SCORED_STAGE = "scored_prediction"


def write_stages(df: DataFrame, path: str, target: str = "target", stage: str = "stage") -> None:
    """Write training stages partitioned by stage, and the scored stage apart and without its label.

    Existing output is refused. A reader of the scored folder cannot reach a label.
    """
    scored = df.filter(F.col(stage) == SCORED_STAGE).drop(target)
    ensure_label_free(scored, set(TARGET_COLUMNS) | {target}, fold_case=True)
    df.filter(F.col(stage) != SCORED_STAGE).write.mode("errorifexists").partitionBy(stage).parquet(f"{path}/training")
    scored.write.mode("errorifexists").parquet(f"{path}/{SCORED_STAGE}")


def write_predictions(
    df: DataFrame,
    path: str,
    expected: DataFrame | None = None,
    summary: Mapping[str, str] | None = None,
    key: str = "record_id",
    prediction: str = "prediction",
) -> dict:
    """Write one finite prediction per row and a summary; the counts come from the writing job itself.

    ``expected`` is the table of scored keys, which must match one to one. Predictions are made once: the written rows
    are the ones that are checked, and rows that break their contract are taken away again. Existing output is refused.
    """
    from ..operators.keys import bind_status

    spark, target = df.sparkSession, f"{path}/predictions"
    seen = Observation("predictions")
    observed = df.select(key, prediction).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(is_finite(prediction)).alias("finite_rows"),
        F.avg(prediction).alias("mean_prediction"),
    )
    observed.write.mode("errorifexists").parquet(target)
    counts, table = dict(seen.get), spark.read.parquet(target)
    try:
        require_empty(prediction_violations(table, None, key, prediction), "predictions break their contract")
        if expected is not None:
            require_empty(bind_status(table, expected, [key]), "predictions do not match the scored rows")
    except ContractViolation:
        folder = spark._jvm.org.apache.hadoop.fs.Path(target)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        raise
    facts = {**{k: str(v) for k, v in (summary or {}).items()}, **{k: str(v) for k, v in counts.items()}}
    facts["scored_labels_accessed"] = "False"
    spark.createDataFrame(list(facts.items()), "name string, value string").coalesce(1).write.mode(
        "errorifexists"
    ).parquet(f"{path}/summary")
    return counts

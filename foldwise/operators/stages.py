"""From partition roles to training stages, by evaluation design and model branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractViolation

# The six stages of a unit.
STAGES = (
    "parameter_fit",
    "selection_fit",
    "selection_score",
    "final_refit",
    "coefficient_fit",
    "scored_prediction",
)

# Fixed values: (design, branch, role) -> stages. Roles "global_fit" and "global_score" come from a
# group split of the whole training side; "selection", "oof_holdout" and "official_test" are native
# roles; "source_scored" are the scored rows of the evaluation that lends its out-of-fold predictions.
STAGE_RULES = (
    ("nested_holdout", "tabular", "fit", ("selection_fit", "selection_score", "final_refit")),
    ("nested_holdout", "tabular", "reserved", ("selection_fit", "selection_score", "final_refit")),
    ("nested_holdout", "tabular", "scored", ("scored_prediction",)),
    ("nested_holdout", "encoder", "fit", ("parameter_fit",)),
    ("nested_holdout", "encoder", "reserved", ("selection_score",)),
    ("nested_holdout", "encoder", "scored", ("scored_prediction",)),
    ("nested_holdout", "head", "fit", ("parameter_fit",)),
    ("nested_holdout", "head", "scored", ("scored_prediction",)),
    ("nested_holdout", "coefficient", "scored", ("scored_prediction",)),
    ("global_selection", "tabular", "global_fit", ("selection_fit",)),
    ("global_selection", "tabular", "global_score", ("selection_score",)),
    ("global_selection", "tabular", "fit", ("final_refit",)),
    ("global_selection", "tabular", "scored", ("scored_prediction",)),
    ("global_selection", "encoder", "global_fit", ("selection_fit",)),
    ("global_selection", "encoder", "global_score", ("selection_score",)),
    ("global_selection", "encoder", "fit", ("final_refit",)),
    ("global_selection", "encoder", "scored", ("scored_prediction",)),
    ("global_selection", "head", "fit", ("parameter_fit",)),
    ("global_selection", "head", "scored", ("scored_prediction",)),
    ("global_selection", "coefficient", "fit", ("coefficient_fit",)),
    ("global_selection", "coefficient", "scored", ("scored_prediction",)),
    ("native_holdout", "tabular", "fit", ("parameter_fit",)),
    ("native_holdout", "tabular", "selection", ("selection_score",)),
    ("native_holdout", "tabular", "oof_holdout", ("scored_prediction",)),
    ("native_holdout", "encoder", "fit", ("parameter_fit",)),
    ("native_holdout", "encoder", "selection", ("selection_score",)),
    ("native_holdout", "encoder", "oof_holdout", ("scored_prediction",)),
    ("native_holdout", "head", "fit", ("parameter_fit",)),
    ("native_holdout", "head", "oof_holdout", ("scored_prediction",)),
    ("native_holdout", "coefficient", "fit", ("coefficient_fit",)),
    ("native_holdout", "coefficient", "selection", ("coefficient_fit",)),
    ("native_holdout", "coefficient", "oof_holdout", ("scored_prediction",)),
    ("native_test", "tabular", "fit", ("parameter_fit",)),
    ("native_test", "tabular", "selection", ("selection_score",)),
    ("native_test", "tabular", "official_test", ("scored_prediction",)),
    ("native_test", "encoder", "fit", ("parameter_fit",)),
    ("native_test", "encoder", "selection", ("selection_score",)),
    ("native_test", "encoder", "official_test", ("scored_prediction",)),
    ("native_test", "head", "fit", ("parameter_fit",)),
    ("native_test", "head", "official_test", ("scored_prediction",)),
    ("native_test", "coefficient", "source_scored", ("coefficient_fit",)),
    ("native_test", "coefficient", "official_test", ("scored_prediction",)),
    ("supplied_splits", "tabular", "fit", ("parameter_fit",)),
    ("supplied_splits", "tabular", "coefficient", ("selection_score",)),
    ("supplied_splits", "tabular", "scored", ("scored_prediction",)),
    ("supplied_splits", "encoder", "fit", ("parameter_fit",)),
    ("supplied_splits", "encoder", "coefficient", ("selection_score",)),
    ("supplied_splits", "encoder", "scored", ("scored_prediction",)),
    ("supplied_splits", "head", "fit", ("parameter_fit",)),
    ("supplied_splits", "head", "scored", ("scored_prediction",)),
    ("supplied_splits", "coefficient", "coefficient", ("coefficient_fit",)),
    ("supplied_splits", "coefficient", "scored", ("scored_prediction",)),
    ("full_refit", "tabular", "global_fit", ("selection_fit",)),
    ("full_refit", "tabular", "global_score", ("selection_score",)),
    ("full_refit", "tabular", "fit", ("final_refit",)),
    ("full_refit", "tabular", "scored", ("scored_prediction",)),
    ("full_refit", "encoder", "global_fit", ("selection_fit",)),
    ("full_refit", "encoder", "global_score", ("selection_score",)),
    ("full_refit", "encoder", "fit", ("final_refit",)),
    ("full_refit", "encoder", "scored", ("scored_prediction",)),
    ("full_refit", "head", "fit", ("final_refit",)),
    ("full_refit", "head", "scored", ("scored_prediction",)),
    ("full_refit", "coefficient", "fit", ("coefficient_fit",)),
    ("full_refit", "coefficient", "scored", ("scored_prediction",)),
)


def stage_map(design: str, branch: str) -> dict[str, tuple[str, ...]]:
    rules = {role: stages for d, b, role, stages in STAGE_RULES if (d, b) == (design, branch)}
    if not rules:
        raise ContractViolation(f"no stage rules for {design} / {branch}")
    return rules


def resolve_stages(partitions: DataFrame, design: str, branch: str, role: str = "role") -> DataFrame:
    """Expand the roles of a unit to its stages; roles without a stage in this branch drop out.

    The rules of one (design, branch) are a handful of literals, so this is a narrow pass.
    """
    stages = F.array().cast("array<string>")
    for name, targets in stage_map(design, branch).items():
        stages = F.when(F.col(role) == name, F.array(*[F.lit(t) for t in targets])).otherwise(stages)
    kept = [c for c in partitions.columns if c != role]
    return partitions.select(*kept, F.explode(stages).alias("stage"))

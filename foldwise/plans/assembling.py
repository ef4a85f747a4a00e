"""Assemble scored predictions and score them. The first step has no label argument but the coefficients'."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..operators.aggregates import SCORED_MODES, aggregate_scored, scored_problems
from ..operators.blending import attach_alpha, blend, fit_bound_alpha
from ..operators.bootstrap import REPLICATES, paired_comparisons
from ..operators.checks import conformance, enforce_label_access, ensure_label_free, require_columns, require_empty
from ..operators.keys import bind_exact, bind_status, coefficient_overlap, fingerprint
from ..operators.metrics import regression_metrics
from ..session import collect_small

COMPONENTS = ("descriptor_prediction", "neural_prediction")
BLEND = "blend"
DEFAULT_SEED = 20260821

# How the coefficient of an evaluation is obtained.
POLICIES = ("fixed_half", "crossfit", "per_split", "single")


_UNBOUND = "coefficient predictions and labels must match one to one and be finite"
_OVERLAP = "a model was scored on records that its own coefficient was fitted on (overlap)"


@dataclass(frozen=True)
class Evaluation:
    """Folds, coefficient policy and scored aggregation of one evaluation."""

    folds: tuple[int, ...]
    policy: str
    aggregation: str
    expected_rows: int | None = None

    def __post_init__(self):
        if self.policy not in POLICIES or self.aggregation not in SCORED_MODES:
            raise ContractViolation(f"unknown policy or aggregation: {self.policy}, {self.aggregation}")

    @property
    def coefficient_folds(self) -> tuple[int, ...]:
        return (0,) if self.policy == "single" else self.folds


@dataclass
class Assembly:
    coefficients: DataFrame
    predictions: DataFrame


def fit_coefficients(
    evaluation: Evaluation,
    scored: DataFrame,
    coefficient_predictions: DataFrame | None = None,
    coefficient_labels: DataFrame | None = None,
) -> DataFrame:
    """deployment_fold, alpha, coefficient_rows under the policy of the evaluation."""
    spark = scored.sparkSession
    schema = "deployment_fold int, alpha double, coefficient_rows bigint"
    if evaluation.policy == "fixed_half":
        if coefficient_predictions is not None or coefficient_labels is not None:
            raise ContractViolation("a prespecified coefficient takes no coefficient tables")
        return spark.createDataFrame([(f, 0.5, 0) for f in evaluation.folds], schema)
    if coefficient_predictions is None or coefficient_labels is None:
        raise ContractViolation("this policy needs coefficient predictions and labels")
    predictions = require_columns(coefficient_predictions, ["deployment_fold", "record_id", *COMPONENTS])
    labels = require_columns(coefficient_labels, ["deployment_fold", "record_id", "target"])
    single = evaluation.policy == "single"
    if single:
        outside = predictions.filter(F.coalesce(F.col("deployment_fold") != 0, F.lit(True)))
        require_empty(outside.select("deployment_fold").distinct(), "a single coefficient belongs to deployment fold 0")
    enforce_label_access("coefficient_development", "coefficient_fitting")
    keys = scored.select(F.col("record_id").cast("string").alias("record_id"), "fold_index")
    fitted = collect_small(fit_bound_alpha(predictions, labels, keys, single), what="coefficient table")
    if any(r["problems"] for r in fitted):
        require_empty(bind_status(predictions, labels, ["deployment_fold", "record_id"], COMPONENTS, ["target"]), _UNBOUND)
        raise ContractViolation(_UNBOUND)
    if any(r["overlaps"] for r in fitted):
        require_empty(coefficient_overlap(predictions, keys, single), _OVERLAP)
        raise ContractViolation(_OVERLAP)
    rows = sorted((int(r["deployment_fold"]), float(r["alpha"]), int(r["coefficient_rows"])) for r in fitted)
    if tuple(r[0] for r in rows) != tuple(sorted(evaluation.coefficient_folds)):
        raise ContractViolation("coefficient sources do not cover exactly the required deployment folds")
    return spark.createDataFrame(rows, schema)


def assemble(
    evaluation: Evaluation,
    scored: DataFrame,
    coefficient_predictions: DataFrame | None = None,
    coefficient_labels: DataFrame | None = None,
) -> Assembly:
    """Fit the coefficients, blend each scored row with its fold's, then aggregate over folds.

    Blending comes before the mean over split models: with a coefficient per split the two orders differ.
    """
    ensure_label_free(scored)
    rows = require_columns(scored, ["record_id", "fold_index", *COMPONENTS])
    rows = rows.withColumns({"record_id": F.col("record_id").cast("string"), "fold_index": F.col("fold_index").cast("int")})
    broken = scored_problems(rows, evaluation.aggregation, evaluation.folds, COMPONENTS)
    require_empty(broken, "scored rows break their contract")
    coefficients = fit_coefficients(evaluation, rows, coefficient_predictions, coefficient_labels)
    weighted = attach_alpha(rows, coefficients, single=evaluation.policy == "single")
    blended = weighted.withColumn(BLEND, blend(*COMPONENTS, F.col("alpha"))).drop("alpha")
    predictions = aggregate_scored(
        blended, evaluation.aggregation, evaluation.folds, [*COMPONENTS, BLEND], evaluation.expected_rows, check=False
    )
    return Assembly(coefficients, predictions)


@dataclass
class Score:
    metrics: DataFrame
    paired: DataFrame


def score(
    predictions: DataFrame,
    labels: DataFrame,
    seed: int = DEFAULT_SEED,
    replicates: int = REPLICATES,
    method: str = "multinomial",
) -> Score:
    """Bind the labels; metrics of three predictors; blend minus each component with intervals.

    The two comparisons use ``seed`` and ``seed + 1``.
    """
    columns = [*COMPONENTS, BLEND]
    bound = bind_exact(
        require_columns(predictions, ["record_id", *columns]), require_columns(labels, ["record_id", "target"]), columns
    )
    comparisons = {f"{BLEND} - {c}": (BLEND, c, seed + i) for i, c in enumerate(COMPONENTS)}
    paired = paired_comparisons(bound, comparisons, replicates=replicates, method=method)
    return Score(regression_metrics(bound, "target", columns), paired)


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """(name, n, digest) of a table: order-free, over all its columns by name."""
    line = F.to_json(F.struct(*[df[c] for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return fingerprint(df, [], line).select(F.lit(name).alias("name"), "n", "digest")


def write_assembly(assembly: Assembly, labels: DataFrame, path: str) -> DataFrame:
    """Write predictions, coefficients and the labels they will be scored on, with a manifest of their digests.

    The manifest is taken of the written tables. Existing output is refused.
    """
    spark, parts = assembly.predictions.sparkSession, []
    tables = {"predictions": assembly.predictions, "coefficients": assembly.coefficients, "labels": labels.select("record_id", "target")}
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
        parts.append(table_digest(spark.read.parquet(f"{path}/{name}"), name))
    manifest = reduce(DataFrame.unionByName, parts)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def score_written(spark: SparkSession, path: str, **options) -> Score:
    """Score a written assembly; a table that is not the one of the manifest is refused before any label is bound."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("predictions", "coefficients", "labels")}
    found = reduce(DataFrame.unionByName, [table_digest(table, name) for name, table in tables.items()])
    declared = spark.read.parquet(f"{path}/manifest")
    require_empty(conformance(declared, found, ["name"], ["n", "digest"]), "written tables differ from the manifest")
    return score(tables["predictions"], tables["labels"], **options)


def crossfit_report(bound: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Metrics of both components and of the blend for rows that carry fold and target."""
    weighted = attach_alpha(bound, coefficients)
    blended = weighted.withColumn(BLEND, blend(*COMPONENTS, F.col("alpha")))
    return regression_metrics(blended, "target", [*COMPONENTS, BLEND])

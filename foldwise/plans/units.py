"""Materialise the training stages of a unit, verify them, and run a fold end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_finite
from ..operators.checks import conformance, finite_violations, require_empty, row_violations
from ..operators.features import FeatureFilter, FilterConfig, apply_feature_filter, fit_feature_filter
from ..operators.keys import fingerprint, missing_ids, stage_overlaps
from ..operators.search import (
    PATIENCE,
    best_iteration,
    refit_ensemble,
    save_run,
    search_nested,
    search_trials,
    select_nested,
)
from ..operators.splits import nested_folds
from ..operators.stages import resolve_stages
from ..session import collect_small
from ..sources.sinks import SCORED_STAGE, write_predictions


def materialise(
    base: DataFrame, partitions: DataFrame, design: str, branch: str, fold: int, target: str = "target"
) -> DataFrame:
    """Long stage table of one unit: stage, record_id and the base columns.

    The label is null on scored rows, so that no later step can read it there.
    """
    unit = resolve_stages(partitions.filter(F.col("fold_index") == int(fold)).select("record_id", "role"), design, branch)
    rows = unit.join(base, "record_id", "left")
    label = F.when(F.col("stage") != SCORED_STAGE, F.col(target))
    return rows.withColumn(target, label)


def nested_stages(partitions: DataFrame, fold: int) -> DataFrame:
    """Inner selection stages of one outer fold: inner_fold, record_id, stage."""
    return nested_folds(partitions).filter(F.col("outer_fold") == int(fold)).drop("outer_fold")


def stage_summary(stages: DataFrame) -> DataFrame:
    """Rows and fingerprint of each stage."""
    return fingerprint(stages, ["stage"], "record_id", repeats=False)


def assignment_fingerprint(stages: DataFrame) -> DataFrame:
    """One fingerprint over all (stage, record) lines."""
    return fingerprint(stages, [], F.concat_ws("\t", "stage", "record_id"), repeats=False)


def verify_unit(stages: DataFrame, base: DataFrame, expected: DataFrame | None = None, allow_overlap: bool = False) -> None:
    """Every staged record exists; rows and fingerprints equal the declared ones; no stage overlaps
    the scored rows unless the design says so."""
    require_empty(missing_ids(stages, base), "a stage refers to records that the base table lacks")
    if expected is not None:
        require_empty(conformance(expected, stage_summary(stages), ["stage"], ["n", "digest"]), "stage identity differs")
    if not allow_overlap:
        shared = stage_overlaps(stages).filter((F.col("stage_a") == SCORED_STAGE) | (F.col("stage_b") == SCORED_STAGE))
        require_empty(shared, "a training stage overlaps the scored rows")


ASSIGNMENT, OVERLAP = "assignment", "overlap:"


def unit_identity(stages: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """What a unit is made of: (unit, part, n, digest), from one pass over its stages and its nested stages.

    Units are ``outer`` and the numbers of the inner folds. Parts are the stages, with rows and fingerprint of their
    records; ``assignment``, over all lines of stage and record; and, for the outer unit, ``overlap:`` with a training
    stage, with the number of records that are scored as well, if there are any.
    """
    rows = stages.select(F.lit("outer").alias("unit"), "stage", "record_id")
    if nested is not None:
        rows = rows.unionByName(nested.select(F.col("inner_fold").cast("string").alias("unit"), "stage", "record_id"))
    both = F.array(
        F.struct(F.col("stage").alias("part"), F.col("record_id").cast("string").alias("line")),
        F.struct(F.lit(ASSIGNMENT).alias("part"), F.concat_ws("\t", "stage", "record_id").alias("line")),
    )
    parts = fingerprint(rows.select("unit", F.inline(both)), ["unit", "part"], "line", repeats=False)
    shared = stage_overlaps(stages).withColumn("other", F.when(F.col("stage_a") == SCORED_STAGE, F.col("stage_b")).when(F.col("stage_b") == SCORED_STAGE, F.col("stage_a")))
    counted = shared.where("other is not null").select(
        F.lit("outer").alias("unit"), F.concat(F.lit(OVERLAP), "other").alias("part"), F.col("n").cast("bigint").alias("n"), F.lit("").alias("digest")
    )
    return parts.select("unit", "part", F.col("n").cast("bigint").alias("n"), "digest").unionByName(counted)


def unit_drift(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Parts that differ between two tables of :func:`unit_identity`: unit, part, status.

    The status is ``missing``, ``undeclared``, ``rows`` or ``digest``; an overlap of no rows need not be named.
    """
    one, two = (df.where("n > 0").select("unit", "part", F.struct("n", "digest").alias(name)) for df, name in ((found, "_f"), (declared, "_d")))
    status = (
        F.when(F.col("_f").isNull(), F.lit("missing"))
        .when(F.col("_d").isNull(), F.lit("undeclared"))
        .when(F.col("_f.n") != F.col("_d.n"), F.lit("rows"))
        .when(F.col("_f.digest") != F.col("_d.digest"), F.lit("digest"))
    )
    return one.join(two, ["unit", "part"], "full_outer").select("unit", "part", status.alias("status")).where("status is not null")


@dataclass
class PreparedUnit:
    """Rows for a fit, and the persisted table behind them; ``close`` lets go of it, also at the end of a ``with``."""

    rows: DataFrame
    fitted: FeatureFilter
    cached: DataFrame

    def close(self) -> None:
        self.cached.unpersist()

    def __enter__(self) -> PreparedUnit:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def prepare_unit(
    features: DataFrame, partitions: DataFrame, labels: DataFrame, columns: Sequence[str], config: FilterConfig,
    key: str = "record_id", target: str = "target", check: bool = True,
) -> PreparedUnit:
    """Join roles, features and labels; fit the filter on ``fit`` rows only, apply it to every role.

    ``partitions`` holds key and role (fit, selection, scored). Scored rows get no label. The joined
    table is read by the fit, by the check and by the caller, so it is persisted.
    """
    known = labels.select(key, F.col(target))
    staged = partitions.select(key, "role").join(features.withColumn("_found", F.lit(True)), key, "left")
    staged = staged.join(known, key, "left").withColumn(target, F.when(F.col("role") != "scored", F.col(target))).persist()
    fitted = fit_feature_filter(staged.filter("role = 'fit'"), columns, config)
    if check:
        rules = [
            ("features:absent", F.col("_found").isNull()),
            ("label:absent", (F.col("role") != "scored") & ~is_finite(target)),
            *[(f"{c}:not_finite", F.col("_found").isNotNull() & ~is_finite(c)) for c in fitted.retained],
        ]
        require_empty(row_violations(staged, [key, "role"], rules), "the unit is not complete")
    rows = apply_feature_filter(staged, fitted, [key, "role", target], check=False)
    return PreparedUnit(rows, fitted, staged)


def refit_unit(unit: PreparedUnit, key: str = "record_id", target: str = "target") -> PreparedUnit:
    """The same unit with its filter fitted on all development rows, for a refit after the search."""
    columns = [c for c, _ in unit.fitted.decisions]
    development = unit.cached.filter("role <> 'scored'")
    fitted = fit_feature_filter(development, columns, unit.fitted.config)
    require_empty(finite_violations(unit.cached, [key, "role"], fitted.retained), "retained features must be finite")
    return PreparedUnit(apply_feature_filter(unit.cached, fitted, [key, "role", target], check=False), fitted, unit.cached)


def _scored(unit: PreparedUnit) -> DataFrame:
    return unit.rows.filter("role = 'scored'").drop("target", "role")


def _write(path, predictions, model, unit, facts) -> DataFrame:
    write_predictions(predictions, f"{path}/output", _scored(unit).select("record_id"), facts)
    save_run(f"{path}/run", model, unit.fitted, {**facts, "scored_labels_accessed": "False"})
    return predictions.sparkSession.read.parquet(f"{path}/output/predictions")


def run_fold(
    unit: PreparedUnit,
    candidates: Sequence[Mapping],
    base_seed: int,
    seeds: Sequence[int] = (),
    path: str | None = None,
    summary: Mapping[str, str] | None = None,
    patience: int | None = PATIENCE,
    tree_budget: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Search on one selection set, predict the scored rows, write: (predictions, trial records).

    Without ``seeds`` the selected model itself predicts. With them the chosen parameters are frozen,
    the filter and the model are refitted on all development rows under each seed, and the mean is
    taken; the number of trees is then the one the search settled on, or, without patience, the candidate's own.
    """
    result = search_trials(
        unit.rows, unit.fitted.retained, candidates, lambda t: base_seed + t, patience=patience, tree_budget=tree_budget
    )
    trees = best_iteration(result.model) + 1
    if seeds:
        unit = refit_unit(unit)
        predictions, models = refit_ensemble(
            unit.rows.filter("role <> 'scored'"), _scored(unit), unit.fitted.retained, result.parameters, trees, seeds
        )
        model = models[0]
    else:
        model = result.model
        predictions = model.transform(_scored(unit)).select("record_id", "prediction")
    if path:
        facts = {**(summary or {}), "trial": str(result.trial), "trees": str(trees)}
        predictions = _write(path, predictions, model, unit, facts)
        unit.close()
    return predictions, result.records


def run_nested_fold(
    features: DataFrame,
    partitions: DataFrame,
    labels: DataFrame,
    columns: Sequence[str],
    config: FilterConfig,
    fold: int,
    candidates: Sequence[Mapping],
    base_seed: int,
    seeds: Sequence[int],
    tree_budget: int | None = None,
    path: str | None = None,
    summary: Mapping[str, str] | None = None,
    patience: int = PATIENCE,
) -> tuple[DataFrame, DataFrame]:
    """Nested search over the other folds, then a seeded refit on all development rows of the fold.

    ``partitions`` is the long table of all folds. Every inner fold fits its own feature filter on its
    own fit rows. The trial is chosen by pooled squared error; the number of trees is the median of its
    inner folds. Returns (predictions, trial records).
    """
    inner = nested_stages(partitions, fold).persist()
    units = {}
    try:
        for row in sorted(collect_small(inner.select("inner_fold").distinct(), what="inner folds")):
            role = F.when(F.col("stage") == "selection_fit", F.lit("fit")).otherwise(F.lit("selection"))
            roles = inner.filter(F.col("inner_fold") == row[0]).select("record_id", role.alias("role"))
            units[row[0]] = prepare_unit(features, roles, labels, columns, config)
        rows = {g: (u.rows, u.fitted.retained) for g, u in units.items()}
        records, parameters = search_nested(rows, candidates, base_seed, tree_budget, patience=patience)
        best = select_nested(records).first()
    finally:
        inner.unpersist()
        for u in units.values():
            u.cached.unpersist()
    role = F.when(F.col("role") == "scored", F.lit("scored")).otherwise(F.lit("fit"))
    outer = partitions.filter(F.col("fold_index") == int(fold)).select("record_id", role.alias("role"))
    unit = prepare_unit(features, outer, labels, columns, config)
    predictions, models = refit_ensemble(
        unit.rows.filter("role = 'fit'"), _scored(unit), unit.fitted.retained, parameters[best["trial"]], best["final_tree_count"], seeds
    )
    if path:
        facts = {**(summary or {}), "trial": str(best["trial"]), "trees": str(best["final_tree_count"])}
        predictions = _write(path, predictions, models[0], unit, facts)
        unit.close()
    return predictions, records


__all__ = ["materialise", "nested_stages", "verify_unit", "prepare_unit", "run_fold", "run_nested_fold", "refit_unit", "PreparedUnit", "stage_summary", "assignment_fingerprint", "unit_identity", "unit_drift"]

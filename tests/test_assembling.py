"""Assemblies on random folds and weights: the weights come back, and blends equal a plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation
from foldwise.plans.assembling import Evaluation, assemble, fit_coefficients, score

SCORED = "record_id string, fold_index int, descriptor_prediction double, neural_prediction double"
COEF = "deployment_fold int, record_id string, descriptor_prediction double, neural_prediction double"
LABELS = "deployment_fold int, record_id string, target double"
PREDICTED = "record_id string, descriptor_prediction double, neural_prediction double, blend double"


class Study:
    """Random predictions of records in folds, and for each weight the coefficient rows that determine it."""

    def __init__(self, spark, seed, folds, records=12, repeats=False):
        self.spark, rng = spark, np.random.default_rng(seed)
        self.folds = folds
        self.weights = dict(zip(folds, rng.uniform(0, 1, len(folds)).tolist()))
        homes = [(f"r{i}", fold) for i in range(records) for fold in (folds if repeats else [folds[i % len(folds)]])]
        self.rows = [(name, fold, *rng.normal(size=2).tolist()) for name, fold in homes]
        self.scored = spark.createDataFrame(self.rows, SCORED)

    def coefficients(self, folds=None, name=lambda fold, i: f"fit{fold}_{i}"):
        rng = np.random.default_rng(99)
        predictions, labels = [], []
        for fold in self.folds if folds is None else folds:
            for i in range(5):
                a, b = rng.normal(size=2).tolist()
                predictions.append((fold, name(fold, i), a, b))
                labels.append((fold, name(fold, i), a + self.weights[fold] * (b - a)))
        return self.spark.createDataFrame(predictions, COEF), self.spark.createDataFrame(labels, LABELS)

    def mean_of(self, value):
        found = {}
        for name, fold, a, b in self.rows:
            found.setdefault(name, []).append(value(fold, a, b))
        return {name: float(np.mean(values)) for name, values in found.items()}


def blends(result):
    return {row["record_id"]: row["blend"] for row in result.predictions.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_of_each_fold_come_back_and_blend_its_records(spark, seed):
    study = Study(spark, seed, [3, 5, 8])
    evaluation = Evaluation(tuple(study.folds), "crossfit", "one_held_out", 12)
    fitted = fit_coefficients(evaluation, study.scored, *study.coefficients())
    assert {row[0]: row[1] for row in fitted.collect()} == pytest.approx(study.weights)
    expected = study.mean_of(lambda fold, a, b: a + study.weights[fold] * (b - a))
    assert blends(assemble(evaluation, study.scored, *study.coefficients())) == pytest.approx(expected)


def test_halves_need_no_coefficient_rows_and_take_none(spark):
    study = Study(spark, 3, [0, 1])
    evaluation = Evaluation((0, 1), "fixed_half", "one_held_out", 12)
    assert blends(assemble(evaluation, study.scored)) == pytest.approx(study.mean_of(lambda fold, a, b: (a + b) / 2))
    with pytest.raises(ContractViolation):
        fit_coefficients(evaluation, study.scored, *study.coefficients())


def test_means_over_splits_blend_before_the_mean(spark):
    study = Study(spark, 4, [2, 4, 6], records=5, repeats=True)
    each = Evaluation((2, 4, 6), "per_split", "mean_over_splits", 5)
    expected = study.mean_of(lambda fold, a, b: a + study.weights[fold] * (b - a))
    assert blends(assemble(each, study.scored, *study.coefficients())) == pytest.approx(expected)
    one = Evaluation((2, 4, 6), "single", "mean_over_splits", 5)
    study.weights[0] = 0.3  # a single weight is filed under fold 0
    expected = study.mean_of(lambda fold, a, b: a + 0.3 * (b - a))
    rows = assemble(one, study.scored, *study.coefficients([0])).predictions.collect()
    assert {row["record_id"]: row["blend"] for row in rows} == pytest.approx(expected)
    assert {row["record_id"]: row["neural_prediction"] for row in rows} == pytest.approx(study.mean_of(lambda fold, a, b: b))


def test_a_full_refit_has_one_weight_and_one_row_per_record(spark):
    study = Study(spark, 5, [0], records=7)
    expected = study.mean_of(lambda fold, a, b: a + study.weights[0] * (b - a))
    assert blends(assemble(Evaluation((0,), "single", "full_refit", 7), study.scored, *study.coefficients())) == pytest.approx(expected)


def test_coefficients_of_a_model_must_not_rest_on_its_scored_records(spark):
    study = Study(spark, 6, [0, 1])
    evaluation = Evaluation((0, 1), "crossfit", "one_held_out", 12)
    others = study.coefficients(name=lambda fold, i: f"r{2 * i + 1 - fold}")  # records of the other fold
    assert {row[0]: row[1] for row in fit_coefficients(evaluation, study.scored, *others).collect()} == pytest.approx(study.weights)
    with pytest.raises(ContractViolation, match="overlap"):
        fit_coefficients(evaluation, study.scored, *study.coefficients(name=lambda fold, i: f"r{2 * i + fold}"))
    with pytest.raises(ContractViolation, match="deployment folds"):
        assemble(evaluation, study.scored, *study.coefficients([1]))


@pytest.mark.parametrize("fault", ["dropped", "repeated", "not finite", "foreign fold"])
def test_broken_scored_tables_are_refused(spark, fault):
    study = Study(spark, 7, [1, 2], records=4, repeats=True)
    name, fold, a, b = study.rows[-1]
    last = {"dropped": [], "repeated": [study.rows[-1]] * 2, "not finite": [(name, fold, a, float("inf"))], "foreign fold": [(name, 9, a, b)]}
    broken = spark.createDataFrame(study.rows[:-1] + last[fault], SCORED)
    with pytest.raises(ContractViolation):
        assemble(Evaluation((1, 2), "per_split", "mean_over_splits", 4), broken, *study.coefficients())


def test_scores_equal_a_plain_computation_and_repeat(spark):
    rng = np.random.default_rng(8)
    table, target = rng.normal(size=(30, 3)), rng.normal(size=30)
    predictions = spark.createDataFrame([(f"r{i}", *row) for i, row in enumerate(table.tolist())], PREDICTED)
    labels = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(target.tolist())], "record_id string, target double")
    first, second = (score(predictions, labels, seed=40, replicates=60) for _ in range(2))
    assert sorted(first.paired.collect()) == sorted(second.paired.collect())
    found = {row["predictor"]: row["rmse"] for row in first.metrics.collect()}
    names = ["descriptor_prediction", "neural_prediction", "blend"]
    assert found == pytest.approx({n: float(np.sqrt(np.mean((table[:, k] - target) ** 2))) for k, n in enumerate(names)})
    assert len({row["seed"] for row in first.paired.collect()}) == first.paired.count()
    for wrong in ((predictions, labels.filter("record_id <> 'r3'")), (predictions.drop("blend"), labels)):
        with pytest.raises(ContractViolation):
            score(*wrong, replicates=5)


@pytest.mark.parametrize("changed", ["predictions", "labels", "coefficients", None])
def test_written_tables_are_proved_before_they_are_scored(spark, tmp_path, changed):
    from foldwise.plans.assembling import score_written, write_assembly

    study = Study(spark, 9, [0, 1])
    assembly = assemble(Evaluation((0, 1), "crossfit", "one_held_out", 12), study.scored, *study.coefficients())
    labels = assembly.predictions.select("record_id", (F.length("record_id") * 0.25).alias("target"))
    path = str(tmp_path / "a")
    assert {row["name"]: row["n"] for row in write_assembly(assembly, labels, path).collect()}["predictions"] == 12
    if changed is None:
        direct = score(assembly.predictions, labels, replicates=20)
        assert sorted(score_written(spark, path, replicates=20).metrics.collect()) == sorted(direct.metrics.collect())
        return
    column = {"predictions": "blend", "labels": "target", "coefficients": "alpha"}[changed]
    table = spark.createDataFrame(spark.read.parquet(f"{path}/{changed}").collect(), spark.read.parquet(f"{path}/{changed}").schema)
    least = F.col(column) == F.lit(table.agg(F.min(column)).first()[0])
    table.withColumn(column, F.when(least, F.col(column) + 1e-9).otherwise(F.col(column))).write.mode("overwrite").parquet(f"{path}/{changed}")
    with pytest.raises(ContractViolation, match="manifest"):
        score_written(spark, path, replicates=20)

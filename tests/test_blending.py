import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation, LabelAccessError
from foldwise.operators.blending import attach_alpha, blend, crossfit_rows, fit_alpha, fit_crossfit_alpha
from foldwise.operators.metrics import band, regression_metrics, subgroup_metrics

COLUMNS = "record_id string, target double, descriptor_prediction double, neural_prediction double"


@pytest.fixture(scope="module")
def core(spark):
    return spark.createDataFrame([(f"s{i}", 0.2 * i, 0.0, 1.0) for i in (1, 2, 3, 4)], COLUMNS)


def test_golden_weight_and_metrics(core):
    row = fit_alpha(core, by=[]).first()
    assert row["alpha"] == pytest.approx(0.5, abs=1e-15)
    mixed = core.withColumn("blend", blend("descriptor_prediction", "neural_prediction", row["alpha"]))
    m = regression_metrics(mixed, "target", ["blend"]).first()
    assert m["n"] == 4
    assert m["rmse"] == pytest.approx(0.22360679774997896, abs=1e-15)
    assert m["mae"] == pytest.approx(0.2, abs=1e-15)
    assert m["bias"] == pytest.approx(0.0, abs=1e-15)


def test_scored_rows_cannot_fit_a_weight(core):
    with pytest.raises(LabelAccessError):
        fit_alpha(core, by=[], role="scored")


def test_weight_is_clipped_and_has_a_default(spark):
    high = spark.createDataFrame([("a", 2.0, 0.0, 1.0), ("b", 2.0, 0.0, 1.0)], COLUMNS)
    assert fit_alpha(high, by=[]).first()["alpha"] == 1.0
    low = spark.createDataFrame([("a", -2.0, 0.0, 1.0)], COLUMNS)
    assert fit_alpha(low, by=[]).first()["alpha"] == 0.0
    flat = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0)], COLUMNS)
    assert fit_alpha(flat, by=[], default=0.25).first()["alpha"] == 0.25
    with pytest.raises(ContractViolation):
        fit_alpha(flat, by=[], default=1.5)


def test_blend_refuses_weights_outside_the_unit_interval():
    for alpha in (-0.1, 1.1, float("nan")):
        with pytest.raises(ContractViolation):
            blend("a", "b", alpha)


def test_crossfit_weight_equals_explicit_rows(spark):
    rows = [(f"r{i}", i % 3, 0.1 * i, 0.1 * i + 0.01 * (i % 7), 0.1 * i - 0.02 * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id string, fold_index int, target double, descriptor_prediction double, neural_prediction double")
    fast = {r[0]: r for r in fit_crossfit_alpha(df).collect()}
    slow = {r[0]: r for r in fit_alpha(crossfit_rows(df, [0, 1, 2])).collect()}
    assert fast.keys() == slow.keys()
    for fold in fast:
        assert fast[fold]["alpha"] == pytest.approx(slow[fold]["alpha"], abs=1e-12)
        assert fast[fold]["coefficient_rows"] == slow[fold]["coefficient_rows"] == 40


def test_attach_alpha_refuses_an_unmapped_fold(spark):
    scored = spark.createDataFrame([("a", 0), ("b", 1)], "record_id string, fold_index int")
    one = spark.createDataFrame([(0, 0.5)], "deployment_fold int, alpha double")
    with pytest.raises(Exception, match="no coefficient for fold 1"):
        attach_alpha(scored, one).collect()
    assert {r["alpha"] for r in attach_alpha(scored, one, single=True).collect()} == {0.5}


def test_subgroups_are_banded_and_flagged(spark):
    df = spark.createDataFrame([(float(i), 0.0, 1.0) for i in range(10)], "x double, y double, p double")
    result = subgroup_metrics(df, {"x": band("x", [3, 7], ["low", "mid", "high"])}, "y", ["p"], sparse=4)
    found = {r["level"]: (r["n"], r["sparse"], r["rmse"]) for r in result.collect()}
    assert found == {"low": (3, True, 1.0), "mid": (4, False, 1.0), "high": (3, True, 1.0)}
    missing = spark.createDataFrame([(None,)], "x double").select(band(F.col("x"), [1], ["a", "b"]).alias("b")).first()
    assert missing["b"] is None

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation
from foldwise.functions import numbers, vectors
from foldwise.operators import features as ft
from foldwise.operators.aggregates import masked_mean, mean_members, mean_vector
from foldwise.plans.units import prepare_unit


def frame(spark, columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} double" for n in names))


def plain_correlation(table, i, j):
    both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
    return abs(np.corrcoef(table[both, i], table[both, j])[0, 1])


@pytest.mark.parametrize("width", [2, 16, 17, 40])
def test_correlation_skips_missing_values_pair_by_pair_at_any_width(spark, width):
    rng = np.random.default_rng(width)
    table = rng.normal(1e3, 1, size=(300, width)) + rng.normal(size=(300, 1))
    table[rng.random(table.shape) < 0.1] = np.nan
    df = frame(spark, {f"x{k}": table[:, k].tolist() for k in range(width)})
    found = {(r["i"], r["j"]): r["correlation"] for r in ft.corr_pairs(df, df.columns).collect()}
    assert found == pytest.approx({(i, j): plain_correlation(table, i, j) for j in range(width) for i in range(j)})
    assert ft.corr_pairs(df, df.columns[:1]).count() == 0


@pytest.mark.parametrize("comparison", ["gt", "ge"])
def test_filter_equals_a_plain_one_on_random_columns(spark, comparison):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 4))
    table = np.hstack([base, base[:, [1, 3]] * [-2, 0.5] + rng.normal(size=(400, 2)) * [0.01, 1.0], np.full((400, 1), 3.5), base[:, :1] * 1e-9])
    table = np.hstack([table, np.where(rng.random((400, 1)) < 0.02, np.nan, base[:, :1]), base[:, [2]]])
    order = rng.permutation(table.shape[1])
    table = table[:, order]
    names = [f"col{k}" for k in order]
    df = frame(spark, {name: table[:, k].tolist() for k, name in enumerate(names)})
    expected, usable = {}, []
    for k, name in enumerate(names):
        column = table[:, k]
        if np.isnan(column).any():
            expected[name] = "missing"
        elif column.min() == column.max():
            expected[name] = "constant"
        elif column.var() <= 1e-12:
            expected[name] = "low_variance"
        else:
            late = any(plain_correlation(table, e, k) > 0.95 for e in usable)
            usable.append(k)
            expected[name] = "correlated" if late else "retained"
    assert set(expected.values()) == {"missing", "constant", "low_variance", "correlated", "retained"}
    fitted = ft.fit_feature_filter(df, names, ft.FilterConfig(correlation_threshold=0.95, comparison=comparison))
    assert dict(fitted.decisions) == expected
    kept = ft.apply_feature_filter(df, fitted, []).collect()
    assert np.allclose(sorted(map(tuple, kept)), sorted(map(tuple, table[:, [names.index(c) for c in fitted.retained]].tolist())))


def test_filters_that_keep_nothing_or_miss_a_setting_are_refused(spark):
    df = frame(spark, {"hole": [1.0, float("nan")], "flat": [2.0, 2.0]})
    with pytest.raises(ContractViolation):
        ft.fit_feature_filter(df, df.columns, ft.FilterConfig())
    with pytest.raises(ContractViolation):
        ft.fit_feature_filter(df, ["flat", "flat"], ft.FilterConfig())
    for wrong in ({"correlation_threshold": 0.5}, {"comparison": "gt"}, {"ddof": 2}):
        with pytest.raises(ContractViolation):
            ft.FilterConfig(**wrong)


def test_a_dropped_column_still_drops_later_ones(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=4000)
    b = a + 0.45 * rng.normal(size=4000)
    c = b + 0.45 * rng.normal(size=4000)
    df = frame(spark, {"a": a.tolist(), "b": b.tolist(), "c": c.tolist()})
    r = np.corrcoef([a, b, c])
    assert r[0, 1] > 0.88 and r[1, 2] > 0.88 and r[0, 2] < 0.88
    fitted = ft.fit_feature_filter(df, df.columns, ft.FilterConfig(correlation_threshold=0.88, comparison="gt"))
    assert fitted.retained == ["a"]


def test_unit_statistics_come_from_fit_rows_only(spark):
    rows = [("f1", 1.0, 5.0), ("f2", 2.0, 5.0), ("v1", 3.0, 6.0), ("s1", 10.0, 7.0), ("s2", 11.0, 8.0)]
    features = spark.createDataFrame(rows, "record_id string, varies double, fit_constant double")
    roles = spark.createDataFrame([("f1", "fit"), ("f2", "fit"), ("v1", "selection"), ("s1", "scored"), ("s2", "scored")], "record_id string, role string")
    labels = spark.createDataFrame([(r[0], 1.0) for r in rows], "record_id string, target double")
    unit = prepare_unit(features, roles, labels, ["varies", "fit_constant"], ft.FilterConfig())
    assert unit.fitted.with_status("constant") == ["fit_constant"]
    found = {r["record_id"]: (r["varies"], r["target"]) for r in unit.rows.collect()}
    assert found["s1"] == (10.0, None) and found["s2"] == (11.0, None) and found["f1"] == (1.0, 1.0)
    with pytest.raises(ContractViolation, match="features:absent"):
        prepare_unit(features.filter("record_id <> 's1'"), roles, labels, ["varies"], ft.FilterConfig())
    with pytest.raises(ContractViolation, match="label:absent"):
        prepare_unit(features, roles, labels.filter("record_id <> 'v1'"), ["varies"], ft.FilterConfig())


def test_block_scaler_clips_to_fit_limits(spark):
    df = spark.createDataFrame([("f1", True, 0.0, 4.0), ("f2", True, 2.0, 2.0), ("s", False, 100.0, -100.0)], "record_id string, fit boolean, a double, b double")
    scalers = ft.fit_block_scaler(df.filter("fit"), [["a"], ["b"]], 0.0)
    found = {r["record_id"]: r["features"] for r in ft.apply_block_scaler(df, scalers).collect()}
    assert found == {"f1": [-1.0, 1.0], "f2": [1.0, -1.0], "s": [1.0, -1.0]}
    plain = ft.fit_block_scaler(df.filter("fit"), [["a", "b"]])
    assert {r["record_id"]: r["features"] for r in ft.apply_block_scaler(df, plain).collect()}["s"] == [99.0, -103.0]


def test_zero_deviation_becomes_one(spark):
    df = frame(spark, {"c": [3.0, 3.0, 3.0], "x": [1.0, 2.0, 3.0]})
    scaler = ft.fit_zscore(df, ["c", "x"], ddof=1)
    assert scaler.scales == (1.0, 1.0) and scaler.means == (3.0, 2.0)
    tiny = frame(spark, {"x": [0.0, 1e-9]})
    assert ft.fit_clip_zscore(tiny, ["x"], 0.0).scales == (1.0,)


def test_failed_vectors_take_the_mean_of_usable_fit_vectors(spark):
    rows = [("a", True, False, [1.0, 2.0]), ("b", True, False, [3.0, 6.0]), ("c", True, True, [float("nan"), 0.0]), ("d", False, False, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "record_id string, fit boolean, failed boolean, embedding array<double>")
    mean = ft.fallback_vector(df, F.col("fit"))
    assert mean == [2.0, 4.0]
    assert {r["record_id"]: r["embedding"] for r in ft.fill_failed(df, mean).collect()}["c"] == [2.0, 4.0]
    with pytest.raises(ContractViolation):
        ft.fill_failed(df.withColumn("failed", F.lit(False)), mean)


def test_pca_blocks_have_unit_length(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(str(i), *map(float, rng.normal(size=4))) for i in range(30)], "record_id string, a double, b double, c double, d double")
    models = [ft.fit_pca_model(df, ["a", "b"], 5), ft.fit_pca_model(df, ["c", "d"], 5)]
    found = np.array([r["features"] for r in ft.apply_pca_blocks(df, models, 5).collect()])
    assert found.shape == (30, 10)
    assert np.allclose(np.linalg.norm(found, axis=1), 1.0)
    assert np.allclose(found[:, 2:5], 0.0)
    raw = df.select("a", "b").toPandas().to_numpy()
    z = (raw - raw.mean(0)) / raw.std(0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    projected = z @ axes.T
    projected /= np.linalg.norm(projected, axis=1, keepdims=True)
    assert np.allclose(np.abs(found[:, :2]) * np.sqrt(2.0), np.abs(projected), atol=1e-8)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>")
    row = df.select(
        vectors.l2_normalise("v").alias("u"), vectors.l2_normalise("z").alias("zero"), vectors.fit_length("v", 3).alias("pad"),
        vectors.fit_length("v", 1).alias("cut"), vectors.concat_blocks(["v", "z"]).alias("both"), vectors.distance("v", "z").alias("d"),
        vectors.radial_basis(F.lit(1.0)).alias("r"),
    ).first()
    assert row["u"] == [0.6, 0.8] and row["zero"] == [0.0, 0.0] and row["pad"] == [3.0, 4.0, 0.0] and row["cut"] == [3.0]
    assert row["both"] == [3.0, 4.0, 0.0, 0.0] and row["d"] == 5.0
    assert np.allclose(row["r"], np.exp(-((1.0 - np.linspace(0, 5, 16)) ** 2) / 0.25))


def test_number_expressions(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "t string")
    assert [r[0] for r in df.select(numbers.safe_float("t", -1.0)).collect()] == [1.5, -1.0, -1.0, -1.0, -1.0]
    hot = spark.createDataFrame([("a",), ("z",), (None,)], "t string").select(numbers.one_hot("t", ["a", "b"])).collect()
    assert [r[0] for r in hot] == [[1, 0, 0], [0, 0, 1], [0, 0, 1]]
    clipped = spark.createDataFrame([(5.0,), (-5.0,), (None,)], "x double").select(numbers.clip("x", -1, 1)).collect()
    assert [r[0] for r in clipped] == [1.0, -1.0, None]


def test_pooling_needs_an_unmasked_row(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 0, [9.0, 9.0]), ("b", 0, [1.0, 1.0])], "label string, mask int, embedding array<double>")
    with pytest.raises(ContractViolation):
        masked_mean(df)
    found = sorted((r["position"], r["value"]) for r in masked_mean(df.filter("label = 'a'")).collect())
    assert found == [(0, 1.0), (1, 2.0)]
    assert mean_vector(df.withColumn("embedding", F.array(F.lit(float("nan"))))).count() == 0


def test_members(spark):
    rows = [("b", 0, 2.0, 0), ("a", 0, 1.0, 1), ("b", 1, 4.0, 2), ("a", 1, 5.0, 3)]
    df = spark.createDataFrame(rows, "record_id string, member int, prediction double, ord int")
    found = mean_members(df, 2, 2, order="ord").orderBy("ord").collect()
    assert [(r["record_id"], r["prediction"]) for r in found] == [("b", 3.0), ("a", 3.0)]
    mismatch = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("b", 2, 4.0)], "record_id string, member int, prediction double")
    with pytest.raises(ContractViolation):
        mean_members(mismatch, 2)
    with pytest.raises(ContractViolation):
        mean_members(df, 2, 3)

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation
from foldwise.operators import reports
from foldwise.operators.features import FeatureFilter
from foldwise.operators.search import (
    SEARCH_SPACES,
    BoostedTrees,
    best_stage,
    candidate_grid,
    fit_gbt,
    gbt_parameters,
    penalised,
    reuse_model,
    save_run,
    search_trials,
    select_nested,
    select_trial,
    trial_problems,
)
from foldwise.plans.comparing import comparator_report

NESTED = "trial int, inner_validation_fold int, n bigint, sse double, rmse double, mae double, best_iteration int"


def test_the_smallest_error_wins_and_ties_go_to_the_lower_trial(spark):
    rng = random.Random(21)
    for _ in range(3):
        rows = [(trial, rng.choice([0.25, 0.5, 0.75]), rng.randrange(50)) for trial in rng.sample(range(90), 12)]
        row = select_trial(spark.createDataFrame(rows, "trial int, rmse double, best_iteration int")).first()
        assert (row["rmse"], row["trial"], row["best_iteration"]) == min((e, t, b) for t, e, b in rows)


def test_nested_selection_pools_squared_errors(spark):
    rng = random.Random(22)
    sizes = {fold: rng.randint(1, 40) for fold in range(5)}
    rows = []
    for trial in range(7):
        for fold, n in sizes.items():
            sse = rng.uniform(0, 3) * n
            rows.append((trial, fold, n, sse, math.sqrt(sse / n), rng.random(), rng.randrange(60)))
    df = spark.createDataFrame(rows, NESTED)
    pooled = {t: math.sqrt(sum(r[3] for r in rows if r[0] == t) / sum(sizes.values())) for t in range(7)}
    best = min(pooled, key=pooled.get)
    kept = [r[6] for r in sorted(r for r in rows if r[0] == best)]
    row = select_nested(df).first()
    assert row["trial"] == best and row["inner_best_iterations"] == kept
    assert row["pooled_inner_rmse"] == pytest.approx(pooled[best])
    assert row["final_tree_count"] == math.floor(statistics.median(k + 1 for k in kept))
    assert trial_problems(df, nested=True).count() == 0
    two = select_nested(df.filter(f"trial = {best} and inner_validation_fold < 2")).first()
    assert two["final_tree_count"] == math.floor((kept[0] + kept[1]) / 2 + 1)


def test_broken_trial_records_are_found(spark):
    fractional = spark.createDataFrame([(0.5, 0.8)], "trial double, rmse double")
    assert trial_problems(fractional).count() == 1
    rows = [(0, 1, 1, 0.1, 0.1, 0.1, 1), (0, 2, 1, 0.1, 0.1, 0.1, 1), (1, 1, 0, 0.1, 0.1, 0.1, 1), (1, 1, 1, 0.1, 0.1, float("nan"), 1)]
    found = {r["problem"] for r in trial_problems(spark.createDataFrame(rows, NESTED), nested=True).collect()}
    assert found == {"n:integer", "best_iteration:missing", "repeated", "inner_folds_differ", "mae:missing"} - {"best_iteration:missing"}


def test_grids_respect_their_bounds(spark):
    units = spark.createDataFrame([(0,), (1,)], "fold_index int")
    grid = candidate_grid(units, SEARCH_SPACES["supplied"], 200, F.col("fold_index") + 7).persist()
    row = grid.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("n_estimators", "max_depth", "learning_rate", "subsample") for f in (F.min, F.max)]).first()
    assert 600 <= row["min_n_estimators"] and row["max_n_estimators"] <= 1200
    assert (row["min_max_depth"], row["max_max_depth"]) == (4, 8)
    assert 10**-2.05 <= row["min_learning_rate"] and row["max_learning_rate"] <= 10**-0.75
    assert 0.65 <= row["min_subsample"] and row["max_subsample"] <= 1.0
    assert grid.count() == 400
    again = candidate_grid(units.repartition(3), SEARCH_SPACES["supplied"], 200, F.col("fold_index") + 7)
    assert again.exceptAll(grid).count() == 0
    choices = candidate_grid(units, SEARCH_SPACES["global"], 50, 1).select("max_depth").distinct().count()
    assert choices == 6


def test_parameters_without_a_twin_are_refused():
    assert gbt_parameters({"trial": 3, "min_child_weight": 2.2, "max_depth": 4}) == {"minInstancesPerNode": 3, "maxDepth": 4}
    with pytest.raises(ContractViolation):
        gbt_parameters({"gamma": 1.0})


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"r{i}", float(i % 17), float((i * 7) % 11), float(i % 17) * 0.5, ["fit", "fit", "selection", "scored"][i % 4]) for i in range(200)]
    return spark.createDataFrame(data, "record_id string, a double, b double, target double, role string").persist()


def test_search_and_reuse(spark, rows, tmp_path):
    candidates = [{"trial": 1, "n_estimators": 1, "max_depth": 1}, {"trial": 0, "n_estimators": 3, "max_depth": 3}]
    result = search_trials(rows, ["a", "b"], candidates, lambda t: t)
    assert result.trial == 0 and result.records.count() == 2
    best = select_trial(result.records).first()
    assert best["trial"] == result.trial and best["n"] == 50
    with pytest.raises(ContractViolation):
        search_trials(rows, ["a", "b"], [], lambda t: t)
    with pytest.raises(ContractViolation):
        search_trials(rows, ["a", "b"], [{"trial": 1}, {"trial": 1}], lambda t: t)
    fitted = FeatureFilter((("a", "retained"), ("b", "retained"), ("c", "constant")))
    path, facts = str(tmp_path / "run"), {"design": "d", "branch": "tabular", "fold": "2", "scored_labels_accessed": "False"}
    save_run(path, result.model, fitted, facts)
    table = rows.select("record_id", "a", "b")
    again = {r["record_id"]: r["prediction"] for r in reuse_model(path, table, {"fold": "2"}).collect()}
    direct = {r["record_id"]: r["prediction"] for r in result.model.transform(table).collect()}
    assert again == direct
    with pytest.raises(ContractViolation):
        reuse_model(path, table, {"fold": "3"})


def test_the_best_stage_is_that_of_a_plain_loop():
    rng = random.Random(3)
    for _ in range(200):
        errors = [rng.choice([1, 2, 3, 4, 5]) / rng.randint(1, 9) for _ in range(rng.randint(1, 25))]
        patience, best, waited = rng.randint(1, 6), 0, 0
        for i in range(1, len(errors)):
            waited = 0 if errors[i] < errors[best] else waited + 1
            best = best if waited else i
            if waited >= patience:
                break
        assert best_stage(errors, patience) == best


@pytest.mark.parametrize("penalties", [{}, {"reg_alpha": 0.3, "reg_lambda": 1.5}])
def test_an_ensemble_is_cut_at_its_best_tree(rows, penalties):
    noisy = rows.withColumn("target", F.col("target") + F.hash("record_id") % 5).withColumn("v", F.col("role") == "selection")
    parameters = {"n_estimators": 14, "max_depth": 4, "learning_rate": 0.9} | penalties
    whole = fit_gbt(noisy.filter("not v"), ["a", "b"], parameters, 1)
    selection = noisy.filter("v")
    prefixes = []
    for trees in range(1, 15):
        scored = whole.first(trees).transform(selection)
        prefixes.append(scored.agg(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()[0])
    assert whole.errors(selection) == pytest.approx(prefixes)
    cut = fit_gbt(noisy, ["a", "b"], parameters, 1, validation="v", patience=2)
    assert cut.trees == best_stage(prefixes, 2) + 1 < 14
    row = cut.transform(selection).agg(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()
    assert row[0] == pytest.approx(prefixes[cut.trees - 1])


def test_leaf_values_are_those_of_plain_sums(rows, tmp_path):
    fit = rows.filter("role = 'fit'")
    own = fit_gbt(fit, ["a", "b"], {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3}, 1)
    table = own.leaves(fit).toPandas()
    reached, alpha, penalty = [0.0] * len(table), 2.0, 3.0
    found = penalised(own, fit, alpha, penalty)
    for tree, weight in enumerate(own.model.treeWeights):
        leaf = [leaves[tree] for leaves in table["_leaves"]]
        for one in set(leaf):
            inside = [i for i, x in enumerate(leaf) if x == one]
            total = sum(table["target"][i] - reached[i] for i in inside)
            value = math.copysign(max(0.0, abs(total) - alpha), total) / (len(inside) + penalty) * weight * (2 if tree else 1)
            assert found.leaf_values[tree][one] == pytest.approx(value)
        reached = [r + found.leaf_values[tree][x] for r, x in zip(reached, leaf)]
    predicted = [row["prediction"] for row in found.transform(fit).collect()]
    assert predicted == pytest.approx(reached)
    plain = [row["prediction"] for row in own.transform(fit).collect()]
    assert [row["prediction"] for row in penalised(own, fit, 0.0, 0.0).transform(fit).collect()] == pytest.approx(plain)
    found.save(str(tmp_path / "m"))
    assert [row["prediction"] for row in BoostedTrees.load(str(tmp_path / "m")).transform(fit).collect()] == predicted
    with pytest.raises(ContractViolation):
        fit_gbt(fit, ["a", "b"], {"n_estimators": 1, "reg_lambda": -1.0}, 1)


def test_a_tree_budget_is_for_candidates_without_their_own_number(rows):
    result = search_trials(rows, ["a", "b"], [{"max_depth": 2}], lambda t: t, patience=1, tree_budget=4)
    assert result.parameters == {"max_depth": 2, "n_estimators": 4} and result.model.trees <= 4
    with pytest.raises(ContractViolation):
        search_trials(rows, ["a", "b"], [{"n_estimators": 2}], lambda t: t, tree_budget=4)


REPORT = "model string, panel string, n bigint, rmse double, delta double, ci95_low double, ci95_high double, ci99_low double, ci99_high double"


def result_row(model, panel, rmse, high95, high99):
    return (model, panel, 10, rmse, high95 - 0.1, high95 - 0.2, high95, high99 - 0.5, high99)


def test_report(spark):
    rows = [
        result_row("m1", "p1", 0.5, -0.2, -0.1), result_row("m2", "p1", 0.5 + 1e-13, -0.2, -0.1),
        result_row("m1", "p2", 0.7, -0.1, 0.1), result_row("m1", "p3", 0.9, 0.1, 0.2), result_row("m2", "p3", 0.8, -0.2, -0.1),
    ]
    results = spark.createDataFrame(rows, REPORT)
    table = {(r["model"], r["panel"]): r for r in comparator_report(results, results, results).collect()}
    assert len(table) == 6 and not table["m2", "p2"]["available"] and table["m2", "p2"]["display"] == ""
    assert table["m1", "p1"]["is_lowest"] and table["m2", "p1"]["is_lowest"] and not table["m1", "p3"]["is_lowest"]
    assert {p: table["m1", p]["tier"] for p in ("p1", "p2", "p3")} == {"p1": "***", "p2": "**", "p3": ""}
    assert table["m1", "p1"]["display"] == "0.500"
    with pytest.raises(ContractViolation):
        reports.single_value(results, ["panel"], "rmse").collect()
    broken = spark.createDataFrame([result_row("m1", "p1", 0.5, 0.2, 0.1)], REPORT)
    with pytest.raises(ContractViolation):
        comparator_report(broken, broken, broken)


def test_nested_fold_end_to_end(spark, tmp_path):
    from foldwise.operators.features import FilterConfig
    from foldwise.plans.units import prepare_unit, run_fold, run_nested_fold

    ids = [f"r{i}" for i in range(90)]
    features = spark.createDataFrame([(r, float(i % 13), float((i * 5) % 7), 1.0) for i, r in enumerate(ids)], "record_id string, a double, b double, c double")
    labels = spark.createDataFrame([(r, 0.5 * (i % 13)) for i, r in enumerate(ids)], "record_id string, target double")
    parts = spark.createDataFrame(
        [(r, f, "scored" if i % 3 == f else "fit") for i, r in enumerate(ids) for f in range(3)], "record_id string, fold_index int, role string"
    )
    path = str(tmp_path / "nested")
    candidates = [{"trial": 0, "max_depth": 1}, {"trial": 1, "max_depth": 4}]
    predictions, records = run_nested_fold(
        features, parts, labels, ["a", "b", "c"], FilterConfig(), 0, candidates, 7, [1, 2], 3, path, {"fold": "0"}
    )
    assert sorted(r["record_id"] for r in predictions.collect()) == sorted(ids[0::3])
    assert sorted((r["trial"], r["inner_validation_fold"], r["n"]) for r in records.collect()) == [(t, g, 30) for t in (0, 1) for g in (1, 2)]
    assert trial_problems(records, nested=True).count() == 0
    with pytest.raises(ContractViolation):
        run_nested_fold(features, parts, labels, ["a"], FilterConfig(), 0, [{"n_estimators": 2}], 7, [1], 3)
    role = F.when(F.col("role") == "scored", F.lit("scored")).when(F.hash("record_id") % 4 == 0, F.lit("selection")).otherwise(F.lit("fit"))
    unit = prepare_unit(features, parts.filter("fold_index = 0").select("record_id", role.alias("role")), labels, ["a", "b", "c"], FilterConfig())
    selected, _ = run_fold(unit, [{"n_estimators": 2, "max_depth": 2}], 3)
    refitted, _ = run_fold(unit, [{"n_estimators": 2, "max_depth": 2}], 3, [5, 6], str(tmp_path / "refit"))
    assert selected.count() == refitted.count() == 30


def test_every_drawn_candidate_can_be_fitted(spark):
    units = spark.createDataFrame([(0,)], "fold_index int")
    for name, space in SEARCH_SPACES.items():
        for row in candidate_grid(units, space, 3, F.lit(5)).collect():
            drawn = {k: v for k, v in row.asDict().items() if k not in ("fold_index", "trial")}
            values = gbt_parameters(drawn)
            assert 0 < float(values["featureSubsetStrategy"]) <= 1, name
    with pytest.raises(ContractViolation):
        gbt_parameters({"gamma": 1.0})

"""Queries on candidate grids, selection, fitting, inference and model reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.features import FilterConfig, apply_feature_filter, fit_feature_filter
from ..operators.search import (
    best_iteration,
    fit_gbt,
    penalised,
    predict_batch,
    refit_ensemble,
    reuse_model,
    save_run,
    search_trials,
    select_nested,
    select_trial,
    trial_problems,
)
from ..operators.keys import rows_in
from ..plans.units import prepare_unit, run_fold, run_nested_fold
from ..session import shared_folder, written
from . import query
from .features import FILTER_SQL
from .metrics import rounded
from .views import with_views
from ..operators.metrics import regression_metrics


@query(
    "f1_select_trial",
    with_views("""select inner_validation_fold, trial, rmse, best_iteration from (select *, row_number() over (partition by inner_validation_fold order by rmse, trial) as r from v_trials) where r=1"""),
)
def f1(spark, d):
    best = select_trial(fx.v_trials(spark, d), ["inner_validation_fold"])
    return best.select("inner_validation_fold", "trial", "rmse", "best_iteration")


@query(
    "f2_select_nested",
    with_views("""with s as (select trial, sqrt(sum(sse)/sum(n)) as pooled, avg(rmse) as mean_rmse, avg(mae) as mean_mae, cast(sum(n) as bigint) as n,
        cast(floor(median(best_iteration+1)) as int) as trees, string_agg(cast(best_iteration as varchar), ',' order by inner_validation_fold) as its from v_trials group by trial)
      select trial, round(pooled,6) as pooled_inner_rmse, round(mean_rmse,6) as mean_fold_rmse, round(mean_mae,6) as mean_fold_mae, n as inner_n, trees as final_tree_count, its as iterations
      from s order by pooled, mean_rmse, trial limit 1"""),
)
def f2(spark, d):
    best = select_nested(fx.v_trials(spark, d))
    shown = best.withColumn("iterations", F.array_join(F.col("inner_best_iterations").cast("array<string>"), ","))
    return rounded(shown, "pooled_inner_rmse", "mean_fold_rmse", "mean_fold_mae").select(
        "trial", "pooled_inner_rmse", "mean_fold_rmse", "mean_fold_mae", "inner_n", "final_tree_count", "iterations"
    )


@query(
    "f2_trial_problems",
    with_views("""select cast(trial as varchar) as trial, 'mae:missing' as problem from v_trials where trial=2 and inner_validation_fold=3
      union all select cast(trial as varchar), 'best_iteration:integer' from v_trials where trial=1
      union all select 'all', 'inner_folds_differ' from (select count(*) as n from v_trials) where n>0"""),
)
def f2_problems(spark, d):
    trials = fx.v_trials(spark, d)
    third = (F.col("trial") == 2) & (F.col("inner_validation_fold") == 3)
    broken = trials.filter("not (trial = 4 and inner_validation_fold = 0)").withColumns(
        {
            "mae": F.when(~third, F.col("mae")),
            "best_iteration": F.when(F.col("trial") == 1, -F.col("best_iteration")).otherwise(F.col("best_iteration")),
        }
    )
    return trial_problems(broken, nested=True)


CONFIG = FilterConfig(1e-12, 0, 0.95, "gt")
CANDIDATES = [
    {"trial": 0, "n_estimators": 4, "learning_rate": 0.3, "max_depth": 3, "min_child_weight": 1.0, "subsample": 1.0},
    {"trial": 1, "n_estimators": 6, "learning_rate": 0.2, "max_depth": 2, "min_child_weight": 2.5, "subsample": 0.8},
    {"trial": 2, "n_estimators": 3, "learning_rate": 0.5, "max_depth": 3, "min_child_weight": 1.0, "subsample": 1.0},
]


def _unit(spark, d):
    features = fx.v_feat(spark, d)
    roles = fx.v_pred(spark, d).join(features.select("record_id"), "record_id", "left_semi")
    role = F.when(F.col("fold_index") == 0, F.lit("scored")).when(F.col("fold_index") == 1, F.lit("selection")).otherwise(F.lit("fit"))
    return prepare_unit(features, roles.select("record_id", role.alias("role")), fx.v_label(spark, d), fx.FEATURES, CONFIG)


# The rows of a unit, as _unit makes them: role by fold.
_UNIT = "select f.record_id, case p.fold_index when 0 then 'scored' when 1 then 'selection' else 'fit' end as role from v_feat f join v_pred p using (record_id)"
PENALISED = CANDIDATES[0] | {"reg_alpha": 0.5, "reg_lambda": 2.0}


@query(
    "k2_fit_gbt",
    with_views(f"select 'prediction' as predictor, count(*) as n, true as least_error, true as error_fits from ({_UNIT}) where role='selection'"),
)
def k2(spark, d):
    """The ensemble ends at the tree with the least error, and its error is that of its predictions."""
    with _unit(spark, d) as unit:
        rows = unit.rows.filter("role <> 'scored'").withColumn("validation", F.col("role") == "selection")
        model = fit_gbt(rows, unit.fitted.retained, CANDIDATES[0], 7, validation="validation", patience=2)
        chosen = rows.filter("validation")
        errors = model.errors(chosen)
        row = regression_metrics(model.transform(chosen), "target", ["prediction"]).first()
        least = best_iteration(model) == len(errors) - 1 and errors[-1] <= min(errors) + 1e-9  # sums differ in their last digits
        facts = (row["predictor"], row["n"], least, abs(row["rmse"] ** 2 - errors[-1]) < 1e-9)
        return spark.createDataFrame([facts], "predictor string, n bigint, least_error boolean, error_fits boolean")


@query(
    "k2_leaf_penalties",
    with_views(f"select count(*) as n, true as no_penalty_changes_nothing, true as drawn_to_zero from ({_UNIT}) where role<>'scored'"),
)
def k2_penalties(spark, d):
    """Without penalties the leaf values are the fit's own; with them the first tree's predictions are nearer to zero."""
    with _unit(spark, d) as unit:
        rows = unit.rows.filter("role <> 'scored'")
        own = fit_gbt(rows, unit.fitted.retained, CANDIDATES[0], 7)
        same = penalised(own, rows, 0.0, 0.0).transform(own.transform(rows).withColumnRenamed("prediction", "own"))
        less = fit_gbt(rows, unit.fitted.retained, PENALISED, 7).first(1).transform(own.first(1).transform(rows).withColumnRenamed("prediction", "own"))
        gap = same.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("own") - F.col("prediction"))).alias("gap")).first()
        drawn = less.agg(F.bool_and((F.abs("prediction") < F.abs("own")) & (F.col("prediction") * F.col("own") >= 0))).first()[0]
        return spark.createDataFrame([(gap["n"], gap["gap"] < 1e-6, drawn)], "n bigint, no_penalty_changes_nothing boolean, drawn_to_zero boolean")


@query(
    "k3_search_trials",
    with_views(f"""select trial, (select count(*) from ({_UNIT}) where role='selection') as n, true as sse_fits, true as within_budget, 1 as selected, true as selected_is_least
        from (values (0), (1), (2)) t(trial)"""),
)
def k3(spark, d):
    with _unit(spark, d) as unit:
        result = search_trials(unit.rows, unit.fitted.retained, CANDIDATES, lambda t: 90 + t, patience=2)
        chosen = F.col("trial") == result.trial
        budget = F.create_map(*[F.lit(x) for c in CANDIDATES for x in (c["trial"], c["n_estimators"])])
        least = F.min(F.struct("rmse", "trial")).over(Window.partitionBy(F.lit(0)))["trial"]
        return result.records.select(
            "trial",
            "n",
            (F.abs(F.col("sse") / F.col("n") - F.col("rmse") * F.col("rmse")) < 1e-9).alias("sse_fits"),
            F.col("best_iteration").between(0, budget[F.col("trial")] - 1).alias("within_budget"),
            F.sum(chosen.cast("int")).over(Window.partitionBy(F.lit(0))).cast("int").alias("selected"),
            (least == result.trial).alias("selected_is_least"),
        )


@query("k4_refit_ensemble", with_views(f"select record_id, true as is_mean from ({_UNIT}) where role='scored'"))
def k4(spark, d):
    unit = _unit(spark, d)
    scored = unit.rows.filter("role = 'scored'").drop("target", "role")
    predictions, models = refit_ensemble(
        unit.rows.filter("role <> 'scored'"), scored, unit.fitted.retained, CANDIDATES[0], 3, [11, 12]
    )
    one, two = (model.transform(scored).select("record_id", F.col("prediction").alias(f"p{i}")) for i, model in enumerate(models))
    compared = predictions.join(one, "record_id").join(two, "record_id")
    found = compared.select("record_id", (F.abs(F.col("prediction") - (F.col("p0") + F.col("p1")) / 2) < 1e-9).alias("is_mean"))
    return _released(unit, found)


def _released(unit, found):
    """The rows of a query that is done with its unit."""
    found = written(found)
    unit.close()
    return found


@query(
    "k5_predict_batch",
    with_views("select record_id, round(list_sum(list_transform(list_zip(embedding, range(1,65)), lambda p: p[1]::double*p[2]/64e0)),5) as prediction from v_emb"),
)
def k5(spark, d):
    def make_predict():
        import numpy as np

        weights = np.arange(1, 65) / 64.0
        return lambda batch: batch.astype("float64") @ weights

    return rounded(predict_batch(fx.v_emb(spark, d), make_predict, dimension=64), "prediction", decimals=5)


@query("k6_reuse_model", with_views("select record_id, true as same from v_feat"))
def k6(spark, d):
    """A model with leaf penalties, written, read again in another run, and compared with the one that was fitted."""
    unit = _unit(spark, d)
    model = fit_gbt(unit.rows.filter("role <> 'scored'"), unit.fitted.retained, PENALISED, 5)
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    facts = {"design": "native_holdout", "branch": "tabular", "fold": "0", "scored_labels_accessed": "False"}
    save_run(path, model, unit.fitted, facts)
    expected = {"design": "native_holdout", "branch": "tabular", "fold": "0"}
    features = fx.v_feat(spark, d)
    own = model.transform(apply_feature_filter(features, unit.fitted)).select("record_id", F.col("prediction").alias("own"))
    again = reuse_model(path, features, expected).join(own, "record_id")
    return _released(unit, again.select("record_id", (F.abs(F.col("prediction") - F.col("own")) < 1e-12).alias("same")))


_SCORED = with_views(f"select record_id, true as usable from ({_UNIT}) where role='scored'")


def _usable(predictions, labels):
    """Scored ids, and whether a prediction lies in the range of all labels, widened by itself on both sides."""
    low, high = labels.agg(F.min("target"), F.max("target")).first()
    usable = F.col("prediction").between(2 * low - high, 2 * high - low)
    return predictions.select("record_id", usable.alias("usable"))


@query("l7_run_fold", _SCORED)
def l7(spark, d):
    path = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    facts = {"design": "native_holdout", "branch": "tabular", "fold": "0"}
    predictions, _ = run_fold(_unit(spark, d), CANDIDATES[:2], 31, [11, 12], path, facts, patience=3)
    return _usable(predictions, fx.v_label(spark, d))


@query("l7_run_selected_fold", _SCORED)
def l7_selected(spark, d):
    unit = _unit(spark, d)
    candidates = [{k: v for k, v in c.items() if k != "n_estimators"} for c in CANDIDATES[:2]]
    found = run_fold(unit, candidates, 31, tree_budget=5, patience=2)[0]
    return _released(unit, _usable(found, fx.v_label(spark, d)))


@query("l7_run_nested_fold", with_views("select f.record_id, true as usable from v_feat f join v_part p using (record_id) where p.fold_index=0 and p.role='scored'"))
def l7_nested(spark, d):
    features = fx.v_feat(spark, d)
    parts = rows_in(fx.v_part(spark, d), features.select("record_id"))
    candidates = [{k: v for k, v in c.items() if k != "n_estimators"} for c in CANDIDATES[:2]]
    path = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    predictions, _ = run_nested_fold(
        features, parts, fx.v_label(spark, d), fx.FEATURES, CONFIG, 0, candidates, 47, [51, 52], 3, path, {"fold": "0"}, patience=2
    )
    return _usable(predictions, fx.v_label(spark, d))


@query("j1_retained_columns", f"select column_name from ({with_views(FILTER_SQL)}) where status='retained'")
def retained(spark, d):
    fitted = fit_feature_filter(fx.v_feat(spark, d), fx.FEATURES, CONFIG)
    return fitted.report(spark).filter("status = 'retained'").select(F.col("column").alias("column_name"))

"""Candidate grids, boosted-tree fitting, trial search and selection, refit, inference, model reuse.

Trees are Spark ML's. Penalties on leaf values, which it lacks, are put on afterwards: each tree's leaves get their values
anew from the residuals of the trees before it. With a patience, a long ensemble is judged tree by tree on the selection
rows and cut at its best tree. Parameters of other libraries that have no twin are refused, never ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractViolation
from ..functions.hashing import uniform
from ..functions.numbers import is_finite
from ..session import collect_small, reliable_checkpoint, shared_folder
from .aggregates import mean_members_wide, nested_summary
from .checks import finite_violations, key_violations
from .features import FeatureFilter, FilterConfig, apply_feature_filter
from .metrics import regression_metrics

# Search spaces. log_uniform bounds are exponents of ten; integer bounds include the
# lower and exclude the upper one.
SEARCH_SPACES = {
    "native": {
        "n_estimators": ("constant", 3500),
        "learning_rate": ("log_uniform", -2.2, -0.8),
        "max_depth": ("integer", 3, 9),
        "min_child_weight": ("log_uniform", -0.2, 1.25),
        "subsample": ("uniform", 0.62, 1.0),
        "colsample_bytree": ("uniform", 0.45, 1.0),
        "reg_alpha": ("log_uniform", -5.0, 0.0),
        "reg_lambda": ("log_uniform", -1.0, 1.35),
    },
    "global": {
        "n_estimators": ("choice", [700, 1000, 1400, 2000, 2800, 3800]),
        "learning_rate": ("log_uniform", -2.1, -1.05),
        "max_depth": ("choice", [3, 4, 5, 6, 7, 8]),
        "min_child_weight": ("log_uniform", -0.25, 1.2),
        "subsample": ("uniform", 0.6, 1.0),
        "colsample_bytree": ("uniform", 0.45, 1.0),
        "reg_alpha": ("log_uniform", -6.0, 0.3),
        "reg_lambda": ("log_uniform", -0.7, 1.4),
    },
    "supplied": {
        "n_estimators": ("integer", 600, 1201),
        "learning_rate": ("log_uniform", -2.05, -0.75),
        "max_depth": ("integer", 4, 9),
        "min_child_weight": ("log_uniform", -0.25, 1.15),
        "subsample": ("uniform", 0.65, 1.0),
        "colsample_bytree": ("uniform", 0.45, 1.0),
        "reg_alpha": ("log_uniform", -5.0, -0.15),
        "reg_lambda": ("log_uniform", -2.0, 1.2),
    },
}

# Trials per search space.
TRIALS = {"native": 24, "global": 36, "supplied": 16}

GBT_PARAMETERS = ("n_estimators", "learning_rate", "max_depth", "min_child_weight", "subsample", "colsample_bytree")
LEAF_PENALTIES = ("reg_alpha", "reg_lambda")
CHECKPOINT_TREES = 10
PATIENCE = 50


def _draw(rule: Sequence, u: Column) -> Column:
    kind = rule[0]
    if kind == "constant":
        return F.lit(rule[1])
    if kind == "log_uniform":
        return F.pow(F.lit(10.0), F.lit(float(rule[1])) + F.lit(float(rule[2]) - float(rule[1])) * u)
    if kind == "uniform":
        return F.lit(float(rule[1])) + F.lit(float(rule[2]) - float(rule[1])) * u
    if kind == "integer":
        return (F.lit(int(rule[1])) + F.floor(u * F.lit(int(rule[2]) - int(rule[1])))).cast("int")
    if kind == "choice":
        return F.element_at(F.array(*[F.lit(v) for v in rule[1]]), (F.floor(u * len(rule[1])) + 1).cast("int"))
    raise ContractViolation(f"unknown draw: {kind}")


def candidate_grid(units: DataFrame, space: Mapping[str, Sequence], trials: int, seed) -> DataFrame:
    """``trials`` seeded candidates for each row of ``units`` (one per fold, for example).

    ``seed`` is a number or a column of ``units``. A draw is a hash of (seed, parameter, trial).
    """
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    rows = units.withColumn("_seed", head).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(int(trials) - 1))))
    drawn = {
        name: _draw(rule, uniform(F.concat_ws(":", "_seed", F.lit(name), F.col("trial").cast("string"))))
        for name, rule in space.items()
    }
    return rows.withColumns(drawn).drop("_seed")


def check_trials(trials: Sequence[int]) -> None:
    """Trials are told apart by their number."""
    wrong = sorted(t for t in set(trials) if t < 0 or list(trials).count(t) > 1)
    if wrong:
        raise ContractViolation(f"trial numbers are negative or repeated: {wrong}")


def with_budget(trial: int, source: Mapping, tree_budget: int | None) -> dict:
    """The parameters of a candidate, with the number of trees that a budget sets."""
    chosen = {k: v for k, v in source.items() if k != "trial"}
    if tree_budget is not None:
        if "n_estimators" in chosen:
            raise ContractViolation(f"trial {trial} brings n_estimators although tree_budget sets it")
        chosen["n_estimators"] = int(tree_budget)
    return chosen


def gbt_parameters(parameters: Mapping[str, float]) -> dict:
    """Parameters in Spark ML's terms; one without a twin is refused.

    With squared error each row weighs one, so a minimum child weight is a minimum row count. Penalties on leaf
    values are no parameters of the trees; :func:`fit_gbt` puts them on.
    """
    unknown = sorted(set(parameters) - set(GBT_PARAMETERS) - set(LEAF_PENALTIES) - {"trial"})
    if unknown:
        raise ContractViolation(f"no Spark ML counterpart for parameters {unknown}")
    values = {}
    if "n_estimators" in parameters:
        values["maxIter"] = int(parameters["n_estimators"])
    if "learning_rate" in parameters:
        values["stepSize"] = float(parameters["learning_rate"])
    if "max_depth" in parameters:
        values["maxDepth"] = int(parameters["max_depth"])
    if "min_child_weight" in parameters:
        values["minInstancesPerNode"] = max(1, math.ceil(float(parameters["min_child_weight"])))
    if "subsample" in parameters:
        values["subsamplingRate"] = float(parameters["subsample"])
    if "colsample_bytree" in parameters:  # the share of columns is drawn per node there
        values["featureSubsetStrategy"] = str(float(parameters["colsample_bytree"]))
    return values


@dataclass
class BoostedTrees:
    """A fitted ensemble: Spark ML's trees, and the leaf values per tree where penalties have changed them."""

    features: list[str]
    model: GBTRegressionModel
    leaf_values: list[list[float]] | None = None

    @property
    def trees(self) -> int:
        return len(self.leaf_values) if self.leaf_values is not None else self.model.getNumTrees

    def leaves(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_leaves``: the leaf of each tree that a row falls into."""
        shown = self.model.copy().setLeafCol("_vector").setPredictionCol("_own")
        found = shown.transform(self.assembled(df)).withColumn("_leaves", vector_to_array("_vector").cast("array<int>"))
        return found.drop("_vector", "_own", "_features")

    def assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features").transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``prediction``."""
        if self.leaf_values is None:
            return self.model.transform(self.assembled(df)).drop("_features")
        table = F.array(*[F.array(*map(F.lit, values)) for values in self.leaf_values])
        terms = F.zip_with(F.slice("_leaves", 1, self.trees), table, lambda leaf, values: F.get(values, leaf))
        added = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
        return self.leaves(df).withColumn("prediction", added).drop("_leaves")

    def errors(self, df: DataFrame, target: str = "target") -> list[float]:
        """Mean squared error on ``df`` of the first tree alone, the first two, and so on, from one pass."""
        if self.leaf_values is None:
            return self.model.evaluateEachIteration(self.assembled(df), "squared")
        values, count = self.leaf_values, self.trees

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, rows = np.zeros(count), 0
            for frame in frames:
                leaves = np.stack(frame["_leaves"].to_numpy()) if len(frame) else np.empty((0, count), int)
                terms = np.column_stack([np.take(values[t], leaves[:, t]) for t in range(count)])
                sums += ((frame["_target"].to_numpy()[:, None] - np.cumsum(terms, axis=1)) ** 2).sum(axis=0)
                rows += len(frame)
            yield pd.DataFrame({"tree": np.arange(count), "sse": sums, "n": rows})

        parts = self.leaves(df).select(F.col(target).cast("double").alias("_target"), "_leaves").mapInPandas(partial, "tree int, sse double, n bigint")
        summed = parts.groupBy("tree").agg((F.sum("sse") / F.sum("n")).alias("mse"))
        return [row["mse"] for row in sorted(summed.collect())]

    def first(self, trees: int) -> BoostedTrees:
        """The ensemble of the first trees only."""
        if self.leaf_values is not None:
            return BoostedTrees(self.features, self.model, self.leaf_values[:trees])
        if trees == self.model.getNumTrees:
            return self
        gateway = SparkContext.getOrCreate()._gateway  # trials run in threads, which have no active session
        regression = gateway.jvm.org.apache.spark.ml.regression
        kept, weights = gateway.new_array(regression.DecisionTreeRegressionModel, trees), gateway.new_array(gateway.jvm.double, trees)
        every = self.model._java_obj.trees()
        for i in range(trees):
            kept[i], weights[i] = every[i], float(self.model.treeWeights[i])
        cut = GBTRegressionModel(regression.GBTRegressionModel(self.model.uid, kept, weights))
        cut.setFeaturesCol("_features").setPredictionCol("prediction")._set(labelCol=self.model.getLabelCol())
        return BoostedTrees(self.features, cut.copy({}))  # a copy takes the columns along to Spark's own object

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/trees")
        facts = json.dumps({"features": self.features, "leaf_values": self.leaf_values})
        SparkSession.builder.getOrCreate().createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(path: str) -> BoostedTrees:
        facts = json.loads(SparkSession.builder.getOrCreate().read.parquet(f"{path}/facts").first()["facts"])
        return BoostedTrees(facts["features"], GBTRegressionModel.load(f"{path}/trees"), facts["leaf_values"])


def shrunken(total: float, rows: float, alpha: float, penalty: float) -> float:
    """Leaf value of a sum of residuals: the sum drawn towards zero by ``alpha``, over the rows plus ``penalty``."""
    return math.copysign(max(0.0, abs(total) - alpha), total) / (rows + penalty)


def penalised(fitted: BoostedTrees, df: DataFrame, alpha: float, penalty: float, target: str = "target") -> BoostedTrees:
    """The same trees with L1 and L2 penalties on their leaf values, set tree by tree.

    The residuals of ``df`` under the trees before are summed by leaf; a tree keeps its weight in the ensemble. Without
    penalties, and without row sampling, the values are the ones that the fit itself has given.
    """
    rows = fitted.leaves(df).select(F.col(target).cast("double").alias("_target"), "_leaves", F.lit(0.0).alias("_sum")).persist()
    values: list[list[float]] = []
    held = rows
    try:
        for tree, weight in enumerate(fitted.model.treeWeights):
            leaf = F.element_at("_leaves", tree + 1)
            sums = held.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("_target") - F.col("_sum")).alias("total"), F.count(F.lit(1)).alias("rows"))
            by_leaf = {row["leaf"]: (row["total"], row["rows"]) for row in sums.collect()}
            # trees after the first are fitted to the gradient, which is twice the residual
            scale = weight if tree == 0 else 2.0 * weight
            values.append([scale * shrunken(*by_leaf[i], alpha, penalty) if i in by_leaf else 0.0 for i in range(max(by_leaf) + 1)])
            held = held.withColumn("_sum", F.col("_sum") + F.get(F.array(*map(F.lit, values[-1])), leaf))
            if (tree + 1) % CHECKPOINT_TREES == 0:
                held = reliable_checkpoint(held)
    finally:
        rows.unpersist()
    return BoostedTrees(fitted.features, fitted.model, values)


def best_stage(errors: Sequence[float], patience: int) -> int:
    """0-based index of the least error before ``patience`` rounds in a row have brought none that is less."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def fit_gbt(
    df: DataFrame,
    features: Sequence[str],
    parameters: Mapping[str, float],
    seed: int,
    target: str = "target",
    validation: str | None = None,
    patience: int = PATIENCE,
) -> BoostedTrees:
    """Boosted regression trees. With a boolean validation column the trees are fitted on the other rows, and the ensemble
    ends at the tree with the least error on that part before ``patience`` trees in a row have not lowered it."""
    shared_folder(df.sparkSession)  # the residuals' lineage grows with every tree and is cut there
    trees = GBTRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol="prediction",
        seed=int(seed),
        checkpointInterval=CHECKPOINT_TREES,
        **gbt_parameters(parameters),
    )
    training = df.filter(~F.col(validation)) if validation else df
    alpha, penalty = (float(parameters.get(name, 0.0)) for name in LEAF_PENALTIES)
    if alpha < 0 or penalty < 0 or patience < 1:
        raise ContractViolation("leaf penalties must not be negative, and the patience is at least one tree")
    fitted = BoostedTrees(list(features), None)
    fitted.model = trees.fit(fitted.assembled(training))
    if alpha or penalty:
        fitted = penalised(fitted, training, alpha, penalty, target)
    if validation:
        fitted = fitted.first(best_stage(fitted.errors(df.filter(F.col(validation)), target), patience) + 1)
    return fitted


def best_iteration(model: BoostedTrees) -> int:
    """0-based index of the last tree kept."""
    return model.trees - 1


TRIAL_SCHEMA = "trial int, n bigint, sse double, rmse double, mae double, best_iteration int"


@dataclass
class SearchResult:
    records: DataFrame
    trial: int
    parameters: dict
    model: BoostedTrees


def search_trials(
    df: DataFrame,
    features: Sequence[str],
    candidates: Sequence[Mapping],
    seed_for_trial: Callable[[int], int],
    role: str = "role",
    target: str = "target",
    patience: int | None = None,
    parallelism: int = 4,
    tree_budget: int | None = None,
) -> SearchResult:
    """Fit every candidate on the ``fit`` rows, score it on the ``selection`` rows, keep the best.

    With ``patience`` an ensemble is cut where the selection rows ask for it; ``tree_budget`` is the number of trees of
    all candidates. The frame is persisted once; trials run as concurrent Spark jobs. The best trial has the lowest
    (rmse, trial).
    """
    if not candidates:
        raise ContractViolation("nothing to fit: no candidates given")
    trials = [int(c.get("trial", i)) for i, c in enumerate(candidates)]
    check_trials(trials)
    settings = [with_budget(trial, source, tree_budget) for trial, source in zip(trials, candidates)]
    rows = df.filter(F.col(role).isin("fit", "selection")).withColumn("_validation", F.col(role) == "selection").persist()

    def run(position: int):
        trial = trials[position]
        parameters, seed = settings[position], int(seed_for_trial(trial))
        if patience is None:
            model = fit_gbt(rows.filter("not _validation"), features, parameters, seed, target)
        else:
            model = fit_gbt(rows, features, parameters, seed, target, "_validation", patience)
        scored = model.transform(rows.filter("_validation"))
        m = regression_metrics(scored, target, ["prediction"]).first()
        stop = best_iteration(model) if patience is not None else None
        return (trial, m["n"], m["sse"], m["rmse"], m["mae"], stop), parameters, model

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            outcomes = list(pool.map(inheritable_thread_target(df.sparkSession)(run), range(len(candidates))))
    finally:
        rows.unpersist()
    best = min(outcomes, key=lambda o: (o[0][3], o[0][0]))
    records = df.sparkSession.createDataFrame([o[0] for o in outcomes], TRIAL_SCHEMA)
    return SearchResult(records, best[0][0], best[1], best[2])


NESTED_SCHEMA = "trial int, inner_validation_fold int, n bigint, sse double, rmse double, mae double, best_iteration int"


def search_nested(
    units: Mapping[int, tuple[DataFrame, Sequence[str]]],
    candidates: Sequence[Mapping],
    base_seed: int,
    tree_budget: int | None = None,
    target: str = "target",
    parallelism: int = 4,
    patience: int = PATIENCE,
) -> tuple[DataFrame, dict[int, dict]]:
    """Fit every candidate in every inner fold with early stopping: (trial records, parameters by trial).

    ``units`` is inner fold -> (rows with role fit / selection, its own retained features). A trial has
    the seed ``base_seed + trial`` in all inner folds. Choose with :func:`select_nested`.
    """
    if not candidates or not units:
        raise ContractViolation(f"nothing to search: {len(candidates)} candidates over {len(units)} inner folds")
    trials = [int(c.get("trial", i)) for i, c in enumerate(candidates)]
    check_trials(trials)
    parameters = {trial: with_budget(trial, source, tree_budget) for trial, source in zip(trials, candidates)}
    spark = next(iter(units.values()))[0].sparkSession

    def run(task):
        trial, inner = task
        rows, features = units[inner]
        marked = rows.filter(F.col("role").isin("fit", "selection")).withColumn("_validation", F.col("role") == "selection")
        model = fit_gbt(marked, features, parameters[trial], base_seed + trial, target, "_validation", patience)
        m = regression_metrics(model.transform(marked.filter("_validation")), target, ["prediction"]).first()
        return (trial, int(inner), m["n"], m["sse"], m["rmse"], m["mae"], best_iteration(model))

    tasks = [(trial, inner) for trial in trials for inner in sorted(units)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        records = list(pool.map(inheritable_thread_target(spark)(run), tasks))
    return spark.createDataFrame(records, NESTED_SCHEMA), parameters


def trial_problems(trials: DataFrame, nested: bool = False, by: Iterable[str] = ()) -> DataFrame:
    """Trial records that are not finite, negative, fractional, repeated, or cover other inner folds."""
    by = list(by)
    keys = [*by, "trial"] + (["inner_validation_fold"] if nested else [])
    columns = ["trial", "rmse"] + (["inner_validation_fold", "n", "sse", "mae", "best_iteration"] if nested else [])
    whole = ["trial"] + (["inner_validation_fold", "n", "best_iteration"] if nested else [])
    bad = finite_violations(trials, ["trial"], columns).select(F.col("trial").cast("string").alias("trial"), "problem")
    for c in whole:
        value = F.col(c).cast("double")
        rule = (value != F.floor(value)) | (value < (1 if c == "n" else 0))
        bad = bad.unionByName(trials.filter(rule).select(F.col("trial").cast("string").alias("trial"), F.lit(f"{c}:integer").alias("problem")))
    repeated = key_violations(trials, keys).select(F.col("trial").alias("trial"), F.lit("repeated").alias("problem"))
    bad = bad.unionByName(repeated)
    if nested:
        sets = trials.groupBy(*by, "trial").agg(F.array_sort(F.collect_set("inner_validation_fold")).alias("_folds"))
        spread = sets.groupBy(*by).agg(F.min("_folds").alias("_low"), F.max("_folds").alias("_high"))
        uneven = spread.filter(F.col("_low") != F.col("_high"))
        bad = bad.unionByName(uneven.select(F.lit("all").alias("trial"), F.lit("inner_folds_differ").alias("problem")))
    return bad


def select_trial(trials: DataFrame, by: Iterable[str] = (), rmse: str = "rmse") -> DataFrame:
    """Best record of each unit by (rmse, trial)."""
    by = list(by)
    rest = [c for c in trials.columns if c not in by and c not in (rmse, "trial")]
    best = trials.groupBy(*by).agg(F.min(F.struct(rmse, "trial", *rest)).alias("_b"))
    return best.select(*by, "_b.trial", F.col(f"_b.{rmse}").alias(rmse), *[f"_b.{c}" for c in rest])


def select_nested(trials: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Best nested trial by (pooled rmse, mean fold rmse, trial) and its final number of trees.

    The number of trees is the median of best_iteration + 1 over the inner folds, cut to an integer.
    """
    by = list(by)
    summary = nested_summary(trials, by)
    trees = trials.groupBy(*by, "trial").agg(
        F.percentile(F.col("best_iteration") + 1, 0.5).cast("int").alias("final_tree_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("inner_validation_fold", "best_iteration"))),
            lambda x: x["best_iteration"],
        ).alias("inner_best_iterations"),
    )
    joined = summary.join(trees, [*by, "trial"])
    order = ["pooled_inner_rmse", "mean_fold_rmse", "trial"]
    rest = [c for c in joined.columns if c not in order and c not in by]
    best = joined.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*by, *[f"_b.{c}" for c in [*order, *rest]])


def refit_ensemble(
    rows: DataFrame,
    scored: DataFrame,
    features: Sequence[str],
    parameters: Mapping[str, float],
    trees: int,
    seeds: Sequence[int],
    key: str = "record_id",
    target: str = "target",
) -> tuple[DataFrame, list[BoostedTrees]]:
    """Refit the chosen parameters with the chosen number of trees under each seed; mean prediction."""
    chosen = {**parameters, "n_estimators": int(trees)}
    models = [fit_gbt(rows, features, chosen, seed, target) for seed in seeds]
    current = scored
    for i, model in enumerate(models):
        current = model.transform(current).withColumnRenamed("prediction", f"_m{i}")
    return mean_members_wide(current, [f"_m{i}" for i in range(len(models))], key), models


def predict_batch(
    df: DataFrame,
    make_predict: Callable,
    vector: str = "embedding",
    dimension: int = 64,
    key: str = "record_id",
    batch_size: int = 4096,
    check: bool = True,
) -> DataFrame:
    """(key, prediction) from a user's batch function on a vector column; results must be finite.

    ``make_predict()`` is called once per Python worker and returns ``f(batch) -> vector of results``.
    """
    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[int(dimension)]])
    result = df.select(key, predict(vector).alias("prediction"))
    if check:
        guarded = F.when(is_finite("prediction"), F.col("prediction"))
        error = F.raise_error(F.concat(F.lit("prediction is not finite for "), F.col(key).cast("string")))
        result = result.select(key, F.coalesce(guarded, error.cast("double")).alias("prediction"))
    return result


SUMMARY_KEYS = ("design", "branch", "fold")


def save_run(path: str, model: BoostedTrees, fitted: FeatureFilter, summary: Mapping[str, str]) -> None:
    """Write model, feature filter and run summary under one path."""
    spark = SparkSession.builder.getOrCreate()
    model.save(f"{path}/model")
    fitted.report(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/filter")
    spark.createDataFrame([(k, str(v)) for k, v in summary.items()], "name string, value string").coalesce(1).write.mode(
        "errorifexists"
    ).parquet(f"{path}/summary")


def reuse_model(
    path: str, df: DataFrame, expect: Mapping[str, str], key: str = "record_id", check: bool = True
) -> DataFrame:
    """Predict with the model of another run, refusing a run whose design, branch or fold differs."""
    spark = df.sparkSession
    summary = {r["name"]: r["value"] for r in collect_small(spark.read.parquet(f"{path}/summary"))}
    wrong = {k: (summary.get(k), str(v)) for k, v in expect.items() if summary.get(k) != str(v)}
    if wrong:
        raise ContractViolation(f"the companion run does not match: {wrong}")
    if summary.get("scored_labels_accessed") != "False":
        raise ContractViolation("the companion run has read scored labels")
    rows = sorted(collect_small(spark.read.parquet(f"{path}/filter"), 1_000_000))
    fitted = FeatureFilter(tuple((r["column"], r["status"]) for r in rows), FilterConfig())
    model = BoostedTrees.load(f"{path}/model")
    return model.transform(apply_feature_filter(df, fitted, [key], check)).select(key, "prediction")

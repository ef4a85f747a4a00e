"""Aggregation of predictions and vectors over folds, members, records and groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import is_finite
from ..functions.vectors import as_vector, vector_is_finite
from .checks import ensure_label_free, require_empty

SCORED_MODES = ("one_held_out", "full_refit", "mean_over_splits")


def fold_coverage(df: DataFrame, folds: Iterable[int], key: str = "record_id", fold: str = "fold_index") -> DataFrame:
    """Keys whose set of folds differs from the declared one: key, folds."""
    declared = F.array_sort(F.array(*[F.lit(int(f)) for f in folds]))
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(F.col(fold).cast("int"))).alias("folds"))
    return sets.filter(F.col("folds") != declared)


def scored_problems(
    df: DataFrame,
    mode: str,
    folds: Iterable[int],
    columns: Iterable[str],
    key: str = "record_id",
    fold: str = "fold_index",
) -> DataFrame:
    """Records whose scored rows break a rule: key, n, problem; all rules in one aggregation by record.

    Values must be finite, folds declared, record-fold pairs unique; split models must cover every
    fold, the other modes have one row per record.
    """
    folds = [int(f) for f in folds]
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~is_finite(c)
    declared = F.coalesce(F.col(fold).isin(folds), F.lit(False))
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.size(F.collect_set(F.when(declared, F.col(fold)))).alias("_folds"),
        F.count_if(~declared).alias("_undeclared"),
        F.count_if(bad).alias("_bad"),
    )
    required = len(set(folds)) if mode == "mean_over_splits" else 1
    problem = (
        F.when(F.col(key).isNull(), F.lit("missing_key"))
        .when(F.col("_bad") > 0, F.lit("not_finite"))
        .when(F.col("_undeclared") > 0, F.lit("undeclared_fold"))
        .when(F.col("n") != F.col("_folds"), F.lit("repeated_fold"))
        .when(F.col("n") != required, F.lit("row_count"))
    )
    return per_key.select(key, "n", problem.alias("problem")).filter(F.col("problem").isNotNull())


def aggregate_scored(
    df: DataFrame,
    mode: str,
    folds: Iterable[int],
    columns: Iterable[str],
    expected_rows: int | None = None,
    key: str = "record_id",
    fold: str = "fold_index",
    check: bool = True,
) -> DataFrame:
    """One row per scored record: its single held-out or refit row, or the mean over split models."""
    folds, columns = list(folds), list(columns)
    if mode not in SCORED_MODES:
        raise ContractViolation(f"unknown aggregation mode: {mode}")
    if check:
        ensure_label_free(df)
        require_empty(scored_problems(df, mode, folds, columns, key, fold), "scored rows break their contract")
    if mode == "mean_over_splits":
        result = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    else:
        result = df.select(key, *columns)
    if expected_rows is not None and result.count() != expected_rows:
        raise ContractViolation(f"expected {expected_rows} scored records")
    return result


def member_problems(
    df: DataFrame, n_members: int, key: str = "record_id", member: str = "member", prediction: str = "prediction"
) -> DataFrame:
    """Records whose members are not exactly the common set, once each and finite."""
    per_key = df.groupBy(key).agg(
        F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("members"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~is_finite(prediction)).alias("not_finite"),
    )
    sets = per_key.groupBy("members").agg(F.count(F.lit(1)).alias("records"))
    # Records with the most common member set follow the rule; ties go to the least set.
    common = sets.agg(F.max(F.struct("records", "members")).alias("c")).select(F.col("c.members").alias("common"))
    joined = per_key.join(F.broadcast(common), F.lit(True))
    bad = (
        (F.col("members") != F.col("common"))
        | (F.size("members") != n_members)
        | (F.col("n") != n_members)
        | (F.col("not_finite") > 0)
        | F.col(key).isNull()
    )
    return joined.filter(bad).select(key, "members", "n", "not_finite")


def mean_members(
    df: DataFrame,
    n_members: int,
    n_rows: int | None = None,
    key: str = "record_id",
    member: str = "member",
    prediction: str = "prediction",
    order: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Mean over ensemble members, long form; ``order`` keeps the first-seen position of each record."""
    if check:
        ensure_label_free(df)
        require_empty(member_problems(df, n_members, key, member, prediction), "member predictions are incomplete")
    extra = [F.min(order).alias(order)] if order else []
    result = df.groupBy(key).agg(*extra, F.avg(prediction).alias(prediction))
    if check and n_rows is not None and result.count() != n_rows:
        raise ContractViolation(f"expected {n_rows} records")
    return result


def mean_members_wide(df: DataFrame, columns: Iterable[str], key: str = "record_id", name: str = "prediction") -> DataFrame:
    """Mean over ensemble members held side by side."""
    columns = list(columns)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.select(key, (total / F.lit(float(len(columns)))).alias(name))


def pivot_members(df: DataFrame, members: Iterable[int], key: str = "record_id") -> DataFrame:
    """Long member predictions to one column per member, with a fixed list of members."""
    members = list(members)
    picked = [F.max(F.when(F.col("member") == m, F.col("prediction"))).alias(f"member_{m}") for m in members]
    return df.groupBy(key).agg(*picked)


def nested_summary(trials: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Per trial over its inner folds: n, sse, pooled rmse, mean fold rmse, mean fold mae."""
    by = list(by)
    return trials.groupBy(*by, "trial").agg(
        F.sum("n").alias("inner_n"),
        F.sum("sse").alias("inner_sse"),
        F.sqrt(F.sum("sse") / F.sum("n")).alias("pooled_inner_rmse"),
        F.avg("rmse").alias("mean_fold_rmse"),
        F.avg("mae").alias("mean_fold_mae"),
    )


def _positions(df: DataFrame, keys: list[str], vector: Column, extra: list[Column]) -> DataFrame:
    return df.select(*keys, *extra, F.posexplode(vector).alias("position", "value"))


def mean_vector(df: DataFrame, vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Mean of each vector position over the usable rows: position, value.

    Positions are reduced in the map tasks, so the shuffle holds one row per position and task.
    """
    usable = vector_is_finite(vector) if where is None else where & vector_is_finite(vector)
    rows = _positions(df.filter(usable), [], as_vector(vector), [])
    return rows.groupBy("position").agg(F.avg("value").alias("value"))


def masked_mean(
    df: DataFrame, key: str = "label", mask: str = "mask", vector: str = "embedding", check: bool = True
) -> DataFrame:
    """Mask-weighted mean vector per key in long form: key, position, value."""
    if check:
        empty = df.groupBy(key).agg(F.sum(F.col(mask).cast("double")).alias("weight")).filter("weight is null or weight <= 0")
        require_empty(empty, "a key has no unmasked row")
    weight = F.col(mask).cast("double").alias("_weight")
    rows = _positions(df, [key], as_vector(vector), [weight])
    total = F.sum(F.col("value") * F.col("_weight"))
    return rows.groupBy(key, "position").agg((total / F.sum("_weight")).alias("value"))


def collect_positions(long: DataFrame, keys: Iterable[str], name: str = "vector") -> DataFrame:
    """Long vector rows (one per position) back to one array per key."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "value")))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias(name))


def mean_by_record(
    df: DataFrame, key: str = "record_id", prediction: str | None = None, vector: str = "embedding"
) -> DataFrame:
    """Mean prediction and mean vector over the repeated rows of a record, in long form.

    Columns: key, position, value, n and, if asked, the mean prediction.
    """
    extra = [F.col(prediction).alias("_p")] if prediction else []
    rows = _positions(df, [key], as_vector(vector), extra)
    means = [F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")]
    if prediction:
        means.append(F.avg("_p").alias(prediction))
    return rows.groupBy(key, "position").agg(*means)


def group_target(df: DataFrame, group: Iterable[str], target: str, name: str = "group_target") -> DataFrame:
    """One label per content group: the mean of its members."""
    return df.groupBy(*group).agg(F.avg(target).alias(name), F.count(F.lit(1)).alias("n"))

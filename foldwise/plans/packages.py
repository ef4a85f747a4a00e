"""Validate an input package (records, labels, partitions) and prepare the four split designs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import is_finite
from ..operators.checks import ROLES, domain_violations, finite_violations, require_empty, trimmed
from ..operators.keys import override_labels
from ..operators.splits import (
    bin_round_robin,
    expand_folds,
    held_out_role,
    kfold,
    map_roles,
    melt_splits,
    quantile_bins,
    reserve,
    same_membership,
    stratified_holdout,
    stratified_kfold,
)
from ..session import collect_small

# Scored rows per record of each assignment pattern ("folds" means once per fold).
ASSIGNMENTS = {"one_held_out": 1, "full_refit": 1, "same_rows_in_every_fold": "folds"}


def package_violations(
    records: DataFrame,
    labels: DataFrame,
    partitions: DataFrame,
    folds: Iterable[int],
    required_roles: Iterable[str],
    expected_scored: int | None,
    assignment: str,
    structure: str = "structure",
    target: str = "target",
) -> DataFrame:
    """Broken rules of a package with their row counts: rule, n. Empty means valid.

    All key rules (uniqueness, equal key sets, coverage, scored pattern) come from one aggregation by
    record over the union of the three tables; the fold and role rules from one small aggregate.
    """
    folds, required = [int(f) for f in folds], sorted(set(required_roles))
    repetitions = ASSIGNMENTS[assignment]
    repetitions = len(folds) if repetitions == "folds" else repetitions

    def side(df, name, **flags):
        columns = {c: F.lit(0).cast("bigint") for c in ("rec", "lab", "par", "sco", "bad_text", "bad_value", "bad_domain")}
        columns[name] = F.lit(1).cast("bigint")
        columns.update({k: v.cast("bigint") for k, v in flags.items()})
        return df.select(trimmed(F.col("record_id").cast("string")).alias("record_id"), *[c.alias(k) for k, c in columns.items()])

    def empty(column):
        return F.coalesce(F.length(trimmed(F.col(column).cast("string"))), F.lit(0)) == 0

    role = trimmed("role")
    known = F.coalesce(F.col("fold_index").isin(folds) & role.isin(list(ROLES)), F.lit(False))
    a = side(records, "rec", bad_text=empty("record_id") | empty(structure))
    b = side(labels, "lab", bad_text=empty("record_id"), bad_value=~is_finite(target))
    c = side(partitions, "par", sco=F.coalesce(role == "scored", F.lit(False)), bad_domain=~known)
    per_key = a.unionByName(b).unionByName(c).groupBy("record_id").agg(
        *[F.sum(x).alias(x) for x in ("rec", "lab", "par", "sco", "bad_text", "bad_value", "bad_domain")]
    )
    rules = {
        "text:empty": F.sum("bad_text"),
        "label:not_finite": F.sum("bad_value"),
        "partition:unknown_fold_or_role": F.sum("bad_domain"),
        "record:duplicate": F.count_if(F.col("rec") > 1),
        "label:duplicate": F.count_if(F.col("lab") > 1),
        "label:without_record": F.count_if((F.col("lab") > 0) & (F.col("rec") == 0)),
        "record:without_label": F.count_if((F.col("rec") > 0) & (F.col("lab") == 0)),
        "partition:unknown_record": F.count_if((F.col("par") > 0) & (F.col("rec") == 0)),
        "record:without_partition": F.count_if((F.col("rec") > 0) & (F.col("par") == 0)),
        "scored:pattern": F.count_if((F.col("sco") > 0) & (F.col("sco") != repetitions)),
    }
    if expected_scored is not None:
        rules["scored:count"] = F.abs(F.count_if(F.col("sco") > 0) - F.lit(int(expected_scored)))
    totals = per_key.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in rules.items()])
    found = totals.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in rules]))
    ).filter("n > 0")
    repeated = (
        partitions.groupBy(trimmed(F.col("record_id").cast("string")).alias("record_id"), "fold_index")
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.count_if(F.col("_n") > 1).alias("n"))
        .select(F.lit("partition:duplicate").alias("rule"), "n")
        .filter("n > 0")
    )
    present = partitions.select("fold_index", role.alias("role")).groupBy("fold_index").agg(
        F.array_sort(F.collect_set(F.when(F.col("role").isin(list(ROLES)), F.col("role")))).alias("_roles")
    )
    wrong = present.filter(F.col("_roles") != F.array(*[F.lit(r) for r in required]))
    roles = wrong.select(
        F.concat(F.lit("fold:roles:"), F.coalesce(F.col("fold_index").cast("string"), F.lit("null"))).alias("rule"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return found.unionByName(repeated).unionByName(roles)


def prepare_shuffled(records: DataFrame, folds: int, seed: int, reserved_fraction: float) -> DataFrame:
    """Shuffled folds; in each fold a share of the development rows is reserved."""
    assigned = kfold(records.select("record_id"), folds, seed)
    expanded = expand_folds(assigned, range(folds), held_out_role()).drop("assigned_fold")
    return reserve(expanded, reserved_fraction, seed).select("record_id", "fold_index", "role")


def prepare_stratified(labels: DataFrame, folds: int, bins: int, seed: int, target: str = "target") -> DataFrame:
    """Folds that are stratified by target quantiles; rows are scored once and fit otherwise."""
    require_empty(finite_violations(labels, ["record_id"], [target]), "records without a finite target cannot be stratified")
    binned = quantile_bins(labels.select("record_id", target), target, bins)
    assigned = stratified_kfold(binned, "bin", folds, seed)
    return expand_folds(assigned, range(folds), held_out_role()).select("record_id", "fold_index", "role")


def prepare_round_robin(
    labels: DataFrame,
    test: DataFrame,
    folds: int,
    bins: int,
    seed: int,
    selection_fraction: float,
    role_map: Mapping[str, str] | None = None,
    target: str = "target",
) -> DataFrame:
    """Native roles per fold: oof_holdout, selection (stratified holdout of the rest), fit, official_test.

    ``role_map`` turns them into contract roles.
    """
    require_empty(finite_violations(labels, ["record_id"], [target]), "records without a finite target cannot be stratified")
    binned = quantile_bins(labels.select("record_id", target), target, bins).drop(target)
    assigned = bin_round_robin(binned, "bin", folds, seed)
    expanded = expand_folds(assigned, range(folds), held_out_role()).drop("assigned_fold")
    # Scored rows take part as a group of their own, so that the folds are expanded and read once.
    seeds = F.col("fold_index") + F.lit(int(seed))
    chosen = stratified_holdout(expanded, "bin", selection_fraction, seeds, by=("fold_index", "role"))
    role = (
        F.when(F.col("role") == "scored", F.lit("oof_holdout"))
        .when(F.col("held_out"), F.lit("selection"))
        .otherwise(F.lit("fit"))
    )
    development = chosen.select("record_id", "fold_index", role.alias("role"))
    official = expand_folds(test.select("record_id"), range(folds), F.lit("official_test"))
    native = development.unionByName(official)
    return map_roles(native, role_map) if role_map else native


def prepare_supplied(
    rows: DataFrame,
    split_columns: Mapping[str, int],
    role_map: Mapping[str, str],
    author_labels: DataFrame,
    tolerance: float,
    test_value: str = "Test",
    target: str = "target",
) -> tuple[DataFrame, DataFrame]:
    """Supplied splits: (labels, partitions). The test rows are the same in every split and take the
    authors' labels, which may differ from ours by the rounding tolerance only."""
    for column in split_columns:
        require_empty(domain_violations(rows, column, role_map), f"undeclared split value in {column}")
    partitions = melt_splits(rows, split_columns, role_map)
    require_empty(same_membership(partitions, role_map[test_value], len(split_columns)), "test membership differs between splits")
    first = next(iter(split_columns))
    base = rows.select("record_id", target, F.col(first).alias("_split"))
    tests = base.filter(F.col("_split") == test_value).select("record_id")
    authors = author_labels.join(tests, "record_id", "left_semi")
    changed = override_labels(base, authors, tolerance, target=target)
    require_empty(changed.filter("rejected").select("record_id"), "test labels differ by more than rounding")
    return changed.select("record_id", target), partitions


def package_counts(partitions: DataFrame) -> list:
    """(fold, role, n) rows of a prepared design; as few as there are folds and roles."""
    rows = partitions.groupBy("fold_index", "role").agg(F.count(F.lit(1)).alias("n"))
    return sorted(tuple(r) for r in collect_small(rows))


def require_valid_package(*args, **kwargs) -> None:
    found = package_violations(*args, **kwargs).limit(20).collect()
    if found:
        raise ContractViolation(f"the package is not valid: {[r.asDict() for r in found]}")

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation
from foldwise.functions.hashing import hash32, order_hash
from foldwise.functions.numbers import bin_index
from foldwise.operators import quantiles, splits
from foldwise.operators.ranking import hashed_rank, ordinal, source_row_number
from foldwise.operators.stages import STAGE_RULES, STAGES, resolve_stages


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """300 records; bin 0 holds two thirds of them."""
    rows = [(f"r{i}", 0 if i % 3 else i % 5 + 1, i / 7.0) for i in range(300)]
    return spark.createDataFrame(rows, "record_id string, bin int, x double")


def expected_rank(rows, seed, by):
    ranks = {}
    for group in {by(r) for r in rows}:
        members = sorted((r for r in rows if by(r) == group), key=lambda r: (md5(f"{seed}:{r[0]}"), r[0]))
        ranks.update({r[0]: i + 1 for i, r in enumerate(members)})
    return ranks


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rank_equals_a_sort_on_one_machine(skewed, digits):
    rows = [tuple(r) for r in skewed.collect()]
    whole = hashed_rank(skewed, order_hash(3, "record_id"), "record_id", digits=digits, total="n")
    assert {r["record_id"]: r["rank"] for r in whole.collect()} == expected_rank(rows, 3, lambda r: 0)
    assert {r["n"] for r in whole.collect()} == {300}
    grouped = hashed_rank(skewed, order_hash(3, "record_id"), "record_id", by=("bin",), digits=digits)
    assert {r["record_id"]: r["rank"] for r in grouped.collect()} == expected_rank(rows, 3, lambda r: r[1])


def test_splits_do_not_depend_on_partitions(spark, skewed):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = skewed.repartition(n)
            seen.append(
                (
                    sorted(map(tuple, splits.kfold(df, 7, 1).select("record_id", "assigned_fold").collect())),
                    sorted(map(tuple, splits.stratified_holdout(df, "bin", 0.15, 2).select("record_id", "held_out").collect())),
                )
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_ordinal_over_any_columns(spark, skewed):
    found = ordinal(skewed, ["bin", "record_id"], "ord").select("bin", "record_id", "ord").collect()
    order = sorted((r["bin"], r["record_id"]) for r in found)
    assert {(r["bin"], r["record_id"]): r["ord"] for r in found} == {k: i for i, k in enumerate(order)}


def test_source_rows_are_numbered_over_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(4).write.parquet(path)
    numbers = sorted(r["row_number"] for r in source_row_number(spark.read.parquet(path)).collect())
    assert numbers == list(range(100))


def test_hash_numbers_are_plain_md5(spark):
    row = spark.createDataFrame([("f:12",)], "t string").select(hash32(F.col("t")).alias("h")).first()
    assert row["h"] == int(md5("f:12")[:8], 16)


@pytest.mark.parametrize("accuracy,read", [(10_000, 2_000), (20, 90)])
@pytest.mark.parametrize("shape", ["normal", "heavy", "two_values", "constant", "infinite"])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, read, shape):
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=5000),
        "heavy": np.where(rng.random(5000) < 0.4, 1.0, rng.lognormal(sigma=4, size=5000)),
        "two_values": (rng.random(5000) < 0.5).astype(float),
        "constant": np.full(5000, 3.0),
        "infinite": np.where(np.arange(5000) % 3 == 0, np.inf, np.where(np.arange(5000) % 7 == 0, -np.inf, rng.normal(size=5000))),
    }[shape]
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "READ_VALUES", read)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    probabilities = [0.5, 0.0, 0.001, 0.25, 1 / 3, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, ["x"], probabilities)["x"]
    assert found == pytest.approx([plain_quantile(values, p) for p in probabilities], rel=1e-12, abs=1e-12)


def plain_quantile(values, p):
    """Linear interpolation; two equal neighbours give their value, also when it is infinite."""
    ordered, position = np.sort(values), (len(values) - 1) * p
    low, high = ordered[int(np.floor(position))], ordered[int(np.ceil(position))]
    return low if low == high else low + (high - low) * (position - np.floor(position))


def test_quantiles_of_many_columns_take_three_passes(spark, tmp_path):
    rng = np.random.default_rng(6)
    table = rng.lognormal(size=(4000, 5))
    path = str(tmp_path / "wide")
    spark.createDataFrame(table.tolist(), [f"c{i}" for i in range(5)]).write.parquet(path)
    reads = []

    class Counted:
        """A table that counts the aggregations and selections asked of it."""

        def __init__(self, df):
            self.df = df

        def agg(self, *columns):
            reads.append("agg")
            return self.df.agg(*columns)

        def select(self, *columns):
            reads.append("select")
            return self.df.select(*columns)

    found = quantiles.exact_quantiles(Counted(spark.read.parquet(path)), [f"c{i}" for i in range(5)], [0.01, 0.99])
    assert reads == ["agg", "agg", "select"]
    for i in range(5):
        assert found[f"c{i}"] == pytest.approx(list(np.quantile(table[:, i], [0.01, 0.99])), rel=1e-12)


def test_quantiles_refuse_an_empty_column(spark):
    with pytest.raises(ContractViolation):
        quantiles.exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5])


def test_bins_are_right_closed_and_cover_the_ends(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 5)], "x double")
    found = [r["b"] for r in df.select("x", bin_index("x", [0.0, 2.0, 4.0]).alias("b")).orderBy("x").collect()]
    assert found == [0, 0, 0, 1, 1, 1]
    ties = spark.createDataFrame([(1.0,)] * 51 + [(2.0,)] * 50, "x double")
    assert splits.quantile_edges(ties, "x", 10) == [1.0, 2.0]
    assert {r["bin"] for r in splits.quantile_bins(ties, "x", 10).collect()} == {0}


def test_fold_sizes(skewed):
    sizes = sorted((r["assigned_fold"], r["count"]) for r in splits.kfold(skewed, 7, 1).groupBy("assigned_fold").count().collect())
    assert [n for _, n in sizes] == [43] * 6 + [42]
    strat = splits.stratified_kfold(skewed, "bin", 7, 1)
    per_fold = [r["count"] for r in strat.groupBy("assigned_fold").count().collect()]
    assert max(per_fold) - min(per_fold) <= 1
    cells = {(r["bin"], r["assigned_fold"]): r["count"] for r in strat.groupBy("bin", "assigned_fold").count().collect()}
    for b in {k[0] for k in cells}:
        counts = [cells.get((b, f), 0) for f in range(7)]
        assert max(counts) - min(counts) <= 1
    robin = splits.bin_round_robin(skewed, "bin", 7, 1).groupBy("bin", "assigned_fold").count().collect()
    first = {r["bin"]: r["count"] for r in robin if r["assigned_fold"] == 0}
    assert all(r["count"] <= first[r["bin"]] for r in robin)


def test_reserved_rows_are_the_ceiling_of_the_fraction(skewed):
    folds = splits.expand_folds(splits.kfold(skewed, 4, 1), range(4), splits.held_out_role())
    counts = splits.reserve(folds, 0.1, 9).groupBy("fold_index", "role").count().collect()
    found = {(r["fold_index"], r["role"]): r["count"] for r in counts}
    for fold in range(4):
        assert found[fold, "scored"] == 75
        assert found[fold, "reserved"] == math.ceil(0.1 * 225) == 23


def test_holdout_is_proportional_by_largest_remainder(spark, skewed):
    held = splits.stratified_holdout(skewed, "bin", 0.15, 3)
    assert held.filter("held_out").count() == 45
    for r in held.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("held_out").alias("k")).collect():
        assert abs(r["k"] - 0.15 * r["n"]) < 1
    counts = spark.createDataFrame([(0, 3), (1, 3), (2, 4)], "bin int, n bigint")
    quotas = {r["bin"]: r["quota"] for r in splits.holdout_quotas(counts, "bin", 0.35).collect()}
    # wanted: 4 of 10; shares 1.2, 1.2, 1.6
    assert quotas == {0: 1, 1: 1, 2: 2}


def adaptive_by_hand(values):
    for q in range(20, 3, -1):
        edges = sorted({round(float(e), 9) for e in np.quantile(values, [i / q for i in range(q + 1)])})
        bins = [max(0, min(len(edges) - 2, sum(e < v for e in edges) - 1)) for v in values]
        counts = np.bincount(bins)
        counts = counts[counts > 0]
        if counts.min() >= 5 and len(counts) >= 4:
            return bins
    return None


def test_adaptive_bins(spark):
    rng = np.random.default_rng(2)
    values = [round(float(v), 6) for v in np.concatenate([rng.normal(size=60), np.full(20, 0.5)])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["bin"] for r in splits.adaptive_bins(df, "v").orderBy("i").collect()]
    assert found == adaptive_by_hand(values)
    with pytest.raises(ContractViolation):
        splits.adaptive_bins(df.limit(6), "v")


def test_groups_stay_whole(spark):
    rows = [(i, f"g{i % 40 if i % 3 else 0}", float(i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    sides = splits.group_split(df, "g", "v", 0.2, 5)
    assert sides.count() == 900
    assert sides.groupBy("g").agg(F.countDistinct("side").alias("n")).filter("n <> 1").count() == 0
    assert sides.filter("side = 'score'").select("g").distinct().count() == 8


def test_nested_folds(spark):
    parts = spark.createDataFrame(
        [(f"r{i}", f, "scored" if i % 3 == f else "fit") for i in range(9) for f in range(3)], "record_id string, fold_index int, role string"
    )
    nested = splits.nested_folds(parts).filter("outer_fold = 0 and inner_fold = 1").collect()
    assert {r["record_id"] for r in nested if r["stage"] == "selection_score"} == {"r1", "r4", "r7"}
    assert {r["record_id"] for r in nested if r["stage"] == "selection_fit"} == {"r2", "r5", "r8"}


def test_stage_rules(spark):
    assert {s for *_, stages in STAGE_RULES for s in stages} == set(STAGES)
    parts = spark.createDataFrame([("a", 0, "fit"), ("b", 0, "reserved"), ("c", 0, "scored")], "record_id string, fold_index int, role string")
    found = sorted((r["record_id"], r["stage"]) for r in resolve_stages(parts, "nested_holdout", "tabular").collect())
    training = ["final_refit", "selection_fit", "selection_score"]
    assert found == [(k, s) for k in "ab" for s in training] + [("c", "scored_prediction")]
    with pytest.raises(ContractViolation):
        resolve_stages(parts, "nested_holdout", "unknown")


def test_supplied_splits(spark):
    wide = spark.createDataFrame([("a", "Train", "Val"), ("b", "Test", "Test"), ("c", "Test", "Train")], "record_id string, s1 string, s2 string")
    roles = {"Train": "fit", "Val": "coefficient", "Test": "scored"}
    long = splits.melt_splits(wide, {"s1": 1, "s2": 2}, roles)
    assert long.count() == 6
    assert [r["record_id"] for r in splits.same_membership(long, "scored", 2).collect()] == ["c"]
    assert splits.expand_variants(wide, 2).count() == 9

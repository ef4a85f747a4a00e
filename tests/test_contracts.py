"""Contracts that hold for every file, every column and every row."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise import ContractViolation
from foldwise.functions.numbers import bin_index
from foldwise.operators.bootstrap import paired_bootstrap
from foldwise.operators.splits import group_split, holdout_quotas
from foldwise.plans.packages import prepare_round_robin, prepare_stratified
from foldwise.sources.contracts import read_contract, shape_violations
from foldwise.sources.integrity import file_digests, file_integrity

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.IntegerType())])


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_all_files_of_a_folder_are_read_under_the_contract(spark, tmp_path):
    path = folder(tmp_path, a="\ufeffid,x,y\nr1,1.5,2\n", b='"id","x","y"\r\nr2,-1,3\r\n', c="id,x,y\n")
    assert sorted(map(tuple, read_contract(spark, path, SCHEMA, rows=2).collect())) == [("r1", 1.5, 2), ("r2", -1.0, 3)]
    with pytest.raises(ContractViolation, match="2 rows instead of 3"):
        read_contract(spark, path, SCHEMA, rows=3)


@pytest.mark.parametrize("head", ["id,y,x", "id,x", "id,x,y,z", "r9,1,2"])
def test_another_header_in_any_file_is_refused(spark, tmp_path, head):
    with pytest.raises(ContractViolation, match="header"):
        read_contract(spark, folder(tmp_path, a="id,x,y\nr1,1,2\n", b=f"{head}\nr2,1,2\n"), SCHEMA)


def test_a_bad_field_is_refused_although_nobody_reads_it(spark, tmp_path):
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_contract(spark, folder(tmp_path, a="id,x,y\nr1,1,2\nr2,1,two\n"), SCHEMA)


def test_files_of_one_name_in_two_folders_are_told_apart(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.bin").write_bytes(name.encode())
    manifest = file_digests(spark, str(tmp_path))
    assert sorted(r["name"] for r in manifest.collect()) == ["one/data.bin", "two/data.bin"]
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert file_integrity(spark, str(tmp_path), manifest).count() == 0
    (tmp_path / "two" / "data.bin").write_bytes(b"six")
    assert [tuple(r) for r in file_integrity(spark, str(tmp_path), manifest).collect()] == [("two/data.bin", "digest")]


def test_missing_numbers_have_no_bin_and_stop_a_design(spark):
    rows = [("a", None), ("b", float("nan")), ("c", 0.5), ("d", 2.0)]
    df = spark.createDataFrame(rows, "record_id string, target double")
    assert [r["bin"] for r in df.select(bin_index("target", [0, 1, 2]).alias("bin")).collect()] == [None, None, 0, 1]
    assert [r["bin"] for r in df.select(bin_index("target", [1]).alias("bin")).collect()] == [None, None, 0, 0]
    with pytest.raises(ContractViolation, match="finite target"):
        prepare_stratified(df, 2, 2, 1)
    with pytest.raises(ContractViolation, match="finite target"):
        prepare_round_robin(df, df, 2, 2, 1, 0.5)


@pytest.mark.parametrize("counts", [[5 * 10**9, 5 * 10**9], [7 * 10**9 + 1, 2, 10**10 + 3]])
def test_quotas_of_very_large_bins_are_exact(spark, counts):
    df = spark.createDataFrame(list(enumerate(counts)), "bin int, n long")
    found = {r["bin"]: r["quota"] for r in holdout_quotas(df, "bin", 0.15).collect()}
    total = sum(counts)
    want = -(-total * 15 // 100)
    floors = [want * n // total for n in counts]
    order = sorted(range(len(counts)), key=lambda k: (-(want * counts[k] % total), k))
    for k in order[: want - sum(floors)]:
        floors[k] += 1
    assert found == dict(enumerate(floors))


@pytest.mark.parametrize("method", ["multinomial", "poisson", "hash"])
def test_groups_that_look_alike_are_all_bootstrapped(spark, method):
    groups = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), (None, None)]
    rows = [(f"r{i}", *group, float(i), float(i % 3), 0.5 * k) for k, group in enumerate(groups) for i in range(8)]
    df = spark.createDataFrame(rows, "record_id string, g string, h string, p double, q double, target double")
    found = paired_bootstrap(df, "p", "q", seed=3, replicates=20, by=["g", "h"], method=method).collect()
    assert sorted(map(str, ((r["g"], r["h"]) for r in found))) == sorted(map(str, groups))
    assert all(r["n"] == 8 and r["ci95_low"] <= r["delta"] + 9 for r in found)


def test_group_split_keeps_groups_whole_without_held_tables(spark):
    rows = [(f"r{i}", f"g{i % 40}", float(i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id string, g string, target double")
    sides = group_split(df, "g", "target", 0.25, 5)
    assert sides.count() == 400 and sides.filter(F.col("side").isNull()).count() == 0
    assert sides.groupBy("g").agg(F.countDistinct("side").alias("n")).filter("n > 1").count() == 0


def test_shapes_are_compared_with_their_declaration(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    declared = {"good": (2, ["k", "n"]), "short": (3, ["k", "n"]), "turned": (1, ["n", "k"]), "gone": (0, [])}
    found = shape_violations({"good": df, "short": df, "turned": df, "extra": df}, declared).collect()
    expected = [("extra", "undeclared"), ("gone", "missing"), ("short", "rows"), ("turned", "columns"), ("turned", "rows")]
    assert sorted(map(tuple, found)) == expected
    assert shape_violations({"extra": df}, {}).count() == 1

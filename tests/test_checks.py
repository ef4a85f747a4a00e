import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation, LabelAccessError
from foldwise.operators import checks
from foldwise.plans.packages import package_violations


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_is_trimmed_and_bad_text_found(spark):
    df = spark.createDataFrame([(1, "  a\t"), (2, "   "), (3, None), (4, "a\x00b"), (5, " x ")], "k int, t string")
    assert [r["t"] for r in checks.clean_text(df, ["t"]).orderBy("k").collect()][::4] == ["a", "x"]
    assert rows(checks.text_violations(df, ["k"], ["t"])) == [(2, "t:empty"), (3, "t:empty"), (4, "t:nul")]


def test_numbers_are_coerced_then_checked(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, "x"), (3, "NaN"), (4, None), (5, "Infinity")], "k int, v string")
    assert rows(checks.finite_violations(df, ["k"], ["v"])) == [
        (2, "v:missing"), (3, "v:missing"), (4, "v:missing"), (5, "v:infinite"),
    ]
    with pytest.raises(ContractViolation):
        checks.require_finite(df, ["v"])
    assert checks.require_finite(df.filter("k = 1"), ["v"]).first()["v"] == 1.5


def test_usable_and_rejected_rows_cover_the_table(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "k int, v double")
    usable, rejected = checks.split_usable(df, F.col("v") > 0)
    assert [r["k"] for r in usable.collect()] == [1]
    assert sorted(r["k"] for r in rejected.collect()) == [2, 3]


def test_label_guard_and_policy(spark):
    checks.ensure_label_free(["record_id", "prediction"])
    with pytest.raises(ContractViolation):
        checks.ensure_label_free(["record_id", "target"])
    checks.ensure_label_free(["TARGET"])
    with pytest.raises(ContractViolation):
        checks.ensure_label_free(["TARGET"], fold_case=True)
    with pytest.raises(LabelAccessError):
        checks.enforce_label_access("scored", "model_fitting")
    checks.enforce_label_access("scored", "scoring")
    usage = spark.createDataFrame(
        [(1, "scored", "scoring"), (2, "scored", "model_fitting"), (3, None, "scoring"), (4, "coefficient_development", "scoring")],
        "k int, role string, operation string",
    )
    assert sorted(r["k"] for r in checks.audit_label_use(usage).collect()) == [2, 3]


def test_column_sets(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert checks.require_columns(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ContractViolation):
        checks.require_columns(df, ["a"])
    assert checks.require_columns(df, ["a"], exact=False).columns == ["a"]


def test_keys_are_compared_as_text(spark):
    numbers = spark.createDataFrame([(1,), (2,)], "k int").select(F.col("k").cast("string").alias("k"))
    texts = spark.createDataFrame([("1",), (None,)], "k string")
    found = rows(checks.key_violations(numbers.union(texts).orderBy("k"), ["k"]).select("problem", "n"))
    assert found == [("duplicate", 2), ("missing", 1)]


def test_domains_and_roles(spark):
    df = spark.createDataFrame([("Train",), ("Test",), ("Odd",), (None,)], "p string")
    assert sorted((str(r["p"]), r["n"]) for r in checks.domain_violations(df, "p", ["Train", "Test"]).collect()) == [("None", 1), ("Odd", 1)]
    classified = checks.classify_roles(df, "p", {"fit": ["Train"], "scored": [], "coefficient": ["Test"]})
    assert rows(checks.role_problems(classified)) == [("empty:scored", 0), ("undeclared", 2)]
    with pytest.raises(ContractViolation):
        checks.classify_roles(df, "p", {"fit": ["Train"], "scored": ["Train"]})


def test_attribute_conflicts_see_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("c", "z"), ("d", None)], "i string, v string")
    assert [r["identity"] for r in checks.attribute_conflicts(df, "i", "v").orderBy("identity").collect()] == ["b", "c"]


def test_formats(spark):
    good = ("f1", "a" * 64, "2024-02-29", 5, "x/y.csv")
    bad = ("f2", "A" * 64, "2023-02-29", 0, "../y.csv")
    df = spark.createDataFrame([good, bad], "path string, sha string, day string, size int, loc string")
    rules = {"sha": "sha256", "day": "iso_date", "size": "positive", "loc": "relative_path"}
    assert rows(checks.format_violations(df, ["path"], rules)) == [
        ("f2", "day:iso_date"), ("f2", "loc:relative_path"), ("f2", "sha:sha256"), ("f2", "size:positive"),
    ]


def test_sequences(spark):
    steps = [("ok", 1), ("ok", 2), ("gap", 1), ("gap", 3), ("twice", 1), ("twice", 1), ("zero", 0), ("null", None), ("null", 1)]
    df = spark.createDataFrame(steps, "g string, s int")
    assert sorted(r["g"] for r in checks.sequence_violations(df, ["g"], "s").collect()) == ["gap", "null", "twice", "zero"]


def test_patterns_search_the_whole_text(spark):
    df = spark.createDataFrame([(1, "x" * 50_000 + " secret"), (2, "nothing")], "k int, t string")
    assert rows(checks.scan_patterns(df, ["k"], "t", {"s": "secret", "n": "not"})) == [(1, "s"), (2, "n")]


def test_result_rows(spark):
    columns = "m int, ci95_low double, ci95_high double, ci99_low double, ci99_high double, a double, b double, d double"
    df = spark.createDataFrame(
        [
            (1, -1.0, 1.0, -2.0, 2.0, 3.0, 1.0, 2.0),
            (2, 1.0, -1.0, -2.0, 2.0, 3.0, 1.0, 2.0),
            (3, -3.0, 1.0, -2.0, 2.0, 3.0, 1.0, 2.0),
            (4, -1.0, 1.0, -2.0, float("nan"), 3.0, 1.0, 2.1),
        ],
        columns,
    )
    found = rows(checks.result_violations(df, ["m"], difference=("a", "b", "d")))
    assert (2, "ci95:order") in found and (3, "ci95:outside_ci99") in found
    assert (4, "ci99_high:not_finite") in found and (4, "difference") in found
    assert not [r for r in found if r[0] == 1]


def test_conformance(spark):
    expected = spark.createDataFrame([(1, 10), (2, None), (3, 5)], "k int, v int")
    observed = spark.createDataFrame([(1, 11), (2, None), (4, 5)], "k int, v int")
    assert rows(checks.conformance(expected, observed, ["k"], ["v"]).select("k", "status")) == [(1, "changed"), (3, "missing"), (4, "extra")]


def test_prediction_tables(spark):
    good = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "record_id string, prediction double")
    assert checks.validate_predictions(good, 2).count() == 2
    for bad, n in ((good, 3), (good.union(good), 4), (good.withColumn("prediction", F.lit(float("nan"))), 2)):
        with pytest.raises(ContractViolation):
            checks.validate_predictions(bad, n)
    with pytest.raises(ContractViolation):
        checks.validate_predictions(good.withColumn("target", F.lit(1.0)), 2)


def package(spark):
    records = spark.createDataFrame([(f"r{i}", "s") for i in range(4)], "record_id string, structure string")
    labels = spark.createDataFrame([(f"r{i}", float(i)) for i in range(4)], "record_id string, target double")
    parts = spark.createDataFrame(
        [(f"r{i}", f, "scored" if i % 2 == f else "fit") for i in range(4) for f in (0, 1)], "record_id string, fold_index int, role string"
    )
    return records, labels, parts


def test_package_mutations_are_caught(spark):
    records, labels, parts = package(spark)

    def broken(r=records, l=labels, p=parts, scored=4, assignment="one_held_out"):
        return {x["rule"] for x in package_violations(r, l, p, [0, 1], ["fit", "scored"], scored, assignment).collect()}

    assert broken() == set()
    assert broken(l=labels.filter("record_id <> 'r0'")) == {"record:without_label"}
    assert broken(l=labels.union(labels.limit(1))) == {"label:duplicate"}
    assert broken(r=records.filter("record_id <> 'r1'")) == {"label:without_record", "partition:unknown_record"}
    assert broken(l=labels.withColumn("target", F.lit(float("inf")))) == {"label:not_finite"}
    assert broken(scored=5) == {"scored:count"}
    assert broken(assignment="same_rows_in_every_fold") == {"scored:pattern"}
    assert "partition:duplicate" in broken(p=parts.union(parts.limit(1)))
    assert "partition:unknown_fold_or_role" in broken(p=parts.withColumn("fold_index", F.lit(7)))
    assert "record:without_partition" in broken(p=parts.filter("record_id <> 'r3'"))
    assert broken(p=parts.withColumn("role", F.when(F.col("fold_index") == 0, F.lit("fit")).otherwise(F.col("role"))), scored=2) == {"fold:roles:0"}

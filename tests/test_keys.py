import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise import ContractViolation
from foldwise.operators import keys
from foldwise.operators.containment import passage_overlap
from foldwise.operators.proximity import close_pairs, proximity_edges, spread_directions


def predictions(spark, ids):
    return spark.createDataFrame([(i, float(n), n) for n, i in enumerate(ids)], "record_id string, prediction double, ord int")


def labels(spark, ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "record_id string, target double")


def test_binding_is_one_to_one_and_keeps_the_order(spark):
    bound = keys.bind_exact(predictions(spark, "cab"), labels(spark, "abc"), ["prediction"], order="ord")
    assert [r["record_id"] for r in keys.restore_order(bound, "ord").collect()] == ["c", "a", "b"]
    for left, right in (("a", "ab"), ("ab", "a"), ("aa", "a"), ("a", "aa")):
        with pytest.raises(ContractViolation):
            keys.bind_exact(predictions(spark, left), labels(spark, right), ["prediction"])
    with pytest.raises(ContractViolation):
        keys.bind_exact(predictions(spark, "a").withColumn("target", F.lit(1.0)), labels(spark, "a"), ["prediction"])
    with pytest.raises(ContractViolation, match="not_finite"):
        keys.bind_exact(predictions(spark, "a"), labels(spark, "a").withColumn("target", F.lit(float("nan"))), ["prediction"])


def test_numbers_and_texts_are_one_id(spark):
    left = spark.createDataFrame([(1, 0.5)], "record_id int, prediction double")
    assert keys.bind_exact(left, labels(spark, "1"), ["prediction"]).count() == 1


def test_overlaps(spark):
    stages = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("c", "2")], "stage string, record_id string")
    found = sorted(tuple(r) for r in keys.stage_overlaps(stages).collect())
    assert found == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]
    texts = spark.createDataFrame([("x",), ("x",), ("y",)], "t string")
    other = spark.createDataFrame([("y",), ("z",), ("z",)], "t string")
    assert sorted(r["problem"] for r in keys.content_overlap(texts, other, "t").collect()) == ["duplicate_test", "duplicate_train", "overlap"]
    coefficient = spark.createDataFrame([(0, "a"), (1, "b")], "deployment_fold int, record_id string")
    scored = spark.createDataFrame([(0, "b"), (1, "b")], "fold_index int, record_id string")
    assert [tuple(r) for r in keys.coefficient_overlap(coefficient, scored).collect()] == [(1, "b")]


def test_override_and_population(spark):
    base = labels(spark, "abc")
    other = spark.createDataFrame([("a", 1.004), ("b", 1.2)], "record_id string, target double")
    found = {r["record_id"]: (r["target"], r["rejected"]) for r in keys.override_labels(base, other, 0.005).collect()}
    assert found == {"a": (1.004, False), "b": (1.2, True), "c": (1.0, False)}
    changed = base.withColumn("target", F.col("target") + 1e-13)
    assert keys.population_diff(base, changed, ["record_id"], ["target"], 1e-12).count() == 0
    assert keys.population_diff(base, changed, ["record_id"], ["target"]).count() == 3
    assert sorted(r["status"] for r in keys.population_diff(base, labels(spark, "abd"), ["record_id"], ["target"]).collect()) == ["left_only", "right_only"]


def test_rows_and_missing_ids(spark):
    with pytest.raises(ContractViolation):
        keys.rows_in_exact(labels(spark, "ab"), labels(spark, "ac"))
    assert [r["record_id"] for r in keys.missing_ids(labels(spark, "aacc"), labels(spark, "a")).collect()] == ["c"]


def test_fingerprints(spark):
    rows = [("s", f"r{i}") for i in range(500)] + [("t", "hot")] * 400
    df = spark.createDataFrame(rows, "stage string, record_id string")
    a, b = (sorted(map(tuple, keys.fingerprint(df.repartition(n), ["stage"]).collect())) for n in (1, 16))
    assert a == b and [x[1] for x in a] == [500, 400]
    fewer = spark.createDataFrame(rows[:-1], df.schema)
    assert sorted(map(tuple, keys.fingerprint(fewer, ["stage"]).collect()))[1][2] != a[1][2]


def test_top_first_and_union(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", 2, 3), ("b", 9, 4)], "k string, s int, ord int")
    top = sorted((r["k"], r["s"], r["rank"]) for r in keys.top_k_per_key(df, ["k"], ["s", "ord"], 2).collect())
    assert top == [("a", 1, 1), ("a", 2, 2), ("b", 9, 1)]
    assert sorted(r["ord"] for r in keys.first_seen(df, ["k"], "ord").collect()) == [1, 4]
    one, two = labels(spark, "ab"), labels(spark, "bc").withColumn("target", F.lit(2.0))
    found = {r["record_id"]: r["target"] for r in keys.union_distinct([one, two], ["record_id"]).collect()}
    assert found == {"a": 1.0, "b": 1.0, "c": 2.0}
    assert keys.id_union(one, two).count() == 3 and keys.id_minus(one, two).count() == keys.id_intersect(one, two).count() == 1


def test_passages_are_found_character_for_character(spark):
    texts = {
        1: "prefixone two three four five six sevensuffix",
        2: "one  two three four five six seven",
        3: "nothing here",
        4: "ab",
        5: "xx ab yy",
        6: "zoner twox",
        7: "",
        8: "tail\none two\tthree",
    }
    items = {
        10: "one two three four five six seven",
        11: "ab",
        12: "oner two",
        13: "two three four",
        14: "b",
        15: "e two\tt",
        16: "absent words in no text at all",
    }
    documents = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    passages = spark.createDataFrame(list(items.items()), "item_id int, text string")
    found = sorted(tuple(r) for r in passage_overlap(documents, passages).collect())
    assert found == sorted((d, i) for d, t in texts.items() for i, p in items.items() if p in t)
    empty = passage_overlap(documents, passages.filter("item_id < 0"))
    assert empty.count() == 0


def brute_pairs(points, cutoff):
    return sorted(
        (g, a, b)
        for a, (g, p) in points.items()
        for b, (h, q) in points.items()
        if a != b and g == h and np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()) <= cutoff
    )


@pytest.mark.parametrize("tile_rows", [2000, 7])
def test_close_pairs_equal_brute_force_with_a_hot_group(spark, tile_rows):
    rng = np.random.default_rng(0)
    points = {f"p{i}": ("hot" if i % 3 else f"g{i % 4}", [float(x) for x in rng.uniform(-3, 3, size=3)]) for i in range(120)}
    nodes = spark.createDataFrame([(k, g, p) for k, (g, p) in points.items()], "record_id string, label string, embedding array<double>")
    found = sorted((r["label"], r["source"], r["target"]) for r in close_pairs(nodes, 1.1, tile_rows=tile_rows).collect())
    assert found == brute_pairs(points, 1.1)


@pytest.mark.parametrize("axes,tile_rows", [(3, 2000), (2, 4), (1, 30), (0, 9)])
def test_close_pairs_of_many_dimensions(spark, axes, tile_rows):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 24)) * 6
    points = {f"p{i}": (f"g{i % 2}", (middles[i % 12] + rng.normal(size=24) * 0.5).tolist()) for i in range(180)}
    nodes = spark.createDataFrame([(k, g, p) for k, (g, p) in points.items()], "record_id string, label string, embedding array<double>")
    directions = np.array(spread_directions(nodes, 3.0, axes=axes)).reshape(-1, 24)
    assert len(directions) == axes and np.allclose((directions**2).sum(axis=1), 1)
    found = sorted((r["label"], r["source"], r["target"]) for r in close_pairs(nodes, 3.0, axes=axes, tile_rows=tile_rows).collect())
    assert found == brute_pairs(points, 3.0) and len(found) > 1000


def test_points_on_a_small_sphere_have_no_grid(spark):
    points = np.random.default_rng(2).normal(size=(60, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, "g", p) for i, p in enumerate(points.tolist())], "record_id long, label string, embedding array<double>")
    assert spread_directions(nodes, 1.2) == [] == spread_directions(nodes.limit(0), 1.2)
    assert close_pairs(nodes.limit(0), 1.2).count() == 0
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert close_pairs(nodes, 1.2).count() == int((distance <= 1.2).sum()) - 60


def test_edges_keep_listed_and_give_loops_to_lonely_groups(spark):
    nodes = spark.createDataFrame(
        [("a", "g", [0.0, 0.0, 0.0]), ("b", "g", [1.0, 0.0, 0.0]), ("c", "g", [9.0, 0.0, 0.0]), ("d", "h", [0.0, 0.0, 0.0]), ("e", "h", [9.0, 0.0, 0.0])],
        "record_id string, label string, embedding array<double>",
    )
    listed = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], "label string, source string, target string")
    found = sorted(tuple(r) for r in proximity_edges(nodes, listed, 1.5).select("label", "source", "target", "kind").collect())
    assert found == [("g", "a", "b", "listed"), ("g", "b", "a", "proximity"), ("g", "b", "c", "listed"), ("h", "d", "d", "self")]


def test_a_second_label_source_names_each_record_once(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "record_id string, target double")
    repeated = spark.createDataFrame([("a", 1.0), ("a", 1.1)], base.schema)
    with pytest.raises(ContractViolation, match="repeats"):
        keys.override_labels(base, repeated, 0.5)
    part = spark.createDataFrame([("a", 1.25)], base.schema)
    assert keys.override_labels(base, part, 0.5).count() == 2
    with pytest.raises(ContractViolation, match="same records"):
        keys.override_labels(base, part, 0.5, complete=True)


def test_fingerprints_travel_once_and_count_repeats_anywhere(spark):
    lines = [(g, v) for g in ("a", "b", None) for v in ["x", "x", "y", None, *map(str, range(300))]]
    table = spark.createDataFrame(lines, "g string, v string")
    counted, plain = (keys.fingerprint(table, ["g"], "v", repeats=r) for r in (True, False))
    plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (counted, plain)]
    assert plans == [3, 2]  # lines are counted, placed, and 4,096 digests a group are put together
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect())) and plain.first()["n"] == 304


def test_tiles_without_a_close_pair_and_pairs_in_parts(spark, monkeypatch):
    from foldwise.operators import proximity

    monkeypatch.setattr(proximity, "EXACT_ROWS", 3)
    points = {f"p{i}": (f"g{i % 2}", [float(i // 4), 0.25 * (i % 3)]) for i in range(40)}
    nodes = spark.createDataFrame([(k, g, p) for k, (g, p) in points.items()], "record_id string, label string, embedding array<double>")
    found = sorted((r["label"], r["source"], r["target"]) for r in close_pairs(nodes, 0.3, axes=0, tile_rows=2).collect())
    assert found == brute_pairs(points, 0.3) and found
    edges = proximity_edges(nodes, nodes.limit(0).select("label", "record_id", "record_id").toDF("label", "source", "target"), 0.3)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[label#\d+\], \[label#\d+\]\n", plan)  # groups meet the distinct groups of the edges


@pytest.mark.parametrize("axes,tile_rows", [(0, 2000), (0, 9), (3, 4)])
def test_listed_pairs_are_left_out_where_they_are_found(spark, axes, tile_rows):
    rng = np.random.default_rng(6)
    points = {i: (f"g{i % 3}", [float(np.float32(x)) for x in rng.uniform(-2, 2, size=3)]) for i in range(90)}
    rows = [(k, g, p) for k, (g, p) in points.items()]
    nodes = spark.createDataFrame([*rows, (900, "h", [0.0] * 3), (901, "h", [0.0] * 3), (902, "i", [9.0] * 3)], "record_id long, label string, embedding array<float>")
    close = brute_pairs(points, 1.3)
    listed = [(g, a, b) for g, a, b in close if g != "g2" and (a * b) % 4 == 1] + [("g0", 0, b) for b in range(90)] + [("g1", 1, 7777), ("g2", 5, 0)]
    table = spark.createDataFrame([*listed, listed[0]], "label string, source int, target int")
    found = close_pairs(nodes, 1.3, axes=axes, tile_rows=tile_rows, without=table).where("label <> 'h'").select("label", "source", "target")
    left = sorted(set(close) - set(listed))
    assert sorted(map(tuple, found.collect())) == left and 0 < len(left) < len(close)
    edges = proximity_edges(nodes, table.distinct(), 1.3, axes=axes, tile_rows=tile_rows)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan  # no table of all pairs in between, and none is shuffled to meet the listed ones
    kinds = {kind: sorted((r["label"], r["source"], r["target"]) for r in edges.collect() if r["kind"] == kind) for kind in ("proximity", "self")}
    assert kinds == {"proximity": sorted([*left, ("h", 900, 901), ("h", 901, 900)]), "self": [("i", 902, 902)]}

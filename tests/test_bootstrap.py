import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators.bootstrap import against_theory, asymptotic_error, block_sums, block_tree, paired_bootstrap, paired_comparisons, path_draws, poisson_weights
from foldwise.operators.metrics import unpivot_axes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=400)
    data = [(f"r{i}", float(v), float(v + rng.normal(0, 0.5)), float(v + rng.normal(0, 0.6)), i % 3) for i, v in enumerate(y)]
    return spark.createDataFrame(data, "record_id string, target double, a double, b double, g int").persist()


def one(df, method, replicates=1000, **options):
    return paired_bootstrap(df, "a", "b", 17, replicates, method=method, **options).first()


@pytest.mark.parametrize("method", ["hash", "multinomial", "poisson"])
def test_golden_difference_is_resolved(spark, method):
    core = spark.createDataFrame([(f"s{i}", 0.2 * i, 0.5, 0.0) for i in (1, 2, 3, 4)], "record_id string, target double, a double, b double")
    row = one(core, method, 200)
    assert row["delta"] == pytest.approx(-0.32411575975518725, abs=1e-15)
    assert (row["n"], row["replicates"], row["seed"], row["method"]) == (4, 200, 17, method)


def test_methods_agree_with_a_plain_bootstrap(rows):
    table = rows.toPandas()
    ea, eb = (table["a"] - table["target"]).to_numpy() ** 2, (table["b"] - table["target"]).to_numpy() ** 2
    picked = np.random.default_rng(1).integers(0, 400, size=(4000, 400))
    values = np.sqrt(ea[picked].mean(axis=1)) - np.sqrt(eb[picked].mean(axis=1))
    low, high = np.quantile(values, [0.025, 0.975])
    for method in ("hash", "multinomial", "poisson"):
        row = one(rows, method)
        width = row["ci95_high"] - row["ci95_low"]
        assert width == pytest.approx(high - low, rel=0.15), method
        assert row["bootstrap_mean"] == pytest.approx(values.mean(), abs=0.01)
        assert row["ci99_low"] <= row["ci95_low"] <= row["ci95_high"] <= row["ci99_high"]


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_partitions_do_not_matter(rows, method):
    first, second = (one(rows.repartition(n), method, 100) for n in (1, 16))
    for c in ("delta", "bootstrap_mean", "ci95_low", "ci95_high"):
        assert first[c] == pytest.approx(second[c], abs=1e-12)


def test_draws_over_blocks_are_one_multinomial(spark):
    sizes = {0: 500, 2: 100, 3: 400}
    rows = [("g", 2, block) for block, n in sizes.items() for _ in range(n)] + [("small", 0, 0)] * 3
    tree = block_tree(spark.createDataFrame(rows, "_group string, _depth int, _block long")).collect()
    paths = {row["_block"]: [tuple(node) for node in row["_path"]] for row in tree}
    assert {row["_group"] for row in tree} == {"g"}
    assert paths == {0: [(1, 0, 1000, 500), (2, 0, 500, 500)], 2: [(1, 0, 1000, 500), (2, 1, 500, 100)], 3: [(1, 0, 1000, 500), (2, 1, 500, 100)]}
    draws = np.array([path_draws(1000, 2, block, paths[block], 5, 2000) for block in sizes])
    assert (draws.sum(axis=0) == 1000).all()
    assert draws.mean(axis=1) == pytest.approx([500, 100, 400], rel=0.02)
    assert draws[0].var() == pytest.approx(1000 * 0.5 * 0.5, rel=0.15)
    assert draws[1].var() == pytest.approx(1000 * 0.1 * 0.9, rel=0.15)
    assert (path_draws(7, 0, 0, [], -3, 4) == 7).all()
    draws[1][:3] = 0
    sums, other = block_sums(np.ones(50), np.full(50, 2.0), draws[1], np.random.default_rng(0))
    assert (sums == draws[1]).all() and (other == 2.0 * draws[1]).all()


def test_each_row_of_a_block_is_drawn_equally_often():
    one_hot = np.eye(5)
    draws = np.array([0, 40_000, 1, 0, 60_000])
    sums = np.array([block_sums(row, row * 2, draws, np.random.default_rng(4))[0] for row in one_hot])
    assert (sums.sum(axis=0) == draws).all()
    assert sums[:, 1] == pytest.approx([8000] * 5, rel=0.05) and sums[:, 4] == pytest.approx([12000] * 5, rel=0.05)


def test_many_groups_and_one_deep_tree(spark, monkeypatch):
    from foldwise.operators import bootstrap

    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", 16)
    ids = spark.range(400 * 40).withColumn("g", F.col("id") % 400)
    noise = [F.rand(seed) for seed in (1, 2)]
    rows = ids.select(F.col("id").alias("record_id"), "g", F.lit(0.0).alias("target"), noise[0].alias("a"), noise[1].alias("b")).persist()
    found = paired_bootstrap(rows, "a", "b", 9, 20, by=["g"])
    inside = F.count_if((F.col("ci99_low") <= F.col("ci95_low")) & (F.col("ci95_high") <= F.col("ci99_high")))
    assert tuple(found.agg(F.count(F.lit(1)), F.sum("n"), inside).first()) == (400, 16_000, 400)
    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", 8)
    few = rows.where("record_id < 2000")
    deep = one(few, "multinomial", 50)
    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", 40_000)
    assert deep["delta"] == pytest.approx(one(few, "multinomial", 50)["delta"])


def test_intervals_fit_the_large_sample_error(rows):
    for metric in ("rmse", "mae"):
        error = asymptotic_error(rows, "a", "b", metric)
        la, lb = ((rows.toPandas()[c] - rows.toPandas()["target"]).abs().to_numpy() for c in "ab")
        if metric == "rmse":
            la, lb = la**2 / (2 * np.sqrt((la**2).mean())), lb**2 / (2 * np.sqrt((lb**2).mean()))
        assert error.first()["error"] == pytest.approx((la - lb).std() / 20)
        for method in ("multinomial", "poisson"):
            result = paired_bootstrap(rows, "a", "b", 17, 10_000, metric, method=method)
            row = against_theory(result, error, tolerance=0.15).first()
            assert row["mean_fits"] and row["ci95_fits"] and row["ci99_fits"]
            assert not against_theory(result, error.withColumn("error", 2 * F.col("error"))).first()["ci95_fits"]


def test_poisson_weights():
    hashes = np.random.default_rng(3).integers(-(2**62), 2**62, size=2000)
    weights = poisson_weights(hashes, 0, 300)
    assert weights.mean() == pytest.approx(1.0, abs=0.01) and weights.var() == pytest.approx(1.0, abs=0.02)
    assert (poisson_weights(hashes, 100, 50) == weights[:, 100:150]).all()
    from foldwise.operators import bootstrap

    edges = np.concatenate([bootstrap._poisson_table()[:6], np.linspace(0, 1, 999, endpoint=False)])
    coarse, unsure = bootstrap._coarse_table()
    step = (edges * 2**bootstrap.COARSE_BITS).astype(int)
    exact = np.searchsorted(bootstrap._poisson_table(), edges, side="right")
    assert (unsure[step] | (coarse[step] == exact)).all() and unsure.sum() < 20
    assert abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.08


def test_many_blocks_give_the_same_distribution(rows, monkeypatch):
    from foldwise.operators import bootstrap

    one_block = one(rows, "multinomial")
    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", 50)
    many = one(rows, "multinomial")
    assert many["delta"] == one_block["delta"]
    assert many["ci95_high"] - many["ci95_low"] == pytest.approx(one_block["ci95_high"] - one_block["ci95_low"], rel=0.15)


def test_groups_and_comparisons(rows):
    grouped = paired_bootstrap(rows, "a", "b", 3, 200, metric="mae", by=["g"], method="poisson").collect()
    assert sorted((r["g"], r["n"]) for r in grouped) == [(0, 134), (1, 133), (2, 133)]
    both = paired_comparisons(rows, {"x": ("a", "b", 3), "y": ("b", "a", 4)}, replicates=200)
    found = {r["comparison"]: r for r in both.collect()}
    assert found["x"]["delta"] == pytest.approx(-found["y"]["delta"]) and (found["x"]["seed"], found["y"]["seed"]) == (3, 4)
    long = unpivot_axes(rows, {"g": F.col("g")}, ["record_id", "target", "a", "b"]).withColumn("level_index", F.col("level").cast("int"))
    from foldwise.operators.bootstrap import subgroup_bootstrap

    seeds = {r["level"]: r["seed"] for r in subgroup_bootstrap(long, "a", "b", 100, 2, 50).collect()}
    assert seeds == {"0": 2100, "1": 2110, "2": 2120}


def test_pairs_and_pieces_draw_every_row_equally_often(monkeypatch):
    from foldwise.operators import bootstrap

    monkeypatch.setattr(bootstrap, "PAIR_ROWS", 4)
    draws = np.array([0, 1, 60_000, 61_001])
    sums = np.array([block_sums(row, 2 * row, draws, np.random.default_rng(6))[0] for row in np.eye(11)])
    assert (sums.sum(axis=0) == draws).all()
    assert sums[:, 2] == pytest.approx([60_000 / 11] * 11, rel=0.06) and sums[:, 3] == pytest.approx([61_001 / 11] * 11, rel=0.06)
    spread = block_sums(np.eye(11)[0], np.zeros(11), np.full(4000, 33), np.random.default_rng(7))[0]
    assert spread.var() == pytest.approx(33 / 11 * 10 / 11, rel=0.12)  # binomial, so draws do not hang together


@pytest.mark.parametrize("block_rows", [16_384, 50])
def test_poisson_weights_per_block_are_those_per_row_in_distribution(rows, monkeypatch, block_rows):
    from foldwise.operators import bootstrap

    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", block_rows)
    each, blocks = one(rows, "poisson", 4000), one(rows.repartition(7), "poisson_blocks", 4000)
    assert blocks["method"] == "poisson" and blocks["delta"] == pytest.approx(each["delta"], abs=1e-12)
    assert blocks["ci95_high"] - blocks["ci95_low"] == pytest.approx(each["ci95_high"] - each["ci95_low"], rel=0.1)
    assert blocks["bootstrap_mean"] == pytest.approx(one(rows, "poisson_blocks", 4000)["bootstrap_mean"], abs=1e-12)
    losses = bootstrap._losses(rows, "target", "a", "b", "mae", [], "record_id", 17)
    assert "Sort " not in bootstrap._poisson_replicates(losses.withColumn("g", F.lit(1)), 5, "mae", ["g"], "record_id")._jdf.queryExecution().optimizedPlan().toString()

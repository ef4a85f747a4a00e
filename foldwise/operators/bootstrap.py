"""Paired bootstrap intervals for the difference of two predictors' RMSE or MAE.

Both predictors always see the same draws. Four ways to draw:

``hash``         n draws with replacement per replicate, each a hash of (seed, replicate, draw). Plain
                 SQL, equal in any engine; it shuffles n x replicates rows, so it is for small tables.
``multinomial``  n draws with replacement, exactly distributed, without a row per draw: rows are cut into
                 blocks by the bits of a hash, each group as deep as its size asks for; the draws of a
                 replicate are split down the binary tree of hash prefixes by seeded binomials, and the
                 draws inside a block are made there with NumPy. The tree is a table in Spark.
``poisson``      every row gets an independent Poisson(1) weight per replicate, a hash of (record,
                 replicate); one narrow pass and no ordinals. The replicate size varies, so this is an
                 approximation, and the output says so.
``poisson_blocks``  the same weights in distribution, made per block of rows like ``multinomial``: for many
                 replicates, as a draw costs a fraction of a hash. The output says ``poisson`` as well.

All but the first emit one partial sum per replicate and task; the shuffle does not grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractViolation
from ..functions.hashing import hash60, order_hash, seeded_text
from ..functions.numbers import to_column
from .ranking import hashed_rank

REPLICATES = 10_000
REPLICATE_BLOCK = 250
BLOCK_ROWS = 16_384
PAIR_ROWS = 256
DRAWS_IN_MEMORY = 50_000  # a batch of look-ups stays in the cache
COARSE_BITS = 12
HELD_SUMS = 1_000_000


def _loss(metric: str, prediction, observed) -> Column:
    error = to_column(prediction) - to_column(observed)
    if metric == "rmse":
        return error * error
    if metric == "mae":
        return F.abs(error)
    raise ContractViolation(f"unknown metric: {metric}")


def _difference(metric: str, a: Column, b: Column) -> Column:
    return F.sqrt(a) - F.sqrt(b) if metric == "rmse" else a - b


def _losses(df, observed, a, b, metric, by, key, seed):
    seed = seed if isinstance(seed, Column) else F.lit(int(seed))
    return df.select(
        *by, key, seed.cast("bigint").alias("_seed"), _loss(metric, a, observed).alias("_a"), _loss(metric, b, observed).alias("_b")
    )


def _group(by: list[str]) -> Column:
    """One text per group, different for different groups, with a null apart from an empty text."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def _summary(losses, replicates_table, metric, by, replicates, method) -> DataFrame:
    """Point estimate from the rows, interval from the replicates (at most ``replicates`` per group)."""
    point = losses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_seed").alias("seed"),
        _difference(metric, F.avg("_a"), F.avg("_b")).alias("delta"),
    )
    limits = [0.025, 0.975, 0.005, 0.995]
    draws = replicates_table.groupBy(*by).agg(
        F.avg("_delta").alias("bootstrap_mean"),
        F.percentile("_delta", F.array(*[F.lit(q) for q in limits])).alias("_q"),
    )
    if by:  # null is a group like any other, so groups meet by their text
        joined = point.withColumn("_group", _group(by)).join(draws.withColumn("_group", _group(by)).drop(*by), "_group")
    else:
        joined = point.crossJoin(F.broadcast(draws))  # one row each
    low, high = F.element_at("_q", 1), F.element_at("_q", 2)
    return joined.select(
        *by,
        "n",
        "delta",
        "bootstrap_mean",
        low.alias("ci95_low"),
        high.alias("ci95_high"),
        F.element_at("_q", 3).alias("ci99_low"),
        F.element_at("_q", 4).alias("ci99_high"),
        F.when((low > 0) | (high < 0), F.lit("resolved")).otherwise(F.lit("inconclusive")).alias("inference"),
        F.lit(int(replicates)).alias("replicates"),
        "seed",
        F.lit(method).alias("method"),
    )


def paired_bootstrap(
    df: DataFrame,
    a: str,
    b: str,
    seed,
    replicates: int = REPLICATES,
    metric: str = "rmse",
    by: Iterable[str] = (),
    observed: str = "target",
    key: str = "record_id",
    method: str = "multinomial",
) -> DataFrame:
    """Difference a - b with bootstrap mean, 95% and 99% percentile intervals and the inference.

    ``seed`` is a number or, with ``by``, a column that is constant in each group.
    """
    by = list(by)
    if replicates < 1:
        raise ContractViolation("replicates must be positive")
    losses = _losses(df, observed, a, b, metric, by, key, seed)
    if method == "hash":
        table = _hash_replicates(losses, replicates, metric, by, key)
    elif method == "multinomial":
        table = _multinomial_replicates(losses, replicates, metric, by, key)
    elif method == "poisson":
        table = _poisson_replicates(losses, replicates, metric, by, key)
    elif method == "poisson_blocks":
        table, method = _poisson_block_replicates(losses, replicates, metric, by, key), "poisson"
    else:
        raise ContractViolation(f"unknown bootstrap method: {method}")
    return _summary(losses, table, metric, by, replicates, method)


def asymptotic_error(df: DataFrame, a: str, b: str, metric: str = "rmse", by: Iterable[str] = (), observed: str = "target") -> DataFrame:
    """(by, n, error): the large-sample standard error of the difference, from one pass of variances and covariance."""
    losses = df.select(*by, _loss(metric, a, observed).alias("_a"), _loss(metric, b, observed).alias("_b"))
    slopes = [1 / (2 * F.sqrt(F.avg(c))) if metric == "rmse" else F.lit(1.0) for c in ("_a", "_b")]
    variance = slopes[0] ** 2 * F.var_pop("_a") + slopes[1] ** 2 * F.var_pop("_b") - 2 * slopes[0] * slopes[1] * F.covar_pop("_a", "_b")
    return losses.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.greatest(variance, F.lit(0.0)) / F.count(F.lit(1))).alias("error"))


def against_theory(result: DataFrame, errors: DataFrame, by: Iterable[str] = (), tolerance: float = 0.1) -> DataFrame:
    """``result`` of :func:`paired_bootstrap` with booleans: do its mean and both intervals fit the large-sample error?"""
    by = list(by)
    errors = errors.select(*by, "error")
    joined = result.join(errors, by) if by else result.crossJoin(F.broadcast(errors))  # one row each

    def fits(name: str, quantile: float):
        width = (F.col(f"{name}_high") - F.col(f"{name}_low")) / (2 * quantile * F.col("error"))
        return F.abs(width - 1) < tolerance

    return joined.withColumns(
        {
            "mean_fits": F.abs(F.col("bootstrap_mean") - F.col("delta")) < tolerance * F.col("error"),
            "ci95_fits": fits("ci95", 1.959963985),
            "ci99_fits": fits("ci99", 2.575829304),
        }
    ).drop("error")


def paired_comparisons(
    df: DataFrame, comparisons: dict[str, tuple[str, str, int]], name: str = "comparison", **options
) -> DataFrame:
    """Several comparisons (name -> a, b, seed) of the same rows in one run, one row each."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias(name), F.col(a).alias("_first"), F.col(b).alias("_second"), F.lit(int(s)).cast("bigint").alias("_s"))
            for n, (a, b, s) in comparisons.items()
        ]
    )
    kept = [options.get("key", "record_id"), options.get("observed", "target")]
    long = df.select(*kept, F.inline(rows))
    return paired_bootstrap(long, "_first", "_second", F.col("_s"), by=[name], **options)


def _hash_replicates(losses, replicates, metric, by, key):
    grouped = losses.withColumn("_group", _group(by))
    ranked = hashed_rank(grouped, order_hash(F.col("_seed"), key), key, by=("_group",), name="_rank", total="_n")
    rows = ranked.select(*by, "_group", (F.col("_rank") - 1).alias("_row"), "_n", "_seed", "_a", "_b")
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep")
    draws = rows.select("_group", "_n", "_seed", F.col("_row").alias("_draw"), each)
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("_seed", "_rep", "_draw")])
    picked = draws.select("_group", "_rep", F.pmod(hash60(text), F.col("_n")).alias("_row"))
    joined = picked.join(rows.drop("_n", "_seed"), ["_group", "_row"])
    return joined.groupBy(*by, "_rep").agg(_difference(metric, F.avg("_a"), F.avg("_b")).alias("_delta"))


def path_draws(total: int, depth: int, block: int, path: list, seed: int, replicates: int) -> np.ndarray:
    """Number of draws that fall into one block, for every replicate.

    ``path`` has a (level, node, rows, rows of the left half) for each node above the block, from the root on. At a node
    the draws are split between its halves by a binomial of their rows, seeded by the node. Every block that passes a
    node makes the same numbers there, so the counts over all blocks are one multinomial draw.
    """
    draws = np.full(replicates, total, dtype=np.int64)
    for level, node, rows, left in path:
        to_left = _generator(seed, level, node).binomial(draws, left / rows)
        draws = draws - to_left if block >> (depth - level) & 1 else to_left
    return draws


def _generator(seed: int, level: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64(np.random.SeedSequence([seed % 2**64, level, node])))


def block_sums(a: np.ndarray, b: np.ndarray, draws: np.ndarray, generator: np.random.Generator) -> tuple:
    """Sums of both losses over the drawn rows of one block, for every replicate.

    Blocks are cut in two, their draws by binomials, down to pieces of at most PAIR_ROWS rows. There two draws are one
    look-up in the sums of all ordered pairs of rows, each as likely as the others, and an odd draw is one in the rows.
    """
    sums = _drawn_sums(a + 1j * b, np.asarray(draws, dtype=np.int64), generator)  # one look-up for both losses
    return sums.real.copy(), sums.imag.copy()


def _drawn_sums(values: np.ndarray, draws: np.ndarray, generator: np.random.Generator) -> np.ndarray:
    if len(values) > PAIR_ROWS:
        half = PAIR_ROWS * (-(-len(values) // PAIR_ROWS) // 2)
        to_left = generator.binomial(draws, half / len(values))
        return _drawn_sums(values[:half], to_left, generator) + _drawn_sums(values[half:], draws - to_left, generator)
    pairs = (values[:, None] + values[None, :]).ravel()
    sums = _look_ups(pairs, draws // 2, generator)
    odd = np.flatnonzero(draws % 2)
    sums[odd] += values[generator.integers(0, len(values), size=len(odd))]
    return sums


def _look_ups(values: np.ndarray, counts: np.ndarray, generator: np.random.Generator) -> np.ndarray:
    """For every replicate the sum of ``counts`` values, each drawn from all with equal chances."""
    sums = np.zeros(len(counts), dtype=np.complex128)
    drawn, room = np.flatnonzero(counts), np.empty(DRAWS_IN_MEMORY, dtype=np.complex128)
    step = max(1, DRAWS_IN_MEMORY // max(1, int(counts.max(initial=1))))
    for start in range(0, len(drawn), step):
        part = drawn[start : start + step]
        ends = np.cumsum(counts[part])
        picked = room[: ends[-1]] if ends[-1] <= len(room) else np.empty(ends[-1], dtype=np.complex128)
        values.take(generator.integers(0, len(values), size=ends[-1]), out=picked, mode="clip")
        sums[part] = np.add.reduceat(picked, ends - counts[part])
    return sums


def block_tree(placed: DataFrame) -> DataFrame:
    """(_group, _block, _path) for rows with _group, _depth and _block: the nodes above each block, with their row counts.

    A block is the first ``_depth`` bits of a row's hash, a node a shorter prefix. Counts are summed per node, and every
    block is joined with the nodes of its own path; nothing passes through the driver.
    """
    counted = placed.where("_depth > 0").groupBy("_group", "_depth", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    steps = counted.withColumn("_level", F.explode(F.sequence(F.lit(1), F.col("_depth")))).withColumns(
        {
            "_node": F.expr("shiftright(_block, _depth - _level + 1)"),
            "_left": F.expr("if(shiftright(_block, _depth - _level) % 2 = 0, _rows, 0)"),
        }
    )
    at = ["_group", "_level", "_node"]
    nodes = steps.groupBy(*at).agg(F.sum("_rows").alias("_total"), F.sum("_left").alias("_of_left"))
    step = F.struct("_level", "_node", "_total", "_of_left")
    return steps.select("_group", "_block", *at[1:]).join(nodes, at).groupBy("_group", "_block").agg(F.sort_array(F.collect_list(step)).alias("_path"))


def _placed(losses: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows with the size of their group and the block of their hash: expected rows of a block are BLOCK_ROWS / 2 to BLOCK_ROWS."""
    bits = 60
    mask = (1 << bits) - 1
    hashed = losses.select(
        *by, _group(by).alias("_group"), F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit(mask)).alias("_hash"), "_seed", "_a", "_b"
    )
    sizes = hashed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min("_seed").alias("_seed"))
    halvings = F.ceil(F.log2(F.col("_n") / F.lit(BLOCK_ROWS)))
    sizes = sizes.withColumn("_depth", F.least(F.greatest(halvings, F.lit(0)), F.lit(bits)).cast("int"))
    return hashed.drop("_seed").join(sizes, "_group").withColumn("_block", F.expr(f"shiftright(_hash, {bits} - _depth)"))


def _block_replicates(by, frame: pd.DataFrame, draws: np.ndarray, generator: np.random.Generator) -> pd.DataFrame:
    sums_a, sums_b = block_sums(frame["_a"].to_numpy(), frame["_b"].to_numpy(), draws, generator)
    out = pd.DataFrame({"_rep": np.arange(len(draws)), "_sa": sums_a, "_sb": sums_b, "_w": draws.astype(float)})
    for column in by:
        out[column] = frame[column].iloc[0]
    return out[[*by, "_rep", "_sa", "_sb", "_w"]]


def _poisson_block_replicates(losses, replicates, metric, by, key):
    """Independent Poisson(1) weights without one per row: their sum over a block is a Poisson of its rows, and given
    that sum they are draws with replacement from the block."""

    def one_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_hash", "_a", "_b"])
        generator = _generator(int(frame["_seed"].iloc[0]), 0, int(frame["_block"].iloc[0]))
        return _block_replicates(by, frame, generator.poisson(len(frame), replicates), generator)

    blocks = _placed(losses, by, key).groupBy("_group", "_block")
    return _combine(blocks.applyInPandas(one_block, _partial_schema(losses, by)), metric, by)


def _multinomial_replicates(losses, replicates, metric, by, key):
    placed = _placed(losses, by, key)
    tree = block_tree(placed).toDF("_of_group", "_of_block", "_path")  # both descend from one table

    def one_block(frame: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_hash", "_a", "_b"])
        head = frame.iloc[0]
        total, depth, block, seed = (int(head[c]) for c in ("_n", "_depth", "_block", "_seed"))
        nodes = [tuple(int(node[c]) for c in ("_level", "_node", "_total", "_of_left")) for node in path["_path"].iloc[0]] if len(path) else []
        draws = path_draws(total, depth, block, nodes, seed, replicates)
        return _block_replicates(by, frame, draws, _generator(seed, 0, block))

    blocks, paths = placed.groupBy("_group", "_block"), tree.groupBy("_of_group", "_of_block")
    return _combine(blocks.cogroup(paths).applyInPandas(one_block, _partial_schema(losses, by)), metric, by)


def _partial_schema(losses: DataFrame, by: list[str]) -> T.StructType:
    fields = [losses.schema[c] for c in by] + [T.StructField("_rep", T.LongType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("_sa", "_sb", "_w")])


def _combine(parts, metric, by):
    means = _difference(metric, F.sum("_sa") / F.sum("_w"), F.sum("_sb") / F.sum("_w"))
    # A replicate in which no row of a tiny group was drawn has no metric.
    return parts.groupBy(*by, "_rep").agg(F.when(F.sum("_w") > 0, means).alias("_delta"))


def _poisson_table(length: int = 24) -> np.ndarray:
    steps = np.array([math.exp(-1.0) / math.factorial(k) for k in range(length)])
    return np.cumsum(steps)


def poisson_weights(hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """Poisson(1) weights, rows x replicates, from 64-bit row hashes and replicate numbers."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)[:, None] + (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        # finaliser of the public-domain SplitMix64 generator
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    uniform = (x >> np.uint64(11)).astype(np.float64) * (1.0 / 9007199254740992.0)
    coarse, unsure = _COARSE
    step = (x >> np.uint64(64 - COARSE_BITS)).astype(np.intp)
    weights = coarse[step]
    again = np.nonzero(unsure[step])  # steps with a limit inside
    weights[again] = np.searchsorted(_poisson_table(), uniform[again], side="right")
    return weights


def _coarse_table() -> tuple[np.ndarray, np.ndarray]:
    """Weight at the start of each of 2^COARSE_BITS equal steps of the unit interval, and whether a limit lies in the step."""
    edges = np.arange(2**COARSE_BITS + 1) / 2**COARSE_BITS
    found = np.searchsorted(_poisson_table(), edges, side="right").astype(np.float64)
    return found[:-1], found[:-1] != found[1:]


_COARSE = _coarse_table()  # a cached function would be looked up by name in tasks, which need not have the package


def _poisson_replicates(losses, replicates, metric, by, key):
    by = list(by)
    group = _group(by)
    rows = losses.select(
        *by, group.alias("_group"), hash60(seeded_text(F.col("_seed"), key)).alias("_hash"), "_a", "_b"
    )

    most = max(1, HELD_SUMS // replicates)

    def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}  # group -> its first row and its sums

        def out() -> Iterator[pd.DataFrame]:
            for head, sums in held.values():
                made = pd.DataFrame({"_rep": np.arange(replicates), "_sa": sums[:, 0], "_sb": sums[:, 1], "_w": sums[:, 2]})
                for column in by:
                    made[column] = head[column]
                yield made[[*by, "_rep", "_sa", "_sb", "_w"]]
            held.clear()

        for frame in frames:
            for name, rows_of in frame.groupby("_group", sort=False):
                if name not in held:
                    if len(held) >= most:  # partial sums may leave the task at any time
                        yield from out()
                    held[name] = rows_of.iloc[0], np.zeros((replicates, 3))
                sums = held[name][1]
                hashes = rows_of["_hash"].to_numpy().astype(np.int64)
                values = np.stack([rows_of["_a"].to_numpy(), rows_of["_b"].to_numpy(), np.ones(len(rows_of))], axis=1)
                for first in range(0, replicates, REPLICATE_BLOCK):
                    count = min(REPLICATE_BLOCK, replicates - first)
                    sums[first : first + count] += poisson_weights(hashes, first, count).T @ values
        yield from out()

    return _combine(rows.mapInPandas(partial_sums, _partial_schema(losses, by)), metric, by)


def subgroup_bootstrap(
    long: DataFrame,
    a: str,
    b: str,
    base_seed: int,
    panel_index: int = 0,
    replicates: int = REPLICATES,
    metric: str = "rmse",
    observed: str = "target",
    key: str = "record_id",
    level_index: str = "level_index",
    method: str = "poisson",
) -> DataFrame:
    """Poisson bootstrap per (axis, level), each with its own seed: base + 1000 * panel + 10 * level.

    ``long`` has one row per record and axis (see ``unpivot_axes``) and the number of the level.
    """
    seed = F.lit(int(base_seed) + 1000 * int(panel_index)) + F.lit(10) * F.col(level_index)
    by = ["axis", "level", level_index]
    return paired_bootstrap(long, a, b, seed, replicates, metric, by, observed, key, method)

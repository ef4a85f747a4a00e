"""Reproducible splits. Every random order is an MD5 order, every rank is spread over tasks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.hashing import order_hash
from ..functions.numbers import bin_index, is_missing
from ..session import collect_small, reliable_checkpoint
from .quantiles import exact_quantiles
from .ranking import hashed_rank

EDGE_DECIMALS = 9


def map_roles(df: DataFrame, mapping: Mapping[str, str], column: str = "role", name: str = "role") -> DataFrame:
    """Native role to contract role; an undeclared role gives null."""
    expression = F.lit(None).cast("string")
    for native, role in mapping.items():
        expression = F.when(F.col(column) == native, F.lit(role)).otherwise(expression)
    return df.withColumn(name, expression)


def expand_folds(
    df: DataFrame, folds: Iterable[int], role: Column, name: str = "fold_index", role_name: str = "role"
) -> DataFrame:
    """Every row once per fold, with its role; ``role`` may use the new fold column."""
    expanded = df.withColumn(name, F.explode(F.array(*[F.lit(int(f)) for f in folds])))
    return expanded.withColumn(role_name, role)


def held_out_role(assigned: str = "assigned_fold", fold: str = "fold_index") -> Column:
    return F.when(F.col(assigned) == F.col(fold), F.lit("scored")).otherwise(F.lit("fit"))


def role_counts(partitions: DataFrame, roles: Iterable[str], fold: str = "fold_index", role: str = "role") -> DataFrame:
    """Rows of each role per fold, one column per role."""
    columns = [F.count_if(F.col(role) == r).alias(r) for r in roles]
    return partitions.groupBy(fold).agg(*columns)


def scored_pattern(partitions: DataFrame, repetitions: int, key: str = "record_id", role: str = "role") -> DataFrame:
    """Records not scored the required number of times (once, or once per fold): key, n."""
    counted = partitions.groupBy(key).agg(F.count_if(F.col(role) == "scored").alias("n"))
    return counted.filter((F.col("n") > 0) & (F.col("n") != repetitions))


def unscored(partitions: DataFrame, key: str = "record_id", role: str = "role") -> DataFrame:
    counted = partitions.groupBy(key).agg(F.count_if(F.col(role) == "scored").alias("n"))
    return counted.filter(F.col("n") == 0)


def quantile_edges(df: DataFrame, column: str, bins: int, decimals: int = EDGE_DECIMALS) -> list[float]:
    """Distinct quantile edges of a column, lowest to highest."""
    probabilities = [i / bins for i in range(bins + 1)]
    return _distinct_edges(exact_quantiles(df, [column], probabilities)[column], decimals)


def _distinct_edges(values: list[float], decimals: int) -> list[float]:
    return sorted({round(v, decimals) for v in values})


def quantile_bins(df: DataFrame, column: str, bins: int, name: str = "bin", **options) -> DataFrame:
    """Right-closed quantile bins from 0; the lowest value is in bin 0, equal edges are merged."""
    return df.withColumn(name, bin_index(column, quantile_edges(df, column, bins, **options)))


def kfold(df: DataFrame, folds: int, seed, key: str = "record_id", name: str = "assigned_fold") -> DataFrame:
    """Shuffled folds: contiguous blocks of the seeded order, the first n mod k blocks one larger."""
    ranked = hashed_rank(df, order_hash(seed, key), key, name="_rank", total="_n")
    size = F.floor(F.col("_n") / folds)
    large = F.col("_n") % folds
    position, head = F.col("_rank") - 1, large * (size + 1)
    fold = F.when(position < head, F.floor(position / (size + 1))).otherwise(
        large + F.floor((position - head) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn(name, fold.cast("int")).drop("_rank", "_n")


def reserve(
    partitions: DataFrame,
    fraction: float,
    seed: int,
    key: str = "record_id",
    fold: str = "fold_index",
    role: str = "role",
) -> DataFrame:
    """Turn the first ceil(fraction * n) development rows of each fold's seeded order to ``reserved``.

    The seed of a fold is ``seed + fold``; scored rows keep their role.
    """
    share = Fraction(str(fraction))
    # Scored rows are ranked as a group of their own and left alone: one pass instead of two and a union.
    marked = partitions.withColumn("_scored", F.col(role) == "scored")
    order = order_hash(F.col(fold) + F.lit(int(seed)), key)
    ranked = hashed_rank(marked, order, key, by=(fold, "_scored"), name="_rank", total="_n")
    # ceil(n * a / b) in integers, so that no binary fraction can move the limit by one row
    quota = F.floor((F.col("_n") * share.numerator + (share.denominator - 1)) / share.denominator)
    chosen = ~F.col("_scored") & (F.col("_rank") <= quota)
    return ranked.withColumn(role, F.when(chosen, F.lit("reserved")).otherwise(F.col(role))).drop("_rank", "_n", "_scored")


def stratified_kfold(
    df: DataFrame, bin_column: str, folds: int, seed, key: str = "record_id", name: str = "assigned_fold"
) -> DataFrame:
    """Folds that cut every bin evenly and whose sizes differ by one row at most.

    Rows are numbered in (bin, seeded) order and dealt out in turn, without restarting at a bin.
    """
    ranked = hashed_rank(df, order_hash(seed, key), key, leading=(bin_column,), name="_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def bin_round_robin(
    df: DataFrame, bin_column: str, folds: int, seed, key: str = "record_id", name: str = "assigned_fold"
) -> DataFrame:
    """Folds dealt out in turn inside each bin, every bin starting at fold 0."""
    ranked = hashed_rank(df, order_hash(seed, key), key, by=(bin_column,), name="_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def holdout_quotas(counts: DataFrame, bin_column: str, fraction: float, by: Iterable[str] = ()) -> DataFrame:
    """Rows to hold out per bin: ceil(fraction * n) in all, by largest remainder (ties: lower bin).

    ``counts`` has one row per (by, bin) with column ``n``.
    """
    by, share = list(by), Fraction(str(fraction))
    a, b = share.numerator, share.denominator
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sized = counts.withColumn("_total", F.sum("n").over(whole))
    # products of two row counts do not fit into 64 bits, and a double would round them
    wide = {name: f"cast({name} as decimal(19, 0))" for name in ("n", "_total")}
    sized = sized.withColumn("_want", F.expr(f"cast((_total div {b}) * {a} + ((_total % {b}) * {a} + {b - 1}) div {b} as bigint)"))
    product = f"cast(_want as decimal(19, 0)) * {wide['n']}"
    sized = sized.withColumn("_floor", F.expr(f"cast(({product}) div {wide['_total']} as bigint)"))
    # remainders compared as integers: want * n mod total
    sized = sized.withColumn("_rest", F.expr(f"cast(({product}) % {wide['_total']} as bigint)"))
    sized = sized.withColumn("_open", F.col("_want") - F.sum("_floor").over(whole))
    turn = F.row_number().over(whole.orderBy(F.desc("_rest"), bin_column))
    quota = F.col("_floor") + F.when(turn <= F.col("_open"), F.lit(1)).otherwise(F.lit(0))
    return sized.select(*by, bin_column, quota.alias("quota"))


def stratified_holdout(
    df: DataFrame,
    bin_column: str,
    fraction: float,
    seed,
    key: str = "record_id",
    by: Iterable[str] = (),
    name: str = "held_out",
) -> DataFrame:
    """Hold out a fraction of the rows (of each ``by`` group), spread over the bins in proportion."""
    by = list(by)
    counts = df.groupBy(*by, bin_column).agg(F.count(F.lit(1)).alias("n"))
    quotas = holdout_quotas(counts, bin_column, fraction, by)
    order = seed if isinstance(seed, Column) else F.lit(str(seed))
    ranked = hashed_rank(df, order_hash(order, key), key, by=(*by, bin_column), name="_rank")
    joined = ranked.join(quotas, [*by, bin_column], "left")
    return joined.withColumn(name, F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def adaptive_bins(
    df: DataFrame, column: str, highest: int = 20, lowest: int = 4, min_rows: int = 5, min_bins: int = 4, name: str = "bin"
) -> DataFrame:
    """Quantile bins with the largest count for which every bin has enough rows.

    All candidate edges come from one quantile job. Rows are then counted once by the cell between
    neighbouring edges of all candidates together; the candidates are judged from those few counts.
    """
    edges = adaptive_edges(df, column, highest, lowest, min_rows, min_bins)
    return df.withColumn(name, bin_index(column, edges))


def adaptive_edges(df, column, highest=20, lowest=4, min_rows=5, min_bins=4) -> list[float]:
    wanted = sorted({Fraction(i, q) for q in range(lowest, highest + 1) for i in range(q + 1)})
    values = exact_quantiles(df, [column], [float(p) for p in wanted])[column]
    by_fraction = dict(zip(wanted, values))
    every = _distinct_edges(values, EDGE_DECIMALS)
    usable = df.filter(~is_missing(column))
    cells = usable.select(bin_index(column, every).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counts = {row[0]: row[1] for row in collect_small(cells)}
    for q in range(highest, lowest - 1, -1):
        edges = _distinct_edges([by_fraction[Fraction(i, q)] for i in range(q + 1)], EDGE_DECIMALS)
        bins: dict[int, int] = {}
        for cell, n in counts.items():
            upper = every[min(cell + 1, len(every) - 1)]
            index = max(0, min(len(edges) - 2, sum(e < upper for e in edges) - 1))
            bins[index] = bins.get(index, 0) + n
        if len(bins) >= min_bins and min(bins.values()) >= min_rows:
            return edges
    raise ContractViolation("no bin count gives bins of the required size")


def group_split(
    df: DataFrame, group: str, target: str, fraction: float, seed, highest: int = 20, lowest: int = 4, min_rows: int = 5
) -> DataFrame:
    """Split whole groups: stratified by the mean target of the group; members follow their group.

    A hot group needs no single task: members are only joined to the one row of their group.
    """
    means = df.groupBy(group).agg(F.round(F.avg(target), EDGE_DECIMALS).alias("_mean"))
    # the means are read for the edges, the counts and the result, so they are written once
    binned = adaptive_bins(reliable_checkpoint(means), "_mean", highest, lowest, min_rows, name="_bin")
    sides = stratified_holdout(binned, "_bin", fraction, seed, key=group)
    side = F.when(F.col("held_out"), F.lit("score")).otherwise(F.lit("fit"))
    return df.join(sides.select(group, side.alias("side")), group, "left")


def nested_folds(partitions: DataFrame, key: str = "record_id", fold: str = "fold_index", role: str = "role") -> DataFrame:
    """Inner selection sets: for outer fold f and each other fold g, the development rows of f are
    ``selection_fit`` unless g scores them, which makes them ``selection_score``.

    A record is reduced to its set of (fold, role) pairs, no more than there are folds, and expanded
    from it; the table is not joined to itself.
    """
    rows = partitions.groupBy(key).agg(F.collect_set(F.struct(fold, role)).alias("_roles"))
    outer = rows.select(key, "_roles", F.explode("_roles").alias("_o")).filter(F.col(f"_o.{role}") != "scored")
    inner = outer.select(key, "_o", F.explode("_roles").alias("_i")).filter(F.col(f"_i.{fold}") != F.col(f"_o.{fold}"))
    stage = F.when(F.col(f"_i.{role}") == "scored", F.lit("selection_score")).otherwise(F.lit("selection_fit"))
    return inner.select(
        F.col(f"_o.{fold}").alias("outer_fold"), F.col(f"_i.{fold}").alias("inner_fold"), key, stage.alias("stage")
    )


def melt_splits(df: DataFrame, columns: Mapping[str, int], roles: Mapping[str, str], key: str = "record_id") -> DataFrame:
    """Supplied split columns to long partition rows; ``columns`` is column -> fold."""
    pairs = F.array(*[F.struct(F.lit(int(f)).alias("fold_index"), F.col(c).alias("_raw")) for c, f in columns.items()])
    long = df.select(key, F.explode(pairs).alias("_p")).select(key, "_p.fold_index", "_p._raw")
    return map_roles(long, roles, "_raw", "role").drop("_raw")


def same_membership(partitions: DataFrame, role: str, folds: int, key: str = "record_id") -> DataFrame:
    """Records that have the role in some folds but not in all of them: key, n."""
    counted = partitions.groupBy(key).agg(F.count_if(F.col("role") == role).alias("n"))
    return counted.filter((F.col("n") > 0) & (F.col("n") < folds))


def full_refit(train: DataFrame, test: DataFrame, key: str = "record_id") -> DataFrame:
    """One fold: all train rows fit, all test rows scored."""
    def part(df, role):
        return df.select(key, F.lit(0).alias("fold_index"), F.lit(role).alias("role"))

    return part(train, "fit").unionByName(part(test, "scored"))


def expand_variants(df: DataFrame, variants: int, name: str = "variant") -> DataFrame:
    """Each row as its original (variant 0) and the given number of variants."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(int(variants)))))

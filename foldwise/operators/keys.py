"""Operators on keyed tables: exact binding, coverage, overlap, comparison, fingerprints, ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import is_finite, to_column
from .checks import ensure_label_free, require_empty



def text_key(keys: Iterable[str]) -> list[Column]:
    return [F.col(k).cast("string").alias(k) for k in keys]


def bind_status(
    left: DataFrame,
    right: DataFrame,
    keys: Iterable[str],
    left_values: Iterable[str] = (),
    right_values: Iterable[str] = (),
) -> DataFrame:
    """Keys that are not exactly once on both sides: keys, n_left, n_right, status.

    One aggregation over the union of both key columns answers uniqueness on each side and equality of
    the key sets together, and combines repeated keys before the shuffle. Values that must be finite
    are checked in the same pass.
    """
    keys = list(keys)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def bad(columns):
        broken = F.lit(False)
        for c in columns:
            broken = broken | ~is_finite(c)
        return broken.cast("bigint").alias("_bad")

    sides = left.select(*text_key(keys), one.alias("_l"), zero.alias("_r"), bad(left_values)).unionByName(
        right.select(*text_key(keys), zero.alias("_l"), one.alias("_r"), bad(right_values))
    )
    counted = sides.groupBy(*keys).agg(
        F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"), F.sum("_bad").alias("_bad")
    )
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    status = (
        F.when(missing, F.lit("missing_key"))
        .when(F.col("n_right") == 0, F.lit("left_only"))
        .when(F.col("n_left") == 0, F.lit("right_only"))
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), F.lit("duplicate"))
        .when(F.col("_bad") > 0, F.lit("not_finite"))
    )
    return counted.withColumn("status", status).filter(F.col("status").isNotNull()).drop("_bad")


def bind_exact(
    predictions: DataFrame,
    labels: DataFrame,
    prediction_columns: Iterable[str],
    key: str = "record_id",
    target: str = "target",
    order: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Bind labels to predictions one to one; raises unless both key sets are equal and unique.

    ``order`` carries the caller's row order, to be restored with :func:`restore_order` at the sink.
    """
    columns = list(prediction_columns)
    ensure_label_free(predictions, {"label", "logS", "observed", "y", "target", target})
    kept = [order] if order else []
    left = predictions.select(*text_key([key]), *kept, *columns)
    right = labels.select(*text_key([key]), F.col(target))
    if check:
        broken = bind_status(left, right, [key], columns, [target])
        require_empty(broken, "predictions and labels must match one to one and be finite")
    return left.join(right, key).select(key, *kept, target, *columns)


def bind_coefficients(
    predictions: DataFrame,
    labels: DataFrame,
    prediction_columns: Iterable[str],
    fold: str = "deployment_fold",
    key: str = "record_id",
    target: str = "target",
    check: bool = True,
) -> DataFrame:
    """Bind coefficient labels to component predictions on (deployment fold, record), exactly."""
    columns, keys = list(prediction_columns), [fold, key]
    ensure_label_free(predictions, {"label", "logS", "observed", "y", "target", target})
    left = predictions.select(fold, *text_key([key]), *columns)
    right = labels.select(fold, *text_key([key]), F.col(target))
    if check:
        broken = bind_status(left, right, keys, columns, [target])
        require_empty(broken, "coefficient predictions and labels must match one to one and be finite")
    return left.join(right, keys).select(*keys, target, *columns)


def rows_in(base: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows of the base table whose key is in the id table."""
    return base.join(ids.select(key), key, "left_semi")


def missing_ids(required: DataFrame, table: DataFrame, key: str = "record_id") -> DataFrame:
    """Required keys that have no row in the table."""
    return required.select(key).join(table.select(key), key, "left_anti").distinct()


def rows_in_exact(base: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """:func:`rows_in`, refusing ids that the base table does not have."""
    require_empty(missing_ids(ids, base, key), "ids are absent from the base table")
    return rows_in(base, ids, key)


def coefficient_overlap(
    coefficient: DataFrame,
    scored: DataFrame,
    one_coefficient: bool = False,
    key: str = "record_id",
    fold: str = "fold_index",
    deployment: str = "deployment_fold",
) -> DataFrame:
    """Coefficient rows that the same deployed model also scores.

    With one coefficient for the whole evaluation a row scored in any fold counts.
    """
    if one_coefficient:
        return coefficient.join(scored.select(key), key, "left_semi")
    same_fold = scored.select(key, F.col(fold).alias(deployment))
    return coefficient.join(same_fold, [deployment, key], "left_semi")


def stage_overlaps(stages: DataFrame, stage: str = "stage", key: str = "record_id") -> DataFrame:
    """Number of shared records for each pair of stages that share any: stage_a, stage_b, n.

    Records are first reduced to their set of stages and equal sets are counted; pairs are made only
    from the few distinct sets, never from the rows.
    """
    sets = stages.groupBy(key).agg(F.array_sort(F.collect_set(stage)).alias("_stages"))
    counted = sets.filter(F.size("_stages") > 1).groupBy("_stages").agg(F.count(F.lit(1)).alias("_n"))
    pairs = counted.select(
        F.explode("_stages").alias("stage_a"), "_stages", "_n"
    ).select("stage_a", F.explode("_stages").alias("stage_b"), "_n")
    return pairs.filter("stage_a < stage_b").groupBy("stage_a", "stage_b").agg(F.sum("_n").alias("n"))


def content_overlap(train: DataFrame, test: DataFrame, content) -> DataFrame:
    """Content digests that repeat inside a side or occur on both: digest, n_train, n_test, problem.

    Only 64-character digests are shuffled, combined before the shuffle.
    """
    digest = F.sha2(to_column(content), 256).alias("digest")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = train.select(digest, one.alias("a"), zero.alias("b")).unionByName(
        test.select(digest, zero.alias("a"), one.alias("b"))
    )
    counted = sides.groupBy("digest").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))
    problem = (
        F.when((F.col("n_train") > 0) & (F.col("n_test") > 0), F.lit("overlap"))
        .when(F.col("n_train") > 1, F.lit("duplicate_train"))
        .when(F.col("n_test") > 1, F.lit("duplicate_test"))
    )
    return counted.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def override_labels(
    base: DataFrame, other: DataFrame, tolerance: float, key: str = "record_id", target: str = "target", complete: bool = False
) -> DataFrame:
    """Take the label of a second source where it has one; ``delta`` is the absolute change.

    Rows whose change is larger than the tolerance (or not finite) are marked ``rejected``. The second source
    may name a record once; with ``complete`` it has to name every record of the first, and no other.
    """
    repeated = other.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    require_empty(repeated, "the second label source repeats records")
    if complete:
        require_empty(population_diff(base, other, [key], [key]), "the two label sources do not hold the same records")
    second = other.select(key, F.col(target).alias("_other"))
    joined = base.join(second, key, "left")
    delta = F.abs(F.col(target) - F.col("_other"))
    within = F.coalesce((delta <= F.lit(float(tolerance))) & ~F.isnan(delta), F.lit(False))
    return (
        joined.withColumn("delta", delta)
        .withColumn("rejected", F.col("_other").isNotNull() & ~within)
        .withColumn(target, F.coalesce("_other", target))
        .drop("_other")
    )


def population_diff(
    left: DataFrame, right: DataFrame, key: Iterable[str], columns: Iterable[str], tolerance: float = 0.0
) -> DataFrame:
    """Keys that only one table has, and keys whose values differ by more than the tolerance."""
    key, columns = list(key), list(columns)
    a = left.select(*key, F.struct(*columns).alias("_a"))
    b = right.select(*key, F.struct(*columns).alias("_b"))
    same = F.lit(True)
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        equal = x.eqNullSafe(y)
        if left.schema[c].dataType.typeName() in ("double", "float"):
            equal = equal | F.coalesce(F.abs(x - y) <= F.lit(float(tolerance)), F.lit(False))
        same = same & equal
    status = (
        F.when(F.col("_b").isNull(), F.lit("left_only"))
        .when(F.col("_a").isNull(), F.lit("right_only"))
        .when(~same, F.lit("different"))
    )
    joined = a.join(b, key, "full_outer").withColumn("status", status)
    return joined.filter(F.col("status").isNotNull()).select(*key, "status")


def fingerprint(df: DataFrame, by: Iterable[str] = (), line="record_id", name: str = "digest", repeats: bool = True) -> DataFrame:
    """Order-free SHA-256 fingerprint of the lines of each group, and their number.

    Repeated lines are first reduced to one ``digest:count`` entry. Entries are hashed in a tree: over
    the sorted entries of each bucket of six leading hexadecimal digits, over the sorted buckets of
    three digits, and over those. Equal multisets of lines give equal fingerprints on any
    partitioning; no group ever holds more than one bucket or 4,096 digests.

    Lines travel as 32 bytes, once to be counted and once to their three digits, where both lower levels of the
    tree are made. Without ``repeats`` (lines that hardly ever repeat in a group, such as keys) they are counted there.
    """
    by = list(by)
    rows = df.select(*by, F.unhex(F.sha2(to_column(line).cast("string"), 256)).alias("_d"))
    if repeats:
        rows = rows.groupBy(*by, "_d").agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.withColumn("_top", F.substring(F.lower(F.hex("_d")), 1, 3)).repartition(*by, "_top")
    if not repeats:
        placed = placed.groupBy(*by, "_top", "_d").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.lower(F.hex("_d"))
    level = placed.select(*by, "_top", F.substring(digest, 1, 6).alias("_bucket"), "_n", F.concat_ws(":", digest, "_n").alias("_entry"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("_entry")), "\n"), 256)
    for shorter, kept in (("_bucket", ["_top", "_bucket"]), ("_top", ["_top"])):
        level = level.groupBy(*by, *kept).agg(F.sum("_n").alias("_n"), joined.alias("_digest"))
        level = level.select(*by, *kept, "_n", F.concat_ws(":", shorter, "_digest").alias("_entry"))
    return level.groupBy(*by).agg(F.sum("_n").alias("n"), joined.alias(name))


def top_k_per_key(
    df: DataFrame, keys: Iterable[str], score: Iterable[Column | str], k: int, name: str = "rank"
) -> DataFrame:
    """The first k rows of each key by score, with their rank; end ``score`` with a tie-breaker.

    Spark keeps only k rows per key in each map task before the shuffle, so a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*score)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= int(k))


def first_seen(df: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """One row per key: the one with the lowest ``order``, which must be unique.

    The key is shuffled as a digest together with the order only; the rows are fetched by a semi join,
    so long keys (whole texts) do not travel through the aggregation.
    """
    parts = [F.coalesce(F.sha2(F.col(k).cast("string"), 256), F.lit("-")) for k in keys]
    winners = df.groupBy(F.concat_ws("|", *parts).alias("_k")).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def restore_order(df: DataFrame, order: str) -> DataFrame:
    """Sort by the carried row order; use only at the sink."""
    return df.orderBy(order)


def union_distinct(tables: Iterable[DataFrame], key: Iterable[str], order: str = "_source") -> DataFrame:
    """Union of tables, one row per key, taken from the earliest table that has it.

    Rows of one key in one table must agree; the least is kept, so the choice does not depend on timing.
    """
    key = list(key)
    tagged = [t.withColumn(order, F.lit(i)) for i, t in enumerate(tables)]
    if not tagged:
        raise ContractViolation("no tables to unite")
    united = tagged[0]
    for t in tagged[1:]:
        united = united.unionByName(t)
    rest = [c for c in united.columns if c not in key and c != order]
    first = united.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def id_union(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def id_minus(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    return a.select(key).subtract(b.select(key))


def id_intersect(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def row_ids(numbered: DataFrame, prefix: str, width: int = 5, position: str = "row_number", name: str = "record_id") -> DataFrame:
    """Record id made of a prefix and the zero-padded source row number."""
    return numbered.withColumn(name, F.format_string(f"%s%0{int(width)}d", F.lit(prefix), F.col(position)))

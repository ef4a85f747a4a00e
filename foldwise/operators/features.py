"""Feature preparation: statistics are fitted on fit rows only and applied to every row.

A fit reads a few numbers per column to the driver (they are the model); applying them is a narrow
projection with literals, so prepared tables need no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import as_double, clip, is_missing
from ..functions.vectors import INV_SQRT2, as_vector, concat_blocks, fit_length, l2_normalise, vector_is_finite
from ..session import collect_small
from ..session import kept as held_table
from .aggregates import mean_vector
from .checks import finite_violations, require_empty
from .quantiles import exact_quantiles

PROFILE_COLUMNS = 64
TILE_COLUMNS = 64
FAN_IN = 256


@dataclass(frozen=True)
class FilterConfig:
    variance_threshold: float = 1e-12
    ddof: int = 0
    correlation_threshold: float | None = None
    comparison: str | None = None

    def __post_init__(self):
        if self.variance_threshold < 0 or self.ddof not in (0, 1):
            raise ContractViolation("variance threshold must not be negative and ddof must be 0 or 1")
        if self.correlation_threshold is None:
            if self.comparison is not None:
                raise ContractViolation("a comparison needs a correlation threshold")
        elif not 0 <= self.correlation_threshold <= 1 or self.comparison not in ("gt", "ge"):
            raise ContractViolation("correlation threshold must be in [0, 1] with comparison gt or ge")


@dataclass(frozen=True)
class FeatureFilter:
    """Decision of the filter: (column, status) in input order."""

    decisions: tuple[tuple[str, str], ...]
    config: FilterConfig = field(default_factory=FilterConfig)

    def with_status(self, status: str) -> list[str]:
        return [c for c, s in self.decisions if s == status]

    @property
    def retained(self) -> list[str]:
        return self.with_status("retained")

    def report(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, s) for i, (c, s) in enumerate(self.decisions)]
        return spark.createDataFrame(rows, "position int, column string, status string")


def _variance(value: Column, ddof: int) -> Column:
    return F.var_samp(value) if ddof else F.var_pop(value)


def profile_columns(df: DataFrame, columns: Iterable[str], ddof: int = 0) -> DataFrame:
    """Per column: rows, missing, constant, variance; one pass per 64 columns, each reading only those."""
    columns = list(columns)
    parts = []
    for start in range(0, len(columns), PROFILE_COLUMNS):
        chunk = columns[start : start + PROFILE_COLUMNS]
        structs = []
        for i, c in enumerate(chunk):
            value = F.when(~is_missing(c), as_double(c))
            missing = F.count_if(is_missing(c))
            structs.append(
                F.struct(
                    F.lit(start + i).alias("position"),
                    F.lit(c).alias("column"),
                    F.count(F.lit(1)).alias("rows"),
                    missing.alias("missing"),
                    (F.coalesce(F.min(value) == F.max(value), F.lit(True)) & ((missing == 0) | (missing == F.count(F.lit(1))))).alias("constant"),
                    _variance(value, ddof).alias("variance"),
                )
            )
        parts.append(df.agg(F.array(*structs).alias("_p")).select(F.inline("_p")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def corr_pairs(df: DataFrame, columns: list[str], tile: int = TILE_COLUMNS, fan_in: int = FAN_IN) -> DataFrame:
    """Absolute Pearson correlation of each pair (earlier, later) in input order, over the rows that have both values.

    Values are centred at the column's mean. Columns are cut into tiles; a task multiplies its batches into the sums of
    each pair of tiles and hands on one block of numbers per pair of tiles. Blocks are added up in a tree, ``fan_in``
    tasks at a time, and only the last step makes a row per pair of columns. The rule is the same at any width.
    """
    size = len(columns)
    schema = "earlier string, later string, i int, j int, correlation double"
    if size < 2:
        return df.sparkSession.createDataFrame([], schema)
    present = [F.when(~is_missing(c), as_double(c)) for c in columns]
    means = [mean or 0.0 for mean in df.agg(*[F.avg(value) for value in present]).first()]
    centred = df.select(*[(value - F.lit(mean)).alias(f"c{k}") for k, (value, mean) in enumerate(zip(present, means))])
    cuts = [slice(at, min(at + tile, size)) for at in range(0, size, tile)]
    pairs = [(a, b) for a in range(len(cuts)) for b in range(a, len(cuts))]
    block_schema = "a int, b int, slot int, sums binary"

    def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            values = frame.to_numpy(dtype=float)
            has = (~np.isnan(values)).astype(float)
            values = np.nan_to_num(values)
            squares = values**2
            sides = ((has, has), (values, has), (has, values), (squares, has), (has, squares), (values, values))
            for a, b in pairs:
                made = np.stack([x[:, cuts[a]].T @ y[:, cuts[b]] for x, y in sides])
                sums[a, b] = sums[a, b] + made if (a, b) in sums else made
        slot = TaskContext.get().partitionId() // fan_in
        for (a, b), block in sums.items():
            yield pd.DataFrame({"a": [a], "b": [b], "slot": [slot], "sums": [block.tobytes()]})

    def total(frame: pd.DataFrame) -> np.ndarray:
        a, b = cuts[frame["a"].iloc[0]], cuts[frame["b"].iloc[0]]
        added = np.zeros((6, a.stop - a.start, b.stop - b.start))
        for block in frame["sums"]:
            added += np.frombuffer(block).reshape(added.shape)
        return added

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.head(1).assign(slot=0, sums=[total(frame).tobytes()])

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        n, x, y, xx, yy, xy = total(frame)
        a, b = cuts[frame["a"].iloc[0]], cuts[frame["b"].iloc[0]]
        i, j = np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij")
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(np.maximum(xx - x * x / n, 0.0) * np.maximum(yy - y * y / n, 0.0))
            found = np.where(spread > 0, np.abs(xy - x * y / n) / spread, np.nan)
        used = (i < j) & (n > 0)
        return pd.DataFrame({"i": i[used], "j": j[used], "found": found[used], "flat": ~(spread[used] > 0)})

    blocks = centred.mapInPandas(partial_sums, block_schema).groupBy("a", "b", "slot").applyInPandas(merged, block_schema)
    rows = blocks.groupBy("a", "b").applyInPandas(finished, "i int, j int, found double, flat boolean")
    names = F.array(*[F.lit(c) for c in columns])
    return rows.select(
        F.get(names, F.col("i")).alias("earlier"),
        F.get(names, F.col("j")).alias("later"),
        "i",
        "j",
        F.when(~F.col("flat"), F.col("found")).alias("correlation"),
    )


def fit_feature_filter(df: DataFrame, columns: Iterable[str], config: FilterConfig = FilterConfig()) -> FeatureFilter:
    """Four ordered stages on fit rows: any missing, constant, low variance, correlated.

    A column is correlated when any earlier survivor of the first three stages passes the threshold,
    even one that is itself dropped for correlation.
    """
    columns = list(columns)
    if not columns or len(set(columns)) != len(columns):
        raise ContractViolation(f"name each feature column once: {sorted(c for c in set(columns) if columns.count(c) > 1)}")
    with held_table(df.select(*columns)) as held:
        decisions = _decide(held, columns, config)
    if all(s != "retained" for _, s in decisions):
        raise ContractViolation("the filter removed every column")
    return FeatureFilter(decisions, config)


def _decide(df: DataFrame, columns: list[str], config: FilterConfig) -> tuple[tuple[str, str], ...]:
    status: dict[str, str] = {}
    for row in collect_small(profile_columns(df, columns, config.ddof), max(10_000, len(columns)), "column profile"):
        if row["missing"] > 0:
            status[row["column"]] = "missing"
        elif row["constant"]:
            status[row["column"]] = "constant"
        elif row["variance"] is None or not row["variance"] > config.variance_threshold:
            status[row["column"]] = "low_variance"
    survivors = [c for c in columns if c not in status]
    if config.correlation_threshold is not None and len(survivors) > 1:
        limit = config.correlation_threshold
        over = F.col("correlation") > limit if config.comparison == "gt" else F.col("correlation") >= limit
        hits = corr_pairs(df, survivors).filter(over & ~F.isnan("correlation")).select("later").distinct()
        for row in collect_small(hits, max(10_000, len(columns)), "correlated columns"):
            status[row["later"]] = "correlated"
    return tuple((c, status.get(c, "retained")) for c in columns)


def apply_feature_filter(df: DataFrame, fitted: FeatureFilter, kept: Iterable[str] = ("record_id",), check: bool = True) -> DataFrame:
    """Keep the retained columns as doubles; a missing column or a value that is not finite is an error."""
    absent = [c for c in fitted.retained if c not in df.columns]
    if absent:
        raise ContractViolation(f"columns that the filter kept are absent: {absent[:10]}")
    kept = list(kept)
    if check:
        require_empty(finite_violations(df, kept, fitted.retained), "retained features must be finite")
    return df.select(*kept, *[as_double(c).alias(c) for c in fitted.retained])


def quantile_limits(df: DataFrame, columns: list[str], quantile: float) -> dict[str, tuple[float, float]]:
    """Exact lower and upper quantile of each column."""
    if not 0.0 <= quantile < 0.5:
        raise ContractViolation("the winsor quantile must be in [0, 0.5)")
    found = exact_quantiles(df, columns, [quantile, 1.0 - quantile])
    return {c: (values[0], values[1]) for c, values in found.items()}


@dataclass(frozen=True)
class Scaler:
    """Optional limits, then (x - mean) / scale, per column."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    limits: tuple[tuple[float, float], ...] | None = None

    def expression(self, index: int) -> Column:
        value = as_double(self.columns[index])
        if self.limits:
            value = clip(value, *self.limits[index])
        return (value - F.lit(self.means[index])) / F.lit(self.scales[index])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expression(i) for i, c in enumerate(self.columns)})

    def as_array(self) -> Column:
        return F.array(*[self.expression(i) for i in range(len(self.columns))])


def fit_scaler(
    df: DataFrame, columns: Iterable[str], ddof: int = 0, floor: float = 0.0, limits: dict | None = None
) -> Scaler:
    """Mean and standard deviation of (clipped) columns; a zero deviation, or one under the floor, becomes 1."""
    columns = list(columns)
    means, scales = [], []
    for start in range(0, len(columns), PROFILE_COLUMNS):
        chunk = columns[start : start + PROFILE_COLUMNS]
        terms = []
        for c in chunk:
            value = clip(as_double(c), *limits[c]) if limits else as_double(c)
            value = F.when(~is_missing(value), value)
            terms += [F.avg(value), F.stddev_samp(value) if ddof else F.stddev_pop(value)]
        row = df.agg(*[t.alias(f"s{i}") for i, t in enumerate(terms)]).first()
        for i, c in enumerate(chunk):
            mean, scale = row[2 * i], row[2 * i + 1]
            if mean is None or scale is None or math.isnan(scale):
                raise ContractViolation(f"column {c} has too few values to scale")
            means.append(float(mean))
            scales.append(1.0 if scale == 0.0 or scale < floor else float(scale))
    bounds = tuple(limits[c] for c in columns) if limits else None
    return Scaler(tuple(columns), tuple(means), tuple(scales), bounds)


def fit_block_scaler(
    fit_rows: DataFrame, blocks: Iterable[Iterable[str]], quantile: float | None = None, **options
) -> list[Scaler]:
    """Winsorise (optional) and standardise each block of columns from its fit rows; population deviation."""
    blocks = [list(block) for block in blocks]
    every = [c for block in blocks for c in block]
    with held_table(fit_rows.select(*every)) as held:
        limits = quantile_limits(held, every, quantile, **options) if quantile is not None else None
        whole = fit_scaler(held, every, ddof=0, limits=limits)
    scalers, start = [], 0
    for block in blocks:
        part = slice(start, start + len(block))
        bounds = whole.limits[part] if whole.limits else None
        scalers.append(Scaler(whole.columns[part], whole.means[part], whole.scales[part], bounds))
        start += len(block)
    return scalers


def apply_block_scaler(df: DataFrame, scalers: Iterable[Scaler], kept: Iterable[str] = ("record_id",), name: str = "features") -> DataFrame:
    """Scaled blocks side by side in one array column."""
    return df.select(*kept, concat_blocks([s.as_array() for s in scalers]).alias(name))


def fit_clip_zscore(fit_rows: DataFrame, columns: list[str], quantile: float = 0.001, floor: float = 1e-8, **options) -> Scaler:
    """Limits from fit rows, then mean and population deviation of the clipped fit rows."""
    with held_table(fit_rows.select(*columns)) as held:
        limits = quantile_limits(held, columns, quantile, **options)
        return fit_scaler(held, columns, ddof=0, floor=floor, limits=limits)


def fit_zscore(fit_rows: DataFrame, columns: Iterable[str], ddof: int = 1) -> Scaler:
    return fit_scaler(fit_rows, columns, ddof=ddof)


def fallback_vector(df: DataFrame, fit: Column, vector: str = "embedding") -> list[float]:
    """Mean of the usable fit vectors, as a list."""
    rows = collect_small(mean_vector(df, vector, fit), 1_000_000, "mean vector")
    if not rows:
        raise ContractViolation("no usable fit vector for the fallback")
    return [row["value"] for row in sorted(rows)]


def fill_failed(
    df: DataFrame, mean: list[float], failed: str = "failed", vector: str = "embedding", key: str = "record_id", check: bool = True
) -> DataFrame:
    """Replace the vectors of failed rows by the fallback; a bad vector not marked as failed is an error."""
    marked = F.coalesce(F.col(failed).cast("boolean"), F.lit(False))
    if check:
        require_empty(df.filter(~marked & ~vector_is_finite(vector)).select(key), "bad vectors must be marked as failed")
    fallback = F.array(*[F.lit(float(x)) for x in mean])
    return df.withColumn(failed, marked).withColumn(vector, F.when(marked, fallback).otherwise(as_vector(vector)))


def vector_columns(df: DataFrame, vector: str, length: int, prefix: str = "v") -> tuple[DataFrame, list[str]]:
    """A vector column as separate columns, for operators that fit per column."""
    names = [f"{prefix}{i}" for i in range(length)]
    return df.withColumns({n: F.element_at(as_vector(vector), i + 1) for i, n in enumerate(names)}), names


def fit_pca_model(fit_rows: DataFrame, columns: list[str], dimension: int = 384):
    """Scaler and ML principal components of one block: at most ``dimension``, columns, rows - 1."""
    scaler = fit_scaler(fit_rows, columns, ddof=0)
    components = min(int(dimension), len(columns), fit_rows.count() - 1)
    if components < 1:
        raise ContractViolation("principal components need at least two fit rows")
    scaled = fit_rows.select(array_to_vector(scaler.as_array()).alias("scaled"))
    return scaler, PCA(k=components, inputCol="scaled", outputCol="projected").fit(scaled)


def apply_pca_blocks(df: DataFrame, models: Iterable, dimension: int = 384, kept: Iterable[str] = ("record_id",), name: str = "features") -> DataFrame:
    """Unit-length projections of each block, padded, side by side, divided by the root of two.

    The blocks are already centred by their scalers, which the ML projection expects.
    """
    current, outputs = df, []
    for i, (scaler, model) in enumerate(models):
        source, target = f"_scaled{i}", f"_projected{i}"
        current = current.withColumn(source, array_to_vector(scaler.as_array()))
        current = model.copy().setInputCol(source).setOutputCol(target).transform(current)
        outputs.append(fit_length(l2_normalise(vector_to_array(target)), dimension))
    return current.select(*kept, concat_blocks(outputs, INV_SQRT2).alias(name))


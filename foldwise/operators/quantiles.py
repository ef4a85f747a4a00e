"""Exact quantiles (linear interpolation) of any number of columns, by one plan at any table size.

1. One aggregation makes a bounded, mergeable sketch of every column and reads a bracket for each quantile from it.
2. One aggregation counts, for all brackets at once, the rows below and inside.
3. One pass takes out the values inside the brackets, a few rows in ten thousand, counted per distinct value.

The wanted values are then found among these. Where a bracket still has more than ``READ_VALUES`` distinct values, it is
narrowed by a sketch of its own rows, which are counted exactly again, until it can be read. So nothing depends on how
the values are distributed, and the driver reads a bounded number of them for each quantile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..functions.numbers import is_missing
from ..session import collect_small, kept

COLUMNS_PER_PASS = 128  # sketches held side by side in a task; a pass reads only its own columns
SKETCH_ACCURACY = 10_000
READ_VALUES = 2_000
CUTS = 64


def _number(name: str):
    return F.when(~is_missing(name), F.col(name).cast("double"))


def _chunks(items: list, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


@dataclass
class _Target:
    """A quantile: its two neighbouring ranks (from 0), and a bracket of values that holds both."""

    column: str
    first: int
    last: int
    share: float
    low: float = 0.0
    high: float = 0.0
    below: int = 0  # rows with a value less than ``low``

    def inside(self):
        number = _number(self.column)
        return (number >= F.lit(self.low)) & (number <= F.lit(self.high))


def _sketch(df: DataFrame, columns: list[str], probabilities: list[float], slack: float, accuracy: int) -> tuple[dict, list[_Target]]:
    """Counts of the columns, and a target with its bracket for each column and probability."""
    edges = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-slack, slack)]
    asked = []
    for i, c in enumerate(columns):
        asked += [F.count(_number(c)).alias(f"c{i}"), F.percentile_approx(_number(c), F.array(*map(F.lit, edges)), accuracy).alias(f"e{i}")]
    row = df.agg(*asked).first()
    counts, targets = {}, []
    for i, c in enumerate(columns):
        counts[c] = row[f"c{i}"]
        for j, p in enumerate(probabilities if counts[c] else []):
            position = (counts[c] - 1) * p
            low, high = row[f"e{i}"][2 * j : 2 * j + 2]
            targets.append(_Target(c, math.floor(position), math.ceil(position), position - math.floor(position), low, high))
    return counts, targets


def _missed(df: DataFrame, targets: list[_Target]) -> list[_Target]:
    """Counts the rows below each bracket; the targets whose ranks are outside of it."""
    counting = []
    for i, t in enumerate(targets):
        counting += [F.count_if(_number(t.column) < F.lit(t.low)).alias(f"b{i}"), F.count_if(t.inside()).alias(f"n{i}")]
    row = df.agg(*counting).first()
    missed = []
    for i, t in enumerate(targets):
        t.below = row[f"b{i}"]
        if not (t.below <= t.first and t.last < t.below + row[f"n{i}"]):
            missed.append(t)
    return missed


def _bracket_values(df: DataFrame, targets: list[_Target]) -> DataFrame:
    """(target, value, rows) of the distinct values inside each bracket."""
    hits = [F.when(t.inside(), F.struct(F.lit(i).alias("target"), _number(t.column).alias("value"))) for i, t in enumerate(targets)]
    inside = df.select(F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return inside.groupBy("hit.target", "hit.value").agg(F.count(F.lit(1)).alias("rows"))


def _narrowed(values: DataFrame, targets: list[_Target], which: list[int]) -> DataFrame:
    """The rows of the targets ``which`` between two cuts around their ranks; a cut is a value, so brackets shrink."""
    shares = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    cuts = values.where(F.col("target").isin(which)).groupBy("target").agg(F.percentile_approx("value", shares, SKETCH_ACCURACY).alias("cuts"))
    edges = {row["target"]: sorted(set(row["cuts"])) for row in cuts.collect()}
    limits = F.lit(None).cast("array<double>")
    for t, e in edges.items():
        limits = F.when(F.col("target") == t, F.array(*map(F.lit, e))).otherwise(limits)
    # an interval is [cut, next cut), the last one holds its upper end
    interval = F.size(F.filter(F.slice(limits, 2, CUTS), lambda cut: cut <= F.col("value")))
    counted = values.where(F.col("target").isin(which)).groupBy("target", interval.alias("interval")).agg(F.sum("rows").alias("rows"))
    rows = {}
    for row in counted.collect():
        rows.setdefault(row["target"], {})[row["interval"]] = row["rows"]
    keep = F.lit(False)
    for t, by_interval in rows.items():
        target, position, low, high = targets[t], targets[t].below, None, None
        for interval in sorted(by_interval):
            after = position + by_interval[interval]
            if low is None and target.first < after:
                low, target.below = edges[t][interval], position
            if target.last < after:
                high = edges[t][interval + 1] if interval + 1 < len(edges[t]) else None
                break
            position = after
        keep = keep | ((F.col("target") == t) & (F.col("value") >= F.lit(low)) & ((F.col("value") < F.lit(high)) if high is not None else F.lit(True)))
    return values.where(keep)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """Quantiles of each column, in the order of ``probabilities``; missing values are ignored."""
    counts: dict[str, int] = {}
    found: dict[str, list[float]] = {}
    for chunk in _chunks(columns, COLUMNS_PER_PASS):
        counted, targets = _sketch(df, chunk, probabilities, 2.0 / SKETCH_ACCURACY, SKETCH_ACCURACY)
        counts.update(counted)
        empty = [c for c in chunk if not counted[c]]
        if empty:
            raise ContractViolation(f"no usable values for quantiles in columns {empty}")
        slack, missed = 2.0 / SKETCH_ACCURACY, _missed(df, targets)
        while missed:
            slack, again = 4 * slack, {t.column for t in missed}
            wider = _sketch(df, sorted(again), probabilities, slack, SKETCH_ACCURACY)[1]
            missed = _missed(df, wider)
            targets = [t for t in targets if t.column not in again] + wider
        order = {c: [t for t in targets if t.column == c] for c in chunk}
        with kept(_bracket_values(df, targets)) as values:
            numbers = _read(values, targets)
        for c in chunk:
            found[c] = [numbers[id(t)] for t in order[c]]
    return found


def _read(values: DataFrame, targets: list[_Target]) -> dict[int, float]:
    """The quantile of each target from the (target, value, rows) inside its bracket."""
    found: dict[int, float] = {}
    while True:
        sizes = {row["target"]: row["count"] for row in values.groupBy("target").count().collect()}
        ready = [t for t, size in sizes.items() if size <= READ_VALUES]
        if ready:
            rows: dict[int, list] = {}
            for row in collect_small(values.where(F.col("target").isin(ready)), READ_VALUES * len(ready), "quantile bracket"):
                rows.setdefault(row["target"], []).append((row["value"], row["rows"]))
            for t, inside in rows.items():
                found[id(targets[t])] = _between(targets[t], sorted(inside))
        rest = [t for t in sizes if t not in ready]
        if not rest:
            return found
        values = _narrowed(values, targets, rest)


def _between(target: _Target, inside: list[tuple[float, int]]) -> float:
    position, ends = target.below, []
    for value, rows in inside:
        position += rows
        while len(ends) < 2 and (target.first, target.last)[len(ends)] < position:
            ends.append(float(value))
    low, high = ends
    return low if low == high else low + (high - low) * target.share

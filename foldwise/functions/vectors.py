"""Array expressions for dense vectors held as ``array<double>`` or ``array<float>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_column

NORM_FLOOR = 1e-12


def as_vector(value) -> Column:
    return to_column(value).cast("array<double>")


def vector_is_finite(value) -> Column:
    vector = as_vector(value)
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def l2_norm(value) -> Column:
    return F.sqrt(F.aggregate(as_vector(value), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(value, floor: float = NORM_FLOOR) -> Column:
    """Unit vector; a vector with a norm under the floor is left as it is."""
    norm = l2_norm(value)
    divisor = F.when(norm < F.lit(floor), F.lit(1.0)).otherwise(norm)
    return F.transform(as_vector(value), lambda x: x / divisor)


def fit_length(value, length: int) -> Column:
    """Cut to the length, or fill up with zeros."""
    return F.slice(F.concat(as_vector(value), F.array_repeat(F.lit(0.0), length)), 1, length)


def concat_blocks(blocks, scale: float = 1.0) -> Column:
    """Blocks side by side, each value times the scale."""
    joined = F.concat(*[as_vector(block) for block in blocks])
    return joined if scale == 1.0 else F.transform(joined, lambda x: x * F.lit(float(scale)))


def distance(left, right) -> Column:
    squares = F.zip_with(as_vector(left), as_vector(right), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def radial_basis(value, start: float = 0.0, stop: float = 5.0, count: int = 16, denominator: float = 0.25) -> Column:
    """exp(-(d - c)^2 / denominator) for evenly spaced centres c."""
    step = (stop - start) / (count - 1)
    d = to_column(value)
    terms = [F.exp(-F.pow(d - F.lit(start + step * i), F.lit(2.0)) / F.lit(denominator)) for i in range(count)]
    return F.array(*terms)


def affine(value, shift, scale) -> Column:
    """(x - shift) / scale for each position; shift and scale are fitted lists."""
    vector = as_vector(value)
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(shift, scale)])
    return F.zip_with(vector, pairs, lambda x, p: (x - p["m"]) / p["s"])


INV_SQRT2 = 1.0 / math.sqrt(2.0)

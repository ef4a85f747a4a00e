"""Seeded, engine-independent pseudo-random numbers.

Everything random is a function of a text such as ``seed:record_id``, so the same rows get the same
numbers on any partitioning, after any lost executor, and in any other SQL engine with MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967296.0


def as_text(key) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def seeded_text(seed, key) -> Column:
    """``seed:key`` as text; ``seed`` may be a number, a text or a column."""
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat(head, F.lit(":"), as_text(key))


def order_hash(seed, key) -> Column:
    """The hexadecimal text that fixes the seeded order of the rows."""
    return F.md5(seeded_text(seed, key))


def hash32(text: Column) -> Column:
    """First 32 bits of the MD5 of a text, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(text: Column) -> Column:
    """Uniform number in [0, 1) from a text."""
    return hash32(text) / F.lit(UINT32)


def hash60(text: Column) -> Column:
    """First 60 bits of the MD5 of a text, as a non-negative bigint; modulo n it is fair to any number of rows."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

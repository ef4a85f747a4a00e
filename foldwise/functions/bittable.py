"""A table of bits that lets the wanted digests through, and few others: a filter before rows are made or shuffled.

It is a scalar subquery, computed once and read in every task, and bounded: with more digests than it has room for it lets
more through, never less. What passes still has to be joined with the digests themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_DIGEST = 32
MAX_BITS = 1 << 27  # 16 MB in each task


def table_bits(digests: int, most: int = MAX_BITS) -> int:
    """A power of two with room for about so many digests."""
    return min(most, 1 << max(6, (BITS_PER_DIGEST * max(1, digests) - 1).bit_length()))


def bit_table(digests: DataFrame, bits: int) -> Column:
    """The numbers of a single column of 64-bit digests, modulo ``bits``, as set bits of an array of longs."""
    place = digests.toDF("digest").where("digest is not null").select(F.pmod("digest", F.lit(bits)).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")
    every = digests.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    words = place.select(F.floor(F.col("place") / 64).alias("word"), bit).unionAll(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()


def passes(digest: Column, table: Column, bits: int) -> Column:
    """Whether the bit of a digest is set."""
    place = F.pmod(digest, F.lit(bits))
    word = F.get(table, F.floor(place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

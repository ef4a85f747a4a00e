"""Exact row numbers without sending a whole group, or the whole table, to one task.

A plain ``row_number()`` over a fold, a bin or nothing at all sorts that group in a single task. Here
the seeded hash that fixes the order is also used to spread it: its leading hexadecimal digits are a
bucket, buckets follow the same order as the hashes, so

    rank = rows in earlier buckets + rank inside the bucket

The bucket is a property of the row, so the result is the same on any partitioning and after any
recomputation, and no group is ever larger than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

MAX_DIGITS = 4


def bucket_digits(df: DataFrame) -> int:
    """Enough hexadecimal digits for about four buckets per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = 1
    while 16**digits < 4 * partitions and digits < MAX_DIGITS:
        digits += 1
    return digits


def hashed_rank(
    df: DataFrame,
    order: Column,
    key: str,
    by: tuple[str, ...] = (),
    leading: tuple[str, ...] = (),
    name: str = "rank",
    total: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row in the order (leading, order, key) inside each ``by`` group.

    ``order`` must be a hexadecimal hash such as :func:`order_hash`; ``key`` breaks ties. ``leading``
    are low-cardinality columns that sort before the hash (a bin, for example). ``total`` names an
    optional column with the size of the group. A row with a null group column keeps a null rank.
    """
    width = digits or bucket_digits(df)
    by, leading = list(by), list(leading)
    cells = by + leading + ["_bucket"]
    keyed = df.withColumn("_hash", order).withColumn("_bucket", F.substring("_hash", 1, width))
    counts = keyed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(*leading, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *cells,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*cells).orderBy("_hash", key))
    ranked = keyed.withColumn("_local", local).join(offsets, cells, "left")
    ranked = ranked.withColumn(name, F.col("_before") + F.col("_local"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_hash", "_bucket", "_before", "_total", "_local")


def ordinal(df: DataFrame, order_columns: list, name: str = "ord", partitions: int | None = None) -> DataFrame:
    """0-based position in the total order of any sortable columns, which must identify a row: equal
    values cannot be divided between tasks.

    Range partitioning samples its input, so the partition of a row is written down with a reliable
    checkpoint before it is counted and used; a recomputed task then cannot see other boundaries.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable_checkpoint(
        df.repartitionByRange(count, *order_columns).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order_columns)) - 1
    return (
        placed.withColumn("_local", local)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_part", "_before", "_local")
    )


def source_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    """0-based row number in the source files, in file-path order, with no sort of the rows.

    Needs a Parquet scan, whose metadata column holds the position of a row inside its file.
    """
    located = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = located.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return located.join(offsets, "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")

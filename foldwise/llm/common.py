"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_ROWS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def id_remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def packed(df: DataFrame, keep: list[str]) -> Column:
    """The columns to carry along as one struct, so that no name can clash with a computed one."""
    return F.struct(*[df[f"`{name}`"] for name in keep]).alias("row")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a task holds the Python objects of one part at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def annotate(
    df: DataFrame,
    keep: list[str],
    inputs: dict[str, Column],
    start: Callable[[], Callable[[pa.RecordBatch], dict]],
    fields: list[T.StructField],
) -> DataFrame:
    """One pass over the rows in small Arrow batches, without a shuffle: a struct ``row`` with the kept columns, and the fields.

    ``start`` is called once in each task and gives the function that turns a batch into one list per field.
    """
    rows = df.select(packed(df, keep), *[column.alias(name) for name, column in inputs.items()])
    kinds = [to_arrow_type(field.dataType) for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = start()
        for batch in small_batches(batches):
            made = process(batch)
            columns = [pa.array(made[field.name], kind) for field, kind in zip(fields, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *columns], names=["row", *[field.name for field in fields]]
            )

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *fields]))

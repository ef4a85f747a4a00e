"""Reads that state what they expect: exact header, types, row count, required ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractViolation
from ..operators.checks import require_empty
from ..operators.keys import missing_ids, rows_in


def read_contract(
    spark: SparkSession, path: str, schema: T.StructType, rows: int | None = None, file_format: str = "csv"
) -> DataFrame:
    """Read a table whose columns, in order, and types are given; optionally its row count.

    CSV fields that do not fit their type fail the read at once, and so does any other header in any file of a
    folder; a byte order mark is tolerated. For Parquet the file schema must equal the contract, and only the columns used
    later are read.
    """
    if file_format == "csv":
        require_headers(spark, path, schema.fieldNames())
        df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
        # every contracted field is parsed once, also those that no later step reads
        parsed = df.select(F.struct(*schema.fieldNames()).alias("row")).agg(F.count("row").alias("rows"), F.bit_xor(F.xxhash64("row")))
        found = parsed.first()["rows"]
        if rows is not None and found != rows:
            raise ContractViolation(f"{path} has {found} rows instead of {rows}")
        return df
    elif file_format == "parquet":
        df = spark.read.parquet(path)
        found = [(f.name, f.dataType.simpleString()) for f in df.schema]
        wanted = [(f.name, f.dataType.simpleString()) for f in schema]
        if found != wanted:
            raise ContractViolation(f"schema {found} differs from the contract {wanted}")
    else:
        raise ContractViolation(f"unsupported format: {file_format}")
    if rows is not None and df.count() != rows:
        raise ContractViolation(f"{path} does not have {rows} rows")
    return df


def require_headers(spark: SparkSession, path: str, names: list[str]) -> None:
    """Each CSV file begins with these column names: the first line of every file, in one pass over first lines only."""
    lines = spark.read.option("wholetext", False).text(path)
    first = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    ).filter("start = 0")
    heads = first.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    named = F.regexp_replace("head", "^\ufeff|\r$", "")
    wrong = heads.select("file", named.alias("head")).filter(~F.col("head").isin(_header_lines(names)))
    require_empty(wrong, f"CSV headers differ from the contract {names}")


def _header_lines(names: list[str]) -> list[str]:
    """The header as it may be written: bare or with every name in quotes."""
    return [",".join(names), ",".join(f'"{name}"' for name in names)]


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows and columns of each table; counts come from file metadata where the format has it."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns")
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def shape_violations(tables: dict[str, DataFrame], declared: dict[str, tuple[int, list[str]]]) -> DataFrame:
    """Tables whose rows or columns (names, in order) differ from the declaration, or that only one side has: table, problem."""
    both = {name: df for name, df in tables.items() if name in declared}
    spark = next(iter(tables.values())).sparkSession
    sides = [(name, "undeclared") for name in tables if name not in declared] + [(name, "missing") for name in declared if name not in tables]
    one_sided = spark.createDataFrame(sides, "table string, problem string")
    if not both:
        return one_sided
    wanted = spark.createDataFrame([(name, *declared[name]) for name in both], "table string, _rows long, _columns array<string>")
    found = table_shapes(both).join(wanted, "table")
    problems = F.array(
        F.when(F.col("rows") != F.col("_rows"), F.lit("rows")), F.when(F.col("columns") != F.col("_columns"), F.lit("columns"))
    )
    return one_sided.unionByName(found.select("table", F.explode(F.array_compact(problems)).alias("problem")))


def scan_features(cache: DataFrame, ids: DataFrame, key: str = "record_id", check: bool = True) -> DataFrame:
    """Rows of a feature cache for the needed ids; an id the cache lacks is an error."""
    if check:
        require_empty(missing_ids(ids, cache, key), "the feature cache lacks required records")
    return rows_in(cache, ids, key)


def align_vectors(
    vectors: DataFrame, ids: DataFrame, key: str = "record_id", vector: str = "embedding", order: str = "ord", check: bool = True
) -> DataFrame:
    """Vectors of a required id list with the list's order; missing or repeated ids are errors."""
    if check:
        counted = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        status = ids.select(key).join(counted, key, "left").filter(F.coalesce("n", F.lit(0)) != 1)
        require_empty(status, "vectors are missing or repeated")
    return vectors.select(key, vector).join(ids.select(key, order), key)

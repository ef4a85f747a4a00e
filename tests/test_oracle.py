"""Every registered query against its SQL twin in DuckDB, on the driver's smallest tables."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    status, _, detail = compare(spark, duck, small, name, QUERIES[name], ORACLES.get(name))
    assert status == ("equal" if name in ORACLES else "rows-only"), detail


def test_flagship_blend_beats_its_components(spark, small):
    rmse = {r["predictor"]: r["rmse"] for r in QUERIES["flagship_crossfit_blend"](spark, small).collect()}
    assert rmse["blend"] < min(rmse["descriptor_prediction"], rmse["neural_prediction"])


def test_row_ids_of_more_than_five_digits(spark, tmp_path):
    spark.range(100_003).select(F.col("id").alias("doc_id")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    status, _, detail = compare(spark, connection, str(tmp_path), "a8_row_ids", QUERIES["a8_row_ids"], ORACLES["a8_row_ids"])
    assert status == "equal", detail

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise import ContractViolation
from foldwise.sources.contracts import align_vectors, read_contract, scan_features, table_shapes
from foldwise.sources.integrity import file_digests, file_integrity
from foldwise.sources.sinks import write_predictions, write_stages

SCHEMA = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("target", T.DoubleType())])


def test_csv_contract(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_bytes("﻿record_id,target\na,1.5\nb,2\n".encode())
    df = read_contract(spark, str(path), SCHEMA, rows=2)
    assert {r["record_id"]: r["target"] for r in df.collect()} == {"a": 1.5, "b": 2.0}
    with pytest.raises(ContractViolation):
        read_contract(spark, str(path), SCHEMA, rows=3)
    path.write_text("target,record_id\n1,a\n")
    with pytest.raises(ContractViolation):
        read_contract(spark, str(path), SCHEMA)
    bad = tmp_path / "bad.csv"
    bad.write_text("record_id,target\na,word\n")
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        read_contract(spark, str(bad), SCHEMA).collect()


def test_parquet_contract_and_shapes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1.0)], SCHEMA).write.parquet(path)
    assert read_contract(spark, path, SCHEMA, 1, "parquet").count() == 1
    with pytest.raises(ContractViolation):
        read_contract(spark, path, T.StructType(SCHEMA.fields[:1]), file_format="parquet")
    row = table_shapes({"t": spark.read.parquet(path)}).first()
    assert (row["table"], row["rows"], row["columns"]) == ("t", 1, ["record_id", "target"])


def test_integrity(spark, tmp_path):
    manifest = []
    for name in ("same", "changed", "extra"):
        (tmp_path / name).write_bytes(name.encode())
        if name != "extra":
            manifest.append((name, hashlib.sha256(name.encode()).hexdigest(), len(name)))
    manifest.append(("gone", "0" * 64, 1))
    (tmp_path / "changed").write_bytes(b"CHANGED")
    declared = spark.createDataFrame(manifest, "name string, sha256 string, bytes bigint")
    found = sorted(tuple(r) for r in file_integrity(spark, str(tmp_path), declared).collect())
    assert found == [("changed", "digest"), ("extra", "undeclared"), ("gone", "missing")]


def test_files_of_any_size_are_hashed_in_pieces(spark, tmp_path):
    rng = random.Random(5)
    noise = rng.randbytes(300_000)
    files = {
        "noise.parquet": noise,
        "ends.txt": b"a\r\nb\n\n" * 9_000,
        "open.txt": b"a\n\xff\x00" * 9_000,
        "marked.csv": b"\xef\xbb\xbfx,y\n" * 5_000,
        "marked open.csv": b"\xef\xbb\xbf" + noise + b"z",
        "no suffix+%41": noise[::-1] + b"\n",
        "feeds": b"\n" * 20_000,
        "zeros.bin": bytes(70_000),
        "packed.gz": gzip.compress(noise),
        "false.gz": noise[:90_000],
        "false.bz2": noise[7:],
        "below/deep.zst": noise[9:],
        "small": b"abc",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    expected = {name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in files.items()}
    for block in ("128m", "40k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            found = file_digests(spark, str(tmp_path), value_bytes=1_000).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(found) == len(files) and {r["name"]: (r["sha256"], r["bytes"]) for r in found} == expected


def test_feature_and_vector_scans(spark):
    cache = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "record_id string, x double")
    assert scan_features(cache, cache.select("record_id").limit(1)).count() == 1
    with pytest.raises(ContractViolation):
        scan_features(cache, spark.createDataFrame([("z",)], "record_id string"))
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("b", [3.0])], "record_id string, embedding array<double>")
    ids = spark.createDataFrame([("a", 0)], "record_id string, ord int")
    assert align_vectors(vectors, ids).first()["ord"] == 0
    with pytest.raises(ContractViolation):
        align_vectors(vectors, spark.createDataFrame([("b", 0)], "record_id string, ord int"))


def test_scored_stage_has_no_label(spark, tmp_path):
    df = spark.createDataFrame([("parameter_fit", "a", 1.0), ("scored_prediction", "b", 2.0)], "stage string, record_id string, target double")
    path = str(tmp_path / "stages")
    write_stages(df, path)
    assert "target" not in spark.read.parquet(f"{path}/scored_prediction").columns
    training = spark.read.parquet(f"{path}/training").collect()
    assert [(r["stage"], r["record_id"], r["target"]) for r in training] == [("parameter_fit", "a", 1.0)]
    with pytest.raises(Exception, match="(?i)exists"):
        write_stages(df, path)
    with pytest.raises(ContractViolation):
        write_stages(df.withColumn("Observed", F.lit(1)), str(tmp_path / "other"))


def test_prediction_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "record_id string, prediction double")
    counts = write_predictions(df, str(tmp_path / "p"), df.select("record_id"), {"design": "d"})
    assert counts == {"rows": 2, "finite_rows": 2, "mean_prediction": 2.0}
    summary = {r["name"]: r["value"] for r in spark.read.parquet(str(tmp_path / "p" / "summary")).collect()}
    assert summary["rows"] == "2" and summary["scored_labels_accessed"] == "False" and summary["design"] == "d"
    with pytest.raises(ContractViolation):
        write_predictions(df, str(tmp_path / "q"), df.select("record_id").limit(1))
    with pytest.raises(ContractViolation):
        write_predictions(df.withColumn("prediction", F.lit(None).cast("double")), str(tmp_path / "r"))

"""Evaluation tables derived from the driver's tables, for queries, tests and the benchmark.

Each function takes (spark, directory) and returns a lazy table. The orders are the records, the
logarithm of their price the target, and two noisy copies of it the component predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import UINT32, hash32
from .session import read_table

FOLDS = (0, 1, 2, 3, 4)


def _fold_list() -> Column:
    return F.array(*[F.lit(f) for f in FOLDS])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _noise(prefix: str, scale: float) -> Column:
    return F.lit(scale) * (hash32(_text(prefix, F.col("record_id"))) / F.lit(UINT32) - F.lit(0.5))


def v_label(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_orderkey").alias("ord"),
        F.ln("o_totalprice").alias("target"),
    )


def _predicted(labels: DataFrame) -> DataFrame:
    return labels.withColumns(
        {
            "fold_index": (hash32(_text("f:", F.col("record_id"))) % 5).cast("int"),
            "descriptor_prediction": F.round(F.col("target") + _noise("d:", 0.8), 9),
            "neural_prediction": F.round(F.col("target") + _noise("n:", 0.5) + F.lit(0.1), 9),
        }
    )


def v_pred(spark: SparkSession, directory: str) -> DataFrame:
    return _predicted(v_label(spark, directory)).drop("target")


def v_labelled(spark: SparkSession, directory: str) -> DataFrame:
    """v_pred with the target still beside it, for operators that start from bound rows."""
    return _predicted(v_label(spark, directory))


def v_orders(spark: SparkSession, directory: str) -> DataFrame:
    """v_labelled beside all columns of its orders; an order is a record, so no join is needed."""
    orders = read_table(spark, directory, "orders")
    return _predicted(orders.withColumns({"record_id": F.col("o_orderkey").cast("string"), "ord": F.col("o_orderkey"), "target": F.ln("o_totalprice")}))


def v_coef(spark: SparkSession, directory: str) -> DataFrame:
    rows = v_labelled(spark, directory)
    others = F.array_except(_fold_list(), F.array("fold_index"))
    return rows.select(
        F.explode(others).alias("deployment_fold"), "record_id", "descriptor_prediction", "neural_prediction", "target"
    )


def v_splitpred(spark: SparkSession, directory: str) -> DataFrame:
    expanded = v_pred(spark, directory).drop("fold_index").withColumn("fold_index", F.explode(_fold_list()))
    return expanded.select(
        "record_id",
        "fold_index",
        (F.col("descriptor_prediction") + F.lit(0.01) * F.col("fold_index")).alias("descriptor_prediction"),
        (F.col("neural_prediction") - F.lit(0.01) * F.col("fold_index")).alias("neural_prediction"),
    )


def v_part(spark: SparkSession, directory: str) -> DataFrame:
    rows = v_pred(spark, directory).select("record_id", F.col("fold_index").alias("_own"))
    expanded = rows.withColumn("fold_index", F.explode(_fold_list()))
    reserved = hash32(_text("r:", F.col("fold_index").cast("string"), ":", F.col("record_id"))) % 8 == 0
    role = (
        F.when(F.col("_own") == F.col("fold_index"), F.lit("scored")).when(reserved, F.lit("reserved")).otherwise(F.lit("fit"))
    )
    return expanded.select("record_id", "fold_index", role.alias("role"))


def v_stage(spark: SparkSession, directory: str) -> DataFrame:
    stage = (
        F.when(F.col("role") == "fit", F.lit("parameter_fit"))
        .when(F.col("role") == "reserved", F.lit("selection_score"))
        .otherwise(F.lit("scored_prediction"))
    )
    named = _text(stage, ":", F.col("fold_index").cast("string"))
    return v_part(spark, directory).select(named.alias("stage"), "record_id")


def v_widesplit(spark: SparkSession, directory: str) -> DataFrame:
    test = hash32(_text("t:", F.col("record_id"))) % 10 == 0
    columns = []
    for i in (1, 2, 3):
        val = hash32(_text(f"w{i}:", F.col("record_id"))) % 5 == 0
        columns.append(F.when(test, F.lit("Test")).when(val, F.lit("Val")).otherwise(F.lit("Train")).alias(f"split{i}"))
    return v_label(spark, directory).select("record_id", *columns)


def v_feat(spark: SparkSession, directory: str) -> DataFrame:
    price = F.col("l_extendedprice")
    grouped = read_table(spark, directory, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.round(F.sum(price), 6).alias("ext"),
        F.round(F.sum(price * (F.lit(1) - F.col("l_discount"))), 6).alias("rev"),
        F.round(F.avg(price), 6).alias("avg_ext"),
        F.max("l_tax").alias("max_tax"),
        F.max("l_discount").alias("_discount"),
    )
    key = F.col("l_orderkey").cast("string")
    gap = F.when(hash32(_text("g:", key)) % 50 == 0, F.lit(None)).otherwise(F.col("_discount"))
    return grouped.select(
        key.alias("record_id"), "n_lines", "qty", "ext", "rev", "avg_ext", "max_tax",
        F.lit(1.0).alias("const_one"), (F.lit(1e-8) * (F.col("l_orderkey") % 2)).alias("tiny"), gap.alias("gap"),
    )


FEATURES = ["n_lines", "qty", "ext", "rev", "avg_ext", "max_tax", "const_one", "tiny", "gap"]


def v_emb(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "embeddings").select(
        F.col("vec_id").cast("string").alias("record_id"), "label", F.col("vec_id").alias("ord"), "embedding"
    )


def v_members(spark: SparkSession, directory: str) -> DataFrame:
    rows = v_label(spark, directory).withColumn("member", F.explode(F.array(*[F.lit(m) for m in (0, 1, 2, 3)])))
    seed = _text("m", F.col("member").cast("string"), ":", F.col("record_id"))
    noise = F.lit(0.3) * (hash32(seed) / F.lit(UINT32) - F.lit(0.5))
    return rows.select("record_id", "member", F.round(F.col("target") + noise, 9).alias("prediction"))


def v_trials(spark: SparkSession, directory: str) -> DataFrame:
    rows = v_labelled(spark, directory).withColumn("trial", F.explode(_fold_list()))
    step = F.col("neural_prediction") - F.col("descriptor_prediction")
    error = F.col("descriptor_prediction") + F.lit(0.2) * F.col("trial") * step - F.col("target")
    grouped = rows.select("trial", F.col("fold_index").alias("inner_validation_fold"), error.alias("e")).groupBy(
        "trial", "inner_validation_fold"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("e") * F.col("e")), 9).alias("sse"),
        F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 9).alias("rmse"),
        F.round(F.avg(F.abs("e")), 9).alias("mae"),
    )
    seed = _text("b:", F.col("trial").cast("string"), ":", F.col("inner_validation_fold").cast("string"))
    return grouped.withColumn("best_iteration", F.lit(10) + hash32(seed) % 40)


def v_usage(spark: SparkSession, directory: str) -> DataFrame:
    pick = hash32(_text("u:", F.col("event_id").cast("string"))) % 3
    role = F.when(pick == 0, F.lit("model_development")).when(pick == 1, F.lit("coefficient_development")).otherwise(F.lit("scored"))
    kind = F.col("event_type")
    operation = (
        F.when(kind == "click", F.lit("preprocessing"))
        .when(kind == "error", F.lit("hyperparameter_selection"))
        .when(kind == "purchase", F.lit("model_fitting"))
        .when(kind == "signup", F.lit("coefficient_fitting"))
        .otherwise(F.lit("scoring"))
    )
    return read_table(spark, directory, "events").select("event_id", role.alias("role"), operation.alias("operation"))


def v_manifest(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    bad = hash32(_text("x:", key)) % 10 == 0
    return read_table(spark, directory, "supplier").select(
        F.col("s_name").alias("path"),
        F.when(bad, F.lit("ZZ")).otherwise(F.concat(F.md5("s_name"), F.md5(key))).alias("sha256"),
        F.col("s_suppkey").alias("bytes"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit("2024-13-01")).otherwise(F.lit("2024-01-15")).alias("retrieval_date"),
    )


def v_report(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_table(spark, directory, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderkey").alias("ord"),
        F.ln("o_totalprice").alias("target"), F.col("o_orderpriority").alias("panel"),
    )
    rows = _predicted(orders).withColumn("model", F.explode(F.array(*[F.lit(m) for m in (0, 1, 2, 3)])))
    seed = _text("m", F.col("model").cast("string"), ":", F.col("record_id"))
    noise = F.lit(0.3) * (hash32(seed) / F.lit(UINT32) - F.lit(0.5))
    member = F.round(F.col("target") + noise, 9) - F.col("target")
    neural = F.col("neural_prediction") - F.col("target")
    return rows.select("panel", "model", (member * member).alias("m2"), (neural * neural).alias("p2")).groupBy("panel", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sqrt(F.avg("m2")), 9).alias("rmse"),
        F.round(F.sqrt(F.avg("p2")) - F.sqrt(F.avg("m2")), 9).alias("delta"),
    )


def v_ci(spark: SparkSession, directory: str) -> DataFrame:
    level = F.substring("panel", 1, 1).cast("int")
    return v_report(spark, directory).select(
        "panel", "model", "n", (-F.col("delta")).alias("delta"),
        (-F.col("delta") - F.lit(0.02) * level).alias("ci95_low"),
        (-F.col("delta") + F.lit(0.02) * level).alias("ci95_high"),
        (-F.col("delta") - F.lit(0.026) * level).alias("ci99_low"),
        (-F.col("delta") + F.lit(0.026) * level).alias("ci99_high"),
    )

"""Queries on reading and writing: contracts, shapes, integrity, aligned scans, sinks, row ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..functions.vectors import as_vector
from ..operators.keys import row_ids, union_distinct
from ..operators.ranking import ordinal, source_row_number
from ..session import read_table, shared_folder
from ..sources.contracts import align_vectors, read_contract, scan_features, shape_violations, table_shapes
from ..sources.integrity import file_digests, file_integrity
from ..sources.sinks import SCORED_STAGE, write_predictions, write_stages
from . import query
from .views import with_views

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

LABELS_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]
)


@query("a1_read_contract", "select doc_id, quality, toxic from labels")
def a1(spark, d):
    return read_contract(spark, f"{d}/labels.parquet", LABELS_SCHEMA, file_format="parquet")


@query("a1_read_csv", "select doc_id, quality, toxic from labels")
def a1_csv(spark, d):
    """The labels written as CSV files with a header each, and read back under their contract."""
    path = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    labels = read_table(spark, d, "labels").select(LABELS_SCHEMA.fieldNames())
    labels.write.option("header", True).csv(path)
    return read_contract(spark, path, LABELS_SCHEMA, rows=labels.count())


@query(
    "a2_table_shape",
    " union all ".join(
        f"select '{t}' as table_name, (select count(*) from {t}) as rows, (select string_agg(column_name, ',' order by "
        f"ordinal_position) from (select distinct column_name, ordinal_position from information_schema.columns where "
        f"table_name='{t}')) as columns"
        for t in TABLES
    ),
)
def a2(spark, d):
    shapes = table_shapes({t: read_table(spark, d, t) for t in TABLES})
    return shapes.select(F.col("table").alias("table_name"), "rows", F.array_join("columns", ",").alias("columns"))


@query(
    "a2_shape_violations",
    """select t as table_name, p as problem from (
        select 'orders' t, 'rows' p, (select count(*) from orders) <> (select count(*) from customer) bad union all
        select 'customer', 'rows', (select count(*) from customer) <> (select count(*) from customer) union all
        select 'supplier', 'columns', true union all select 'part', 'undeclared', true union all select 'invoices', 'missing', true)
    where bad""",
)
def a2_violations(spark, d):
    tables = {name: read_table(spark, d, name) for name in ("orders", "customer", "supplier", "part")}
    customers = tables["customer"].count()
    declared = {
        "orders": (customers, tables["orders"].columns),
        "customer": (customers, tables["customer"].columns),
        "supplier": (tables["supplier"].count(), sorted(tables["supplier"].columns)),
        "invoices": (0, ["id"]),
    }
    return shape_violations(tables, declared).withColumnRenamed("table", "table_name")


@query("a3_file_digests")
def a3(spark, d):
    return file_digests(spark, d, "*.parquet")


@query(
    "a3_written_digests",
    """select 'nation='||s_nationkey as name, sha256(string_agg(s_suppkey||' '||s_name||chr(10), '' order by s_suppkey)) as sha256,
      cast(sum(strlen(s_suppkey||' '||s_name)+1) as bigint) as bytes from supplier group by s_nationkey""",
)
def a3_written(spark, d):
    """Names, digests and sizes of text files whose bytes follow from a table, one file per nation."""
    line = F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name").alias("value")
    rows = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", line)
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.repartition("nation").sortWithinPartitions("nation", "s_suppkey").drop("s_suppkey").write.partitionBy("nation").text(path)
    return file_digests(spark, path, "*.txt").withColumn("name", F.substring_index("name", "/", 1))


@query("a3_file_integrity", "select * from (values ('nation.parquet', 'digest'), ('region.parquet', 'undeclared'), ('absent.parquet', 'missing')) t(name, status)")
def a3_integrity(spark, d):
    found = file_digests(spark, d, "*.parquet")
    drifted = F.when(F.col("name") == "nation.parquet", F.lit("0" * 64)).otherwise(F.col("sha256"))
    renamed = F.when(F.col("name") == "region.parquet", F.lit("absent.parquet")).otherwise(F.col("name"))
    manifest = found.select(renamed.alias("name"), drifted.alias("sha256"), "bytes")
    return file_integrity(spark, d, manifest, "*.parquet")


@query(
    "a4_scan_features",
    with_views("select f.record_id, f.n_lines, f.ext from v_feat f where exists (select 1 from v_label l where l.record_id=f.record_id)"),
)
def a4(spark, d):
    features = fx.v_feat(spark, d)
    ids = fx.v_label(spark, d).join(features.select("record_id"), "record_id", "left_semi")
    return scan_features(features, ids).select("record_id", "n_lines", "ext")


@query(
    "a5_align_vectors",
    with_views("""select record_id, ord, len(embedding) as dimension, round(list_sum(list_transform(embedding, lambda x: x::double)),5) as total from v_emb"""),
)
def a5(spark, d):
    vectors = fx.v_emb(spark, d)
    aligned = align_vectors(vectors.select("record_id", "embedding"), vectors.select("record_id", "ord"))
    total = F.aggregate(as_vector("embedding"), F.lit(0.0), lambda acc, x: acc + x)
    return aligned.select(
        "record_id", "ord", F.size("embedding").cast("bigint").alias("dimension"), F.round(total, 5).alias("total")
    )


@query(
    "a6_write_stages",
    with_views("""select stage, count(*) as n, sum(case when target is null then 0 else 1 end) as labelled from (
      select case role when 'scored' then 'scored_prediction' else 'parameter_fit' end as stage,
             case role when 'scored' then null else l.target end as target
      from v_part p join v_label l using (record_id)) group by stage"""),
)
def a6(spark, d):
    stage = F.when(F.col("role") == "scored", F.lit(SCORED_STAGE)).otherwise(F.lit("parameter_fit"))
    rows = fx.v_part(spark, d).join(fx.v_label(spark, d), "record_id").select(stage.alias("stage"), "record_id", "target")
    path = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    write_stages(rows, path)
    training = spark.read.parquet(f"{path}/training").select("stage", "target")
    scored = spark.read.parquet(f"{path}/{SCORED_STAGE}").select("stage", F.lit(None).cast("double").alias("target"))
    return training.unionByName(scored).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled")
    )


@query("a7_write_predictions", with_views("select record_id, neural_prediction as prediction from v_pred"))
def a7(spark, d):
    rows = fx.v_pred(spark, d).select("record_id", F.col("neural_prediction").alias("prediction"))
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    write_predictions(rows, path, fx.v_label(spark, d), {"design": "nested_holdout"})
    return spark.read.parquet(f"{path}/predictions")


@query(
    "a8_row_ids",
    "select 'doc_'||printf('%05d', row_number() over (order by doc_id)-1) as record_id, doc_id from documents",
)
def a8(spark, d):
    numbered = source_row_number(read_table(spark, d, "documents"))
    return row_ids(numbered, "doc_", 5).select("record_id", "doc_id")


@query(
    "a8_ordinal",
    "select event_id, row_number() over (order by user_id, ts, event_id)-1 as ord from events",
)
def a8_ordinal(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id", "ts")
    return ordinal(events, ["user_id", "ts", "event_id"]).select("event_id", "ord")


@query("g1_sort_by_source_row", "select doc_id, row_number() over (order by doc_id)-1 as row_number from documents")
def g1_source(spark, d):
    return source_row_number(read_table(spark, d, "documents")).select("doc_id", "row_number").orderBy("row_number")


@query(
    "h1_union_distinct",
    with_views("""select record_id, min(source) as source from (
      select record_id, 0 as source from v_part where role='fit' union all
      select record_id, 1 from v_part where role='reserved' union all
      select record_id, 2 from v_part where role='scored') group by record_id"""),
)
def h1(spark, d):
    parts = fx.v_part(spark, d)
    tables = [
        parts.filter(F.col("role") == r).select("record_id", F.lit(i).alias("source"))
        for i, r in enumerate(("fit", "reserved", "scored"))
    ]
    return union_distinct(tables, ["record_id"])

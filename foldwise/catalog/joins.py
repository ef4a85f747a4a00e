"""Queries on binding, coverage, overlap, comparison, fingerprints and ranks of keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.blending import attach_alpha, crossfit_rows, fit_crossfit_alpha
from ..operators.checks import key_violations
from ..operators.containment import passage_overlap
from ..operators.keys import (
    bind_coefficients,
    bind_exact,
    bind_status,
    coefficient_overlap,
    content_overlap,
    fingerprint,
    first_seen,
    id_intersect,
    id_minus,
    id_union,
    missing_ids,
    override_labels,
    population_diff,
    restore_order,
    rows_in,
    rows_in_exact,
    stage_overlaps,
    top_k_per_key,
)
from ..session import read_table
from . import query
from .views import with_views

COMPONENTS = ["descriptor_prediction", "neural_prediction"]


@query(
    "c1_bind_exact",
    with_views("select p.record_id, p.ord, round(l.target,6) as target, p.descriptor_prediction, p.neural_prediction from v_pred p join v_label l using (record_id)"),
)
def c1(spark, d):
    labels = fx.v_label(spark, d).select("record_id", "target")
    bound = bind_exact(fx.v_pred(spark, d), labels, COMPONENTS, order="ord")
    return bound.withColumn("target", F.round("target", 6))


@query(
    "c1_bind_status",
    """select cast(d.doc_id as varchar) as doc_id, 1 as n_left, 0 as n_right, 'left_only' as status
       from documents d left join labels l on l.doc_id=d.doc_id where l.doc_id is null""",
)
def c1_status(spark, d):
    return bind_status(read_table(spark, d, "documents"), read_table(spark, d, "labels"), ["doc_id"])


@query(
    "c2_bind_coefficients",
    with_views("select deployment_fold, record_id, round(target,6) as target, descriptor_prediction, neural_prediction from v_coef"),
)
def c2(spark, d):
    rows = fx.v_coef(spark, d)
    bound = bind_coefficients(rows.drop("target"), rows.select("deployment_fold", "record_id", "target"), COMPONENTS)
    return bound.withColumn("target", F.round("target", 6))


@query(
    "c3_rows_in",
    "select o_orderkey, o_orderstatus from orders o where exists (select 1 from lineitem l where l.l_orderkey=o.o_orderkey)",
)
def c3(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rows_in(orders, read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("c3_rows_in_exact", with_views("select record_id, target from (select record_id, round(target,6) as target from v_label) where record_id in (select record_id from v_feat)"))
def c3_exact(spark, d):
    labels = fx.v_label(spark, d).select("record_id", F.round("target", 6).alias("target"))
    return rows_in_exact(labels, fx.v_feat(spark, d).select("record_id"))


@query("c4_missing_ids", with_views("select record_id from v_label where record_id not in (select record_id from v_feat)"))
def c4(spark, d):
    return missing_ids(fx.v_label(spark, d), fx.v_feat(spark, d))


_C5_BAD = """with c as (select case when H('z:'||record_id)%50=0 then (deployment_fold+1)%5 else deployment_fold end as deployment_fold, record_id from v_coef)"""


@query(
    "c5_overlap_same_fold",
    with_views(_C5_BAD + " select c.deployment_fold, c.record_id from c where exists (select 1 from v_pred p where p.record_id=c.record_id and p.fold_index=c.deployment_fold)"),
)
def c5(spark, d):
    from ..functions.hashing import hash32

    coefficient = fx.v_coef(spark, d).select("deployment_fold", "record_id")
    moved = hash32(F.concat(F.lit("z:"), F.col("record_id"))) % 50 == 0
    fold = F.when(moved, (F.col("deployment_fold") + 1) % 5).otherwise(F.col("deployment_fold"))
    return coefficient_overlap(coefficient.withColumn("deployment_fold", fold), fx.v_pred(spark, d))


@query("c5_overlap_any_fold", with_views("select deployment_fold, record_id from v_coef where record_id in (select record_id from v_pred)"))
def c5_any(spark, d):
    coefficient = fx.v_coef(spark, d).select("deployment_fold", "record_id")
    return coefficient_overlap(coefficient, fx.v_pred(spark, d), one_coefficient=True)


@query(
    "c6_stage_overlaps",
    with_views("""select a.stage as stage_a, b.stage as stage_b, count(*) as n from v_stage a join v_stage b
      on a.record_id=b.record_id and a.stage<b.stage group by 1,2"""),
)
def c6(spark, d):
    return stage_overlaps(fx.v_stage(spark, d))


@query(
    "c7_content_overlap",
    """with t as (select sha256(text) as digest, case when exists (select 1 from labels l where l.doc_id=d.doc_id) then 0 else 1 end as train from documents d),
       g as (select digest, count(*) filter (train=1) as n_train, count(*) filter (train=0) as n_test from t group by digest)
       select digest, n_train, n_test, case when n_train>0 and n_test>0 then 'overlap' when n_train>1 then 'duplicate_train' else 'duplicate_test' end as problem
       from g where (n_train>0 and n_test>0) or n_train>1 or n_test>1""",
)
def c7(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    return content_overlap(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi"), "text")


@query(
    "c8_passage_overlap",
    "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)",
)
def c8(spark, d):
    return passage_overlap(read_table(spark, d, "documents").select("doc_id", "text"), read_table(spark, d, "benchmark"))


@query(
    "c10_override_labels",
    with_views("""select l.record_id, round(coalesce(o.target,l.target),6) as target, round(abs(l.target-o.target),6) as delta,
        coalesce(abs(l.target-o.target)>4e-3,false) as rejected
      from v_label l left join (select record_id, round(target,2) as target from v_label where record_id in (select record_id from v_feat)) o on o.record_id=l.record_id"""),
)
def c10(spark, d):
    labels = fx.v_label(spark, d).select("record_id", "target")
    other = rows_in(labels, fx.v_feat(spark, d).select("record_id")).withColumn("target", F.round("target", 2))
    changed = override_labels(labels, other, 4e-3)
    return changed.select("record_id", F.round("target", 6).alias("target"), F.round("delta", 6).alias("delta"), "rejected")


@query(
    "c11_population_diff",
    with_views("""with b as (select case when ord%50=0 then 'x'||record_id else record_id end as record_id, case when ord%7=0 then target+1e-3 else target end as target from v_label)
      select coalesce(a.record_id,b.record_id) as record_id, case when b.record_id is null then 'left_only' when a.record_id is null then 'right_only' else 'different' end as status
      from v_label a full join b on a.record_id=b.record_id where a.record_id is null or b.record_id is null or abs(a.target-b.target)>1e-9"""),
)
def c11(spark, d):
    left = fx.v_label(spark, d)
    right = left.select(
        F.when(F.col("ord") % 50 == 0, F.concat(F.lit("x"), "record_id")).otherwise(F.col("record_id")).alias("record_id"),
        F.when(F.col("ord") % 7 == 0, F.col("target") + 1e-3).otherwise(F.col("target")).alias("target"),
    )
    return population_diff(left, right, ["record_id"], ["target"], 1e-9)


@query(
    "c12_crossfit_rows",
    with_views("""select f.fold_index as deployment_fold, p.record_id, p.fold_index from v_pred p join v_fold f on p.fold_index<>f.fold_index"""),
)
def c12(spark, d):
    rows = crossfit_rows(fx.v_pred(spark, d).select("record_id", "fold_index"), fx.FOLDS)
    return rows.select("deployment_fold", "record_id", "fold_index")


@query("c12_crossfit_alpha", with_views("select deployment_fold, round(alpha,6) as alpha, coefficient_rows from v_alpha"))
def c12_alpha(spark, d):
    fitted = fit_crossfit_alpha(fx.v_labelled(spark, d))
    return fitted.withColumn("alpha", F.round("alpha", 6))


@query(
    "c13_attach_alpha",
    with_views("select p.record_id, p.fold_index, round(a.alpha,6) as alpha from v_pred p join v_alpha a on a.deployment_fold=p.fold_index"),
)
def c13(spark, d):
    coefficients = fit_crossfit_alpha(fx.v_labelled(spark, d))
    attached = attach_alpha(fx.v_pred(spark, d), coefficients)
    return attached.select("record_id", "fold_index", F.round("alpha", 6).alias("alpha"))


_FINGERPRINT = """
with l0 as (select {by} sha256({line}) as d, count(*) as n from {table} group by all),
l1 as (select {b} substr(d,1,6) as k, n, d||':'||n as e from l0),
l2 as (select {b} k, sum(n) as n, sha256(string_agg(e, chr(10) order by e)) as g from l1 group by {b} k),
l3 as (select {b} substr(k,1,3) as k, n, k||':'||g as e from l2),
l4 as (select {b} k, sum(n) as n, sha256(string_agg(e, chr(10) order by e)) as g from l3 group by {b} k),
l5 as (select {b} n, k||':'||g as e from l4)
select {b} cast(sum(n) as bigint) as n, sha256(string_agg(e, chr(10) order by e)) as digest from l5 {group}"""


@query(
    "d18_fingerprint_by_stage",
    with_views(_FINGERPRINT.format(by="stage,", b="stage,", line="record_id", table="v_stage", group="group by stage").strip()),
)
def d18(spark, d):
    return fingerprint(fx.v_stage(spark, d), ["stage"], repeats=False)


@query(
    "d18_fingerprint_assignment",
    with_views(_FINGERPRINT.format(by="", b="", line="stage||chr(9)||record_id", table="v_stage", group="").strip()),
)
def d18_assignment(spark, d):
    return fingerprint(fx.v_stage(spark, d), [], F.concat_ws("\t", "stage", "record_id"), repeats=False)


@query(
    "d18_fingerprint_texts",
    with_views(_FINGERPRINT.format(by="lang,", b="lang,", line="text", table="documents", group="group by lang").strip()),
)
def d18_texts(spark, d):
    return fingerprint(read_table(spark, d, "documents"), ["lang"], "text")


@query(
    "f3_top_k",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank from (select *, row_number() over (partition by l_orderkey
       order by l_extendedprice, l_partkey, l_linenumber, l_suppkey) as rank from lineitem) where rank<=3""",
)
def f3(spark, d):
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    top = top_k_per_key(lines, ["l_orderkey"], ["l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey"], 3)
    return top.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("rank").cast("bigint").alias("rank"))


@query(
    "f5_first_seen",
    "select doc_id, source, sha256(text) as digest from documents where doc_id in (select min(doc_id) from documents group by text)",
)
def f5(spark, d):
    seen = first_seen(read_table(spark, d, "documents").select("doc_id", "source", "text"), ["text"], "doc_id")
    return seen.select("doc_id", "source", F.sha2("text", 256).alias("digest"))


@query("g2_restore_order", with_views("select record_id, ord, round(target,6) as target, neural_prediction from v_labelled order by ord"))
def g2(spark, d):
    labels = fx.v_label(spark, d).select("record_id", "target")
    bound = bind_exact(fx.v_pred(spark, d), labels, ["neural_prediction"], order="ord")
    return restore_order(bound.withColumn("target", F.round("target", 6)), "ord")


@query("h2_id_union", with_views("select distinct record_id from v_part where role in ('fit','reserved')"))
def h2(spark, d):
    parts = fx.v_part(spark, d)
    return id_union(parts.filter("role = 'fit'"), parts.filter("role = 'reserved'"))


@query(
    "h2_id_minus",
    with_views("select record_id from v_label except select record_id from v_part where role='reserved'"),
)
def h2_minus(spark, d):
    return id_minus(fx.v_label(spark, d), fx.v_part(spark, d).filter("role = 'reserved'"))


@query(
    "h3_id_intersect",
    with_views("select record_id from v_feat intersect select record_id from v_part where role='reserved'"),
)
def h3(spark, d):
    return id_intersect(fx.v_feat(spark, d), fx.v_part(spark, d).filter("role = 'reserved'"))


@query("c2_key_check", with_views("select cast(deployment_fold as varchar) as deployment_fold, record_id, count(*) as n, 'duplicate' as problem from v_coef group by 1,2 having count(*)>1"))
def c2_keys(spark, d):
    return key_violations(fx.v_coef(spark, d), ["deployment_fold", "record_id"])

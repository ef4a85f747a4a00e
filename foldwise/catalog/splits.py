"""Queries on splits: bins, folds, holdouts, group splits, nested folds, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.splits import (
    adaptive_bins,
    bin_round_robin,
    expand_folds,
    expand_variants,
    full_refit,
    group_split,
    held_out_role,
    kfold,
    map_roles,
    melt_splits,
    nested_folds,
    quantile_bins,
    reserve,
    same_membership,
    stratified_holdout,
    stratified_kfold,
)
from ..operators.stages import STAGE_RULES, resolve_stages
from ..session import read_table
from . import query
from .views import with_views


def _binned(spark, d):
    return quantile_bins(fx.v_label(spark, d).select("record_id", "target"), "target", 10)


@query("e1_quantile_bins", with_views("select record_id, bin from v_bin"))
def e1(spark, d):
    return _binned(spark, d).select("record_id", "bin")


KFOLD_SQL = """select record_id, cast(case when p < (n%5)*(n//5+1) then p//(n//5+1) else n%5 + (p-(n%5)*(n//5+1))//(n//5) end as int) as assigned_fold
from (select record_id, row_number() over (order by md5('7:'||record_id), record_id)-1 as p, count(*) over () as n from v_label)"""


@query("e2_kfold", with_views(KFOLD_SQL))
def e2(spark, d):
    return kfold(fx.v_label(spark, d).select("record_id"), 5, 7)


RESERVE_SQL = """select record_id, fold_index, case when role='scored' then role
  when row_number() over (partition by fold_index, role='scored' order by md5(cast(11+fold_index as varchar)||':'||record_id), record_id)
       <= ceil((count(*) over (partition by fold_index, role='scored'))/8e0) then 'reserved' else 'fit' end as role
from {source}"""


@query("e3_reserve", with_views(RESERVE_SQL.format(source="(select record_id, fold_index, case when role='scored' then role else 'fit' end as role from v_part)")))
def e3(spark, d):
    role = F.when(F.col("role") == "scored", F.col("role")).otherwise(F.lit("fit"))
    return reserve(fx.v_part(spark, d).withColumn("role", role), 0.125, 11)


@query(
    "e4_stratified_kfold",
    with_views("select record_id, bin, cast((row_number() over (order by bin, md5('13:'||record_id), record_id)-1)%5 as int) as assigned_fold from v_bin"),
)
def e4(spark, d):
    return stratified_kfold(_binned(spark, d).select("record_id", "bin"), "bin", 5, 13)


@query(
    "e5_bin_round_robin",
    with_views("select record_id, bin, cast((row_number() over (partition by bin order by md5('13:'||record_id), record_id)-1)%5 as int) as assigned_fold from v_bin"),
)
def e5(spark, d):
    return bin_round_robin(_binned(spark, d).select("record_id", "bin"), "bin", 5, 13)


HOLDOUT_SQL = """
with c as (select bin, count(*) as n from v_bin group by bin), t as (select *, cast(sum(n) over () as bigint) as total from c),
w as (select *, (total*15+99)//100 as want from t), f as (select *, (want*n)//total as fl, (want*n)%total as rest from w),
o as (select *, row_number() over (order by rest desc, bin) as turn, want-cast(sum(fl) over () as bigint) as open from f),
q as (select bin, fl+case when turn<=open then 1 else 0 end as quota from o)
select b.record_id, b.bin, row_number() over (partition by b.bin order by md5('19:'||b.record_id), b.record_id) <= q.quota as held_out
from v_bin b join q on q.bin=b.bin"""


@query("e6_stratified_holdout", with_views(HOLDOUT_SQL))
def e6(spark, d):
    return stratified_holdout(_binned(spark, d).select("record_id", "bin"), "bin", 0.15, 19)


ADAPTIVE_SQL = """
with m as (select source, round(avg(n_chars),9) as mean from documents group by source),
l as (select list(mean order by mean) as v, count(*) as n from m),
qs as (select unnest(range(4,21)) as q),
e as (select q, list_sort(list_distinct(list_transform(range(0,q+1), lambda i: round(
   v[cast(floor((n-1)*i/q::double) as bigint)+1] + (v[cast(ceil((n-1)*i/q::double) as bigint)+1]-v[cast(floor((n-1)*i/q::double) as bigint)+1])*((n-1)*i/q::double-floor((n-1)*i/q::double)),9)))) as edges from qs, l),
b as (select e.q, m.source, cast(least(len(edges)-2, greatest(0, len(list_filter(edges, lambda x: x<mean))-1)) as int) as bin from m, e),
k as (select q, min(c) as low, count(*) as bins from (select q, bin, count(*) as c from b group by q, bin) group by q),
w as (select max(q) as q from k where low>=5 and bins>=4)
"""


@query("e7_adaptive_bins", ADAPTIVE_SQL + "select source, bin from b where q=(select q from w)")
def e7(spark, d):
    means = read_table(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 9).alias("mean"))
    return adaptive_bins(means, "mean").select("source", "bin")


GROUP_SPLIT_SQL = (
    ADAPTIVE_SQL.rstrip()
    + """,
g as (select source, bin from b where q=(select q from w)),
c as (select bin, count(*) as n from g group by bin), t as (select *, cast(sum(n) over () as bigint) as total from c),
w2 as (select *, (total*2+9)//10 as want from t), f as (select *, (want*n)//total as fl, (want*n)%total as rest from w2),
o as (select *, row_number() over (order by rest desc, bin) as turn, want-cast(sum(fl) over () as bigint) as open from f),
q2 as (select bin, fl+case when turn<=open then 1 else 0 end as quota from o),
s as (select g.source, row_number() over (partition by g.bin order by md5('23:'||g.source), g.source) <= q2.quota as held from g join q2 on q2.bin=g.bin)
select d.doc_id, d.source, case when s.held then 'score' else 'fit' end as side from documents d join s on s.source=d.source"""
)


@query("e11_group_split", GROUP_SPLIT_SQL)
def e11(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return group_split(docs, "source", "n_chars", 0.2, 23).select("doc_id", "source", "side")


@query(
    "e12_nested_folds",
    # a record is scored in its own fold only, so outer and inner stage follow from that fold
    with_views("""select o.i as outer_fold, n.i as inner_fold, record_id, case when fold_index=n.i then 'selection_score' else 'selection_fit' end as stage
      from v_pred, (values (0), (1), (2), (3), (4)) o(i), (values (0), (1), (2), (3), (4)) n(i) where o.i<>n.i and fold_index<>o.i"""),
)
def e12(spark, d):
    return nested_folds(fx.v_part(spark, d))


SPLIT_ROLES = {"Train": "fit", "Val": "coefficient", "Test": "scored"}
MELT_SQL = " union all ".join(
    f"select record_id, {i} as fold_index, case split{i} when 'Train' then 'fit' when 'Val' then 'coefficient' else 'scored' end as role from v_widesplit"
    for i in (1, 2, 3)
)


@query("e13_melt_splits", with_views(MELT_SQL))
def e13(spark, d):
    return melt_splits(fx.v_widesplit(spark, d), {f"split{i}": i for i in (1, 2, 3)}, SPLIT_ROLES)


@query(
    "e14_same_membership",
    with_views(f"select record_id, count(*) filter (role='coefficient') as n from ({MELT_SQL}) group by record_id having count(*) filter (role='coefficient') between 1 and 2"),
)
def e14(spark, d):
    long = melt_splits(fx.v_widesplit(spark, d), {f"split{i}": i for i in (1, 2, 3)}, SPLIT_ROLES)
    return same_membership(long, "coefficient", 3)


@query(
    "e15_full_refit",
    with_views("select record_id, 0 as fold_index, case when split1='Test' then 'scored' else 'fit' end as role from v_widesplit"),
)
def e15(spark, d):
    rows = fx.v_widesplit(spark, d)
    return full_refit(rows.filter("split1 <> 'Test'"), rows.filter("split1 = 'Test'"))


def _stage_sql(design, branch):
    parts = [
        f"select record_id, fold_index, '{s}' as stage from v_part where role='{role}'"
        for de, br, role, stages in STAGE_RULES
        if (de, br) == (design, branch)
        for s in stages
    ]
    return " union all ".join(parts)


def _stage_query(name, design, branch):
    @query(name, with_views(_stage_sql(design, branch)))
    def run(spark, d):
        return resolve_stages(fx.v_part(spark, d), design, branch)

    return run


_stage_query("e16_stages_tabular", "nested_holdout", "tabular")
_stage_query("e16_stages_encoder", "nested_holdout", "encoder")
_stage_query("e16_stages_coefficient", "global_selection", "coefficient")
_stage_query("e16_stages_refit_head", "full_refit", "head")


@query("e17_expand_variants", "select doc_id, cast(unnest(range(0,4)) as int) as variant, sha256(text) as digest from documents")
def e17(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return expand_variants(docs, 3)


@query("c9_map_roles", with_views("select record_id, case split2 when 'Train' then 'fit' when 'Val' then 'reserved' else 'reserved' end as role from v_widesplit"))
def c9(spark, d):
    mapped = map_roles(fx.v_widesplit(spark, d), {"Train": "fit", "Val": "reserved", "Test": "reserved"}, "split2")
    return mapped.select("record_id", "role")


@query(
    "c15_expand_folds",
    with_views("select p.record_id, f.fold_index, case when p.fold_index=f.fold_index then 'scored' else 'fit' end as role from v_pred p cross join v_fold f"),
)
def c15(spark, d):
    rows = fx.v_pred(spark, d).select("record_id", F.col("fold_index").alias("assigned_fold"))
    return expand_folds(rows, fx.FOLDS, held_out_role()).drop("assigned_fold")

"""Queries on the composed evaluations: assemble, score, validate, prepare, materialise, report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.blending import fit_crossfit_alpha
from ..operators.keys import rows_in
from ..operators.aggregates import scored_problems
from ..plans.assembling import Evaluation, assemble, crossfit_report, score, score_written, write_assembly
from ..plans.comparing import comparator_report
from ..plans.packages import (
    package_violations,
    prepare_round_robin,
    prepare_shuffled,
    prepare_stratified,
    prepare_supplied,
)
from ..plans.units import assignment_fingerprint, materialise, nested_stages, stage_summary, unit_drift, unit_identity, verify_unit
from ..session import shared_folder, written
from . import query
from .joins import _FINGERPRINT
from .metrics import facts, facts_sql, metric_sql, round_metrics, rounded
from .splits import KFOLD_SQL, MELT_SQL, RESERVE_SQL, SPLIT_ROLES
from .views import with_views

COMPONENTS = ["descriptor_prediction", "neural_prediction"]
COLUMNS = [*COMPONENTS, "blend"]
_BOUND = "(select b.*, l.target from v_blend b join v_label l using (record_id))"
FLAGSHIP_SQL = with_views(" union all ".join(metric_sql(_BOUND, c, c) for c in COLUMNS))


def crossfit_blend(spark, d):
    """The flagship: weights cross-fitted over folds, then metrics of both components and the blend."""
    bound = fx.v_labelled(spark, d)
    return round_metrics(crossfit_report(bound, fit_crossfit_alpha(bound)))


@query("flagship_crossfit_blend", FLAGSHIP_SQL)
def flagship(spark, d):
    return crossfit_blend(spark, d)


def _scored(spark, d):
    return fx.v_pred(spark, d).select("record_id", "fold_index", *COMPONENTS)


def _coefficients(spark, d):
    rows = fx.v_coef(spark, d)
    return rows.drop("target"), rows.select("deployment_fold", "record_id", "target")


def _rounded_predictions(assembly, blend_decimals=6):
    """Components lie on a grid of nine decimals and stay there; the blend is rounded further."""
    return rounded(rounded(assembly.predictions.select("record_id", *COLUMNS), *COMPONENTS, decimals=9), "blend", decimals=blend_decimals)


@query(
    "l1_assemble_fixed_half",
    with_views("select record_id, round(descriptor_prediction,9) as descriptor_prediction, round(neural_prediction,9) as neural_prediction, round(5e-1*descriptor_prediction+5e-1*neural_prediction,10) as blend from v_pred"),
)
def l1_fixed(spark, d):
    return _rounded_predictions(assemble(Evaluation(fx.FOLDS, "fixed_half", "one_held_out"), _scored(spark, d)), 10)


@query(
    "l1_assemble_crossfit",
    with_views("select record_id, round(descriptor_prediction,9) as descriptor_prediction, round(neural_prediction,9) as neural_prediction, round(blend,6) as blend from v_blend"),
)
def l1_crossfit(spark, d):
    evaluation = Evaluation(fx.FOLDS, "crossfit", "one_held_out")
    return _rounded_predictions(assemble(evaluation, _scored(spark, d), *_coefficients(spark, d)))


# Split models score new records; their coefficient rows are other records, here with an "n" in front.
_SPLIT_SQL = """
with c as (select fold_index as deployment_fold, 'n'||s.record_id as record_id, s.descriptor_prediction, s.neural_prediction, l.target from v_splitpred s join v_label l using (record_id)),
a as (select {fold} as deployment_fold, sum((neural_prediction-descriptor_prediction)*(target-descriptor_prediction))/sum((neural_prediction-descriptor_prediction)*(neural_prediction-descriptor_prediction)) as alpha from c {where} group by 1)
select s.record_id, round(avg(descriptor_prediction),9) as descriptor_prediction, round(avg(neural_prediction),9) as neural_prediction,
  round(avg((1-least(1,greatest(0,alpha)))*descriptor_prediction+least(1,greatest(0,alpha))*neural_prediction),6) as blend
from v_splitpred s join a on {on} group by s.record_id"""


def _split_coefficients(spark, d, single):
    rows = fx.v_splitpred(spark, d).join(fx.v_label(spark, d).select("record_id", "target"), "record_id")
    if single:
        rows = rows.filter("fold_index = 0")
    renamed = rows.select(
        F.col("fold_index").alias("deployment_fold"), F.concat(F.lit("n"), "record_id").alias("record_id"), *COMPONENTS, "target"
    )
    return renamed.drop("target"), renamed.select("deployment_fold", "record_id", "target")


@query("l1_assemble_per_split", with_views(_SPLIT_SQL.format(fold="deployment_fold", where="", on="a.deployment_fold=s.fold_index").strip()))
def l1_split(spark, d):
    evaluation = Evaluation(fx.FOLDS, "per_split", "mean_over_splits")
    return _rounded_predictions(assemble(evaluation, fx.v_splitpred(spark, d), *_split_coefficients(spark, d, False)))


@query("l1_assemble_single_mean", with_views(_SPLIT_SQL.format(fold="0", where="where deployment_fold=0", on="true").strip()))
def l1_single(spark, d):
    evaluation = Evaluation(fx.FOLDS, "single", "mean_over_splits")
    return _rounded_predictions(assemble(evaluation, fx.v_splitpred(spark, d), *_split_coefficients(spark, d, True)))


@query(
    "l1_assemble_single_refit",
    with_views("""with a as (select least(1e0,greatest(0e0,sum((neural_prediction-descriptor_prediction)*(target-descriptor_prediction))/sum((neural_prediction-descriptor_prediction)*(neural_prediction-descriptor_prediction)))) as alpha from v_labelled)
      select record_id, round(descriptor_prediction,9) as descriptor_prediction, round(neural_prediction,9) as neural_prediction, round((1-alpha)*descriptor_prediction+alpha*neural_prediction,6) as blend from v_pred cross join a"""),
)
def l1_refit(spark, d):
    scored = _scored(spark, d).withColumn("fold_index", F.lit(0))
    source = fx.v_labelled(spark, d).select(
        F.lit(0).alias("deployment_fold"), F.concat(F.lit("n"), "record_id").alias("record_id"), *COMPONENTS, "target"
    )
    evaluation = Evaluation((0,), "single", "full_refit")
    labels = source.select("deployment_fold", "record_id", "target")
    return _rounded_predictions(assemble(evaluation, scored, source.drop("target"), labels))


@query(
    "l1_coefficients",
    with_views("select deployment_fold, round(alpha,6) as alpha, coefficient_rows from v_alpha"),
)
def l1_coefficients(spark, d):
    evaluation = Evaluation(fx.FOLDS, "crossfit", "one_held_out")
    return rounded(assemble(evaluation, _scored(spark, d), *_coefficients(spark, d)).coefficients, "alpha")


def _assembled(spark, d):
    evaluation = Evaluation(fx.FOLDS, "crossfit", "one_held_out")
    return assemble(evaluation, _scored(spark, d), *_coefficients(spark, d)).predictions


@query("l2_score_metrics", FLAGSHIP_SQL)
def l2(spark, d):
    labels = fx.v_label(spark, d).select("record_id", "target")
    return round_metrics(score(_assembled(spark, d), labels).metrics)


_BLENDED = "(select target, descriptor_prediction, neural_prediction, (1-alpha)*descriptor_prediction+alpha*neural_prediction as blend from v_labelled join v_alpha on fold_index=deployment_fold)"
_PAIRS = " union all ".join(
    f"select 'blend - {c}' as comparison, {20260821 + i} as s, target, blend as a, {c} as b from {_BLENDED}" for i, c in enumerate(COMPONENTS)
)


@query("l2_score_paired", with_views(facts_sql(_PAIRS, by="comparison", seed="min(s)")))
def l2_paired(spark, d):
    labels = fx.v_label(spark, d).select("record_id", "target")
    predictions = _assembled(spark, d)
    bound = predictions.join(labels, "record_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(f"blend - {c}").alias("comparison"), F.col(c).alias("b")) for c in COMPONENTS]))
    long = bound.select("target", F.col("blend").alias("a"), pairs.alias("p")).select("target", "a", "p.*")
    return facts(score(predictions, labels, seed=20260821).paired, long, "a", "b", by=["comparison"])


@query("l2_score_written", FLAGSHIP_SQL)
def l2_written(spark, d):
    """The assembly written with its manifest, proved against it, and scored."""
    evaluation = Evaluation(fx.FOLDS, "crossfit", "one_held_out")
    path = f"{shared_folder(spark)}/assembly-{uuid.uuid4().hex}"
    write_assembly(assemble(evaluation, _scored(spark, d), *_coefficients(spark, d)), fx.v_label(spark, d), path)
    return round_metrics(score_written(spark, path).metrics)


@query(
    "l1_scored_problems",
    with_views("""select record_id, count(*) as n, 'row_count' as problem from v_splitpred where not (fold_index=3 and H('q:'||record_id)%20=0)
      group by record_id having count(*)<>5"""),
)
def l1_problems(spark, d):
    from ..functions.hashing import hash32

    gone = (F.col("fold_index") == 3) & (hash32(F.concat(F.lit("q:"), F.col("record_id"))) % 20 == 0)
    return scored_problems(fx.v_splitpred(spark, d).filter(~gone), "mean_over_splits", fx.FOLDS, COMPONENTS)


@query(
    "l3_package_violations",
    with_views("""with lab as (select distinct cast(l_orderkey as varchar) as record_id from lineitem)
      select 'record:without_label' as rule, count(*) as n from v_label where record_id not in (select record_id from lab) having count(*)>0
      union all select 'scored:count', abs((select count(*) from v_label)-7)
      union all select 'fold:roles:'||cast(fold_index as varchar), 1 from v_fold"""),
)
def l3(spark, d):
    records = fx.v_label(spark, d).withColumn("structure", F.concat(F.lit("s"), "record_id"))
    labels = fx.v_feat(spark, d).select("record_id", F.col("ext").alias("target"))
    return package_violations(records, labels, fx.v_part(spark, d), fx.FOLDS, ["fit", "scored"], 7, "one_held_out")


@query(
    "l3_valid_package",
    with_views("select 'none' as rule, count(*) as n from v_label where record_id is null having count(*)>0"),
)
def l3_valid(spark, d):
    records = fx.v_label(spark, d).withColumn("structure", F.concat(F.lit("s"), "record_id"))
    return package_violations(
        records, fx.v_label(spark, d), fx.v_part(spark, d), fx.FOLDS, ["fit", "scored", "reserved"], None, "one_held_out"
    )


@query(
    "l4_prepare_shuffled",
    with_views(
        f"with k as ({KFOLD_SQL}), s as (select k.record_id, f.fold_index, case when k.assigned_fold=f.fold_index then 'scored' else 'fit' end as role from k cross join v_fold f) "
        + RESERVE_SQL.format(source="s").replace("11+fold_index", "7+fold_index")
    ),
)
def l4_shuffled(spark, d):
    return prepare_shuffled(fx.v_label(spark, d), 5, 7, 0.125)


@query(
    "l4_prepare_stratified",
    with_views("""with a as (select record_id, (row_number() over (order by bin, md5('13:'||record_id), record_id)-1)%5 as assigned from v_bin)
      select a.record_id, f.fold_index, case when a.assigned=f.fold_index then 'scored' else 'fit' end as role from a cross join v_fold f"""),
)
def l4_stratified(spark, d):
    return prepare_stratified(fx.v_label(spark, d), 5, 10, 13)


_ROUND_ROBIN_SQL = """
with a as (select record_id, bin, cast((row_number() over (partition by bin order by md5('13:'||record_id), record_id)-1)%5 as int) as assigned from v_bin),
x as (select a.record_id, a.bin, a.assigned, f.fold_index from a cross join v_fold f),
r as (select * from x where assigned<>fold_index),
c as (select fold_index, bin, count(*) as n from r group by 1,2), t as (select *, cast(sum(n) over (partition by fold_index) as bigint) as total from c),
w as (select *, (total*15+99)//100 as want from t), f as (select *, (want*n)//total as fl, (want*n)%total as rest from w),
o as (select *, row_number() over (partition by fold_index order by rest desc, bin) as turn, want-cast(sum(fl) over (partition by fold_index) as bigint) as open from f),
q as (select fold_index, bin, fl+case when turn<=open then 1 else 0 end as quota from o)
select record_id, fold_index, 'scored' as role from x where assigned=fold_index
union all
select r.record_id, r.fold_index, case when row_number() over (partition by r.fold_index, r.bin order by md5(cast(13+r.fold_index as varchar)||':'||r.record_id), r.record_id) <= q.quota then 'reserved' else 'fit' end
from r join q on q.fold_index=r.fold_index and q.bin=r.bin
union all
select 'c'||cast(c_custkey as varchar), f.fold_index, 'reserved' from customer cross join v_fold f"""


@query("l4_prepare_round_robin", with_views(_ROUND_ROBIN_SQL))
def l4_round_robin(spark, d):
    from ..session import read_table

    test = read_table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"))
    roles = {"fit": "fit", "selection": "reserved", "oof_holdout": "scored", "official_test": "reserved"}
    return prepare_round_robin(fx.v_label(spark, d), test, 5, 10, 13, 0.15, roles)


def _supplied(spark, d):
    rows = fx.v_widesplit(spark, d).join(fx.v_label(spark, d).select("record_id", "target"), "record_id")
    authors = rows_in(fx.v_label(spark, d), rows.filter("split1 = 'Test'")).select("record_id", F.round("target", 2).alias("target"))
    return prepare_supplied(rows, {f"split{i}": i for i in (1, 2, 3)}, SPLIT_ROLES, authors, 6e-3)


@query("l4_prepare_supplied", with_views(MELT_SQL))
def l4_supplied(spark, d):
    return _supplied(spark, d)[1]


@query("l4_supplied_labels", with_views("select record_id, round(case when split1='Test' then round(target,2) else target end,6) as target from v_widesplit join v_label using (record_id)"))
def l4_labels(spark, d):
    return rounded(_supplied(spark, d)[0], "target")


def _unit(spark, d, branch="encoder"):
    return materialise(fx.v_label(spark, d), fx.v_part(spark, d), "nested_holdout", branch, 2)


@query(
    "l5_materialise",
    with_views("""select case role when 'fit' then 'parameter_fit' when 'reserved' then 'selection_score' else 'scored_prediction' end as stage, p.record_id, l.ord,
      case when role='scored' then null else round(l.target,6) end as target from v_part p join v_label l using (record_id) where fold_index=2"""),
)
def l5(spark, d):
    stages = _unit(spark, d)
    verify_unit(stages, fx.v_label(spark, d))
    return rounded(stages.select("stage", "record_id", "ord", "target"), "target")


_UNIT_STAGE = "(select case role when 'fit' then 'parameter_fit' when 'reserved' then 'selection_score' else 'scored_prediction' end as stage, record_id from v_part where fold_index=2)"


@query("l5_stage_summary", with_views(_FINGERPRINT.format(by="stage,", b="stage,", line="record_id", table=_UNIT_STAGE, group="group by stage").strip()))
def l5_summary(spark, d):
    return stage_summary(_unit(spark, d))


@query("l5_assignment", with_views(_FINGERPRINT.format(by="", b="", line="stage||chr(9)||record_id", table=_UNIT_STAGE, group="").strip()))
def l5_assignment(spark, d):
    return assignment_fingerprint(_unit(spark, d))


@query(
    "l5_nested_stages",
    with_views("""select n.i as inner_fold, record_id, case when fold_index=n.i then 'selection_score' else 'selection_fit' end as stage
      from v_pred, (values (0), (1), (3), (4)) n(i) where fold_index<>2"""),
)
def l5_nested(spark, d):
    return nested_stages(fx.v_part(spark, d), 2)


_NESTED = """(select n.i as inner_fold, record_id, case when fold_index=n.i then 'selection_score' else 'selection_fit' end as stage
      from v_pred, (values (0), (1), (3), (4)) n(i) where fold_index<>2)"""
_IDENTITY = f"""with lines as materialized (select 'outer' as unit, stage as part, record_id as line from {_UNIT_STAGE}
  union all select 'outer', 'assignment', stage||chr(9)||record_id from {_UNIT_STAGE}
  union all select cast(inner_fold as varchar), stage, record_id from {_NESTED}
  union all select cast(inner_fold as varchar), 'assignment', stage||chr(9)||record_id from {_NESTED}),
""" + _FINGERPRINT.format(by="unit, part,", b="unit, part,", line="line", table="lines", group="group by unit, part").strip()[5:]


def _identity(spark, d):
    return unit_identity(_unit(spark, d), nested_stages(fx.v_part(spark, d), 2))


@query("l5_unit_identity", with_views(_IDENTITY))
def l5_identity(spark, d):
    return _identity(spark, d)


@query(
    "l5_unit_drift",
    "select * from (values ('outer', 'parameter_fit', 'digest'), ('3', 'selection_fit', 'rows'), ('4', 'selection_score', 'undeclared'), ('9', 'selection_fit', 'missing'), ('outer', 'overlap:parameter_fit', 'missing')) t(unit, part, status)",
)
def l5_drift(spark, d):
    """A declaration that is wrong in five places finds exactly these."""
    found = written(_identity(spark, d))  # a few rows, compared and declared
    at = lambda unit, part: (F.col("unit") == unit) & (F.col("part") == part)
    declared = found.where(~at("4", "selection_score")).withColumns(
        {
            "digest": F.when(at("outer", "parameter_fit"), F.sha2("digest", 256)).otherwise(F.col("digest")),
            "n": F.when(at("3", "selection_fit"), F.col("n") + 1).otherwise(F.col("n")),
        }
    )
    wrong = spark.createDataFrame([("9", "selection_fit", 5, "x"), ("outer", "overlap:parameter_fit", 2, ""), ("outer", "overlap:selection_score", 0, "")], found.schema)
    return unit_drift(found, declared.unionByName(wrong))


@query(
    "l6_comparator_report",
    with_views("""with r as (select * from v_ci where not (model=1 and substr(panel,1,1) in ('2','4'))),
      e as (select r.*, p.rmse from r join v_report p using (panel, model)),
      t as (select panel, case when max(ci99_high)<0 then '***' when max(ci95_high)<0 then '**' else '' end as tier from e group by panel),
      g as (select m.model, p.panel from (select distinct model from v_report) m cross join (select distinct panel from v_report) p)
      select g.model, g.panel, e.n, round(e.rmse,6) as rmse, round(e.delta,6) as delta, e.n is not null as available,
        coalesce(abs(e.rmse-min(e.rmse) over (partition by g.panel))<=1e-12,false) as is_lowest, t.tier, coalesce(printf('%.3f',e.rmse),'') as display
      from g left join e on e.model=g.model and e.panel=g.panel join t on t.panel=g.panel"""),
)
def l6(spark, d):
    report, ci = fx.v_report(spark, d), fx.v_ci(spark, d)
    results = ci.filter(~((F.col("model") == 1) & F.substring("panel", 1, 1).isin("2", "4")))
    results = results.join(report.select("panel", "model", "rmse"), ["panel", "model"])
    table = comparator_report(report, report, results)
    return rounded(
        table.select("model", "panel", "n", "rmse", "delta", "available", "is_lowest", "tier", "display"), "rmse", "delta"
    )

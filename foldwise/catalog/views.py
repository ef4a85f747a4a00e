"""SQL text of the fixture views, and a builder that puts the needed ones in front of a query.

``H(x)`` stands for the first 32 bits of the MD5 of a text. Fractions are exponent literals, because a
plain ``0.8`` is a decimal.
"""

from __future__ import annotations

import re

VIEWS = {
    "v_label": "select cast(o_orderkey as varchar) as record_id, o_orderkey as ord, ln(o_totalprice) as target from orders",
    "v_pred": """
select record_id, ord, cast(H('f:'||record_id)%5 as int) as fold_index,
       round(target+8e-1*(H('d:'||record_id)/4294967296e0-5e-1),9) as descriptor_prediction,
       round(target+5e-1*(H('n:'||record_id)/4294967296e0-5e-1)+1e-1,9) as neural_prediction from v_label""",
    "v_labelled": "select p.*, l.target from v_pred p join v_label l using (record_id)",
    "v_fold": "select cast(unnest([0, 1, 2, 3, 4]) as int) as fold_index",
    "v_coef": """
select f.fold_index as deployment_fold, p.record_id, p.descriptor_prediction, p.neural_prediction, l.target
from v_pred p join v_label l on p.record_id=l.record_id join v_fold f on p.fold_index<>f.fold_index""",
    "v_splitpred": """
select p.record_id, f.fold_index, p.descriptor_prediction+1e-2*f.fold_index as descriptor_prediction,
       p.neural_prediction-1e-2*f.fold_index as neural_prediction from v_pred p cross join v_fold f""",
    "v_part": """
select p.record_id, f.fold_index, case when p.fold_index=f.fold_index then 'scored'
       when H('r:'||cast(f.fold_index as varchar)||':'||p.record_id)%8=0 then 'reserved' else 'fit' end as role
from v_pred p cross join v_fold f""",
    "v_stage": """
select (case role when 'fit' then 'parameter_fit' when 'reserved' then 'selection_score' else 'scored_prediction' end)
       ||':'||cast(fold_index as varchar) as stage, record_id from v_part""",
    "v_widesplit": """
select record_id, case when H('t:'||record_id)%10=0 then 'Test' when H('w1:'||record_id)%5=0 then 'Val' else 'Train' end as split1,
       case when H('t:'||record_id)%10=0 then 'Test' when H('w2:'||record_id)%5=0 then 'Val' else 'Train' end as split2,
       case when H('t:'||record_id)%10=0 then 'Test' when H('w3:'||record_id)%5=0 then 'Val' else 'Train' end as split3 from v_label""",
    "v_feat": """
select cast(l_orderkey as varchar) as record_id, cast(count(*) as double) as n_lines, sum(l_quantity) as qty,
       round(sum(l_extendedprice),6) as ext, round(sum(l_extendedprice*(1-l_discount)),6) as rev,
       round(avg(l_extendedprice),6) as avg_ext, max(l_tax) as max_tax, 1e0 as const_one, 1e-8*(l_orderkey%2) as tiny,
       case when H('g:'||cast(l_orderkey as varchar))%50=0 then null else max(l_discount) end as gap
from lineitem group by l_orderkey""",
    "v_emb": "select cast(vec_id as varchar) as record_id, label, vec_id as ord, embedding from embeddings",
    "v_members": """
select l.record_id, f.fold_index as member,
       round(l.target+3e-1*(H('m'||cast(f.fold_index as varchar)||':'||l.record_id)/4294967296e0-5e-1),9) as prediction
from v_label l cross join v_fold f where f.fold_index<4""",
    "v_trials": """
select t.fold_index as trial, p.fold_index as inner_validation_fold, count(*) as n,
       round(sum(power(p.descriptor_prediction+2e-1*t.fold_index*(p.neural_prediction-p.descriptor_prediction)-l.target,2)),9) as sse,
       round(sqrt(avg(power(p.descriptor_prediction+2e-1*t.fold_index*(p.neural_prediction-p.descriptor_prediction)-l.target,2))),9) as rmse,
       round(avg(abs(p.descriptor_prediction+2e-1*t.fold_index*(p.neural_prediction-p.descriptor_prediction)-l.target)),9) as mae,
       10+H('b:'||cast(t.fold_index as varchar)||':'||cast(p.fold_index as varchar))%40 as best_iteration
from v_pred p join v_label l on p.record_id=l.record_id cross join v_fold t group by t.fold_index, p.fold_index""",
    "v_usage": """
select event_id, case H('u:'||cast(event_id as varchar))%3 when 0 then 'model_development' when 1 then 'coefficient_development' else 'scored' end as role,
       case event_type when 'click' then 'preprocessing' when 'error' then 'hyperparameter_selection' when 'purchase' then 'model_fitting'
            when 'signup' then 'coefficient_fitting' else 'scoring' end as operation from events""",
    "v_manifest": """
select s_name as path, case when H('x:'||cast(s_suppkey as varchar))%10=0 then 'ZZ' else md5(s_name)||md5(cast(s_suppkey as varchar)) end as sha256,
       s_suppkey as bytes, case when s_suppkey%7=0 then '2024-13-01' else '2024-01-15' end as retrieval_date from supplier""",
    "v_report": """
select o.o_orderpriority as panel, m.fold_index as model, count(*) as n, round(sqrt(avg(power(mm.prediction-l.target,2))),9) as rmse,
       round(sqrt(avg(power(p.neural_prediction-l.target,2)))-sqrt(avg(power(mm.prediction-l.target,2))),9) as delta
from v_members mm join v_fold m on mm.member=m.fold_index join v_label l on mm.record_id=l.record_id
join v_pred p on p.record_id=l.record_id join orders o on cast(o.o_orderkey as varchar)=l.record_id
group by o.o_orderpriority, m.fold_index""",
    "v_ci": """
select panel, model, n, -delta as delta, -delta-2e-2*cast(substr(panel,1,1) as int) as ci95_low,
       -delta+2e-2*cast(substr(panel,1,1) as int) as ci95_high, -delta-26e-3*cast(substr(panel,1,1) as int) as ci99_low,
       -delta+26e-3*cast(substr(panel,1,1) as int) as ci99_high from v_report""",
    # cross-fitted weight: all rows of the other folds
    "v_alpha": """
select deployment_fold, least(1e0, greatest(0e0,
       sum((neural_prediction-descriptor_prediction)*(target-descriptor_prediction))
       / sum((neural_prediction-descriptor_prediction)*(neural_prediction-descriptor_prediction)))) as alpha,
       count(*) as coefficient_rows from v_coef group by deployment_fold""",
    "v_blend": """
select p.record_id, p.fold_index, p.descriptor_prediction, p.neural_prediction,
       (1-a.alpha)*p.descriptor_prediction+a.alpha*p.neural_prediction as blend
from v_pred p join v_alpha a on a.deployment_fold=p.fold_index""",
    # quantile bins of the target, 10 bins
    "v_edges": """
select list_sort(list_distinct(list_transform(quantile_cont(target,
       [0e0,1e-1,2e-1,3e-1,4e-1,5e-1,6e-1,7e-1,8e-1,9e-1,1e0]), lambda x: round(x,9)))) as edges from v_label""",
    "v_bin": """
select record_id, target, cast(least(len(edges)-2, greatest(0, len(list_filter(edges, lambda e: e<target))-1)) as int) as bin
from v_label cross join v_edges""",
}


def expand_hash(text: str) -> str:
    """Write out every H(...)."""
    while (found := re.search(r"\bH\(", text)) is not None:
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[found.end() : end - 1]
        text = f"{text[:found.start()]}cast('0x'||substr(md5({inner}),1,8) as bigint){text[end:]}"
    return text


def with_views(body: str) -> str:
    """The query with the fixture views it uses, in dependency order, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    if not needed:
        return expand_hash(body)
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n].strip()})" for n in needed)
    if body.lower().startswith("with "):
        return expand_hash(f"with {ctes},\n{body[5:]}")
    return expand_hash(f"with {ctes}\n{body}")

"""Queries on row, key and registry checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.hashing import hash32
from ..operators.checks import (
    attribute_conflicts,
    audit_label_use,
    classify_roles,
    clean_text,
    conformance,
    domain_violations,
    ensure_label_free,
    finite_violations,
    format_violations,
    key_violations,
    prediction_violations,
    require_columns,
    require_finite,
    result_violations,
    role_problems,
    scan_patterns,
    sequence_violations,
    split_usable,
    text_violations,
    validate_predictions,
)
from ..operators.splits import role_counts
from ..session import read_table
from . import query
from .views import with_views

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "secret": r"(?i)(api[_-]?key|access[_-]?token|secret|password|token)",
    "license": r"(?i)licen[cs]e",
}


@query("b1_clean_text", "select doc_id, length(trim(text, ' \t\n\r')) as n_chars, md5(trim(lang, ' \t\n\r')) as lang_md5 from documents".replace("\\t", "\t"))
def b1(spark, d):
    docs = clean_text(read_table(spark, d, "documents"), ["text", "lang"])
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("lang").alias("lang_md5"))


@query(
    "b1_text_violations",
    """select page_id, 'tail:empty' as problem from (select page_id, trim(regexp_extract(url, 'ref=(.*)$', 1)) as tail from pages)
       where coalesce(length(tail),0)=0""",
)
def b1_violations(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", F.regexp_extract("url", "ref=(.*)$", 1).alias("tail"))
    return text_violations(pages, ["page_id"], ["tail"])


_B2_SQL = """
select record_id, 'value:missing' as problem from (select record_id, case when ord%97=0 then null when ord%89=0 then 'NaN'
  when ord%83=0 then 'none' when ord%79=0 then '-Infinity' else cast(target as varchar) end as value from v_label) x
where value is null or value in ('NaN','none')
union all
select record_id, 'value:infinite' from (select record_id, case when ord%97=0 then null when ord%89=0 then 'NaN'
  when ord%83=0 then 'none' when ord%79=0 then '-Infinity' else cast(target as varchar) end as value from v_label) x
where value = '-Infinity'"""


@query("b2_finite_violations", with_views(_B2_SQL))
def b2(spark, d):
    key = F.col("ord")
    value = (
        F.when(key % 97 == 0, F.lit(None))
        .when(key % 89 == 0, F.lit("NaN"))
        .when(key % 83 == 0, F.lit("none"))
        .when(key % 79 == 0, F.lit("-Infinity"))
        .otherwise(F.col("target").cast("string"))
    )
    return finite_violations(fx.v_label(spark, d).withColumn("value", value), ["record_id"], ["value"])


@query("b2_require_finite", with_views("select record_id, round(target,6) as target from v_label"))
def b2_require(spark, d):
    text = fx.v_label(spark, d).withColumn("target", F.col("target").cast("string"))
    return require_finite(text, ["target"], ["record_id"]).select("record_id", F.round("target", 6).alias("target"))


@query(
    "b3_split_usable",
    with_views("select record_id, case when gap is not null and qty>2e1 then 'usable' else 'rejected' end as side from v_feat"),
)
def b3(spark, d):
    features = fx.v_feat(spark, d).select("record_id", "gap", "qty")
    usable, rejected = split_usable(features, F.col("gap").isNotNull() & (F.col("qty") > 20))
    return usable.select("record_id", F.lit("usable").alias("side")).unionByName(
        rejected.select("record_id", F.lit("rejected").alias("side"))
    )


@query("b4_label_free", with_views("select record_id, fold_index, neural_prediction from v_pred"))
def b4(spark, d):
    rows = fx.v_pred(spark, d)
    ensure_label_free(rows, fold_case=True)
    return rows.select("record_id", "fold_index", "neural_prediction")


@query(
    "b5_label_use",
    with_views("""select event_id, role, operation from v_usage where (role, operation) not in (
      ('model_development','preprocessing'),('model_development','hyperparameter_selection'),('model_development','model_fitting'),
      ('model_development','coefficient_fitting'),('model_development','scoring'),('coefficient_development','coefficient_fitting'),
      ('coefficient_development','scoring'),('scored','scoring'))"""),
)
def b5(spark, d):
    return audit_label_use(fx.v_usage(spark, d))


@query(
    "b6_require_columns",
    with_views("select record_id, fold_index, descriptor_prediction, neural_prediction from v_pred"),
)
def b6(spark, d):
    rows = fx.v_pred(spark, d).drop("ord")
    return require_columns(rows, ["record_id", "fold_index", "descriptor_prediction", "neural_prediction"])


@query(
    "b7_key_violations",
    """select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, count(*) as n, 'duplicate' as problem
       from lineitem group by 1,2 having count(*)>1""",
)
def b7(spark, d):
    return key_violations(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "b7_unique_keys",
    "select cast(o_orderkey as varchar) as o_orderkey, count(*) as n, 'duplicate' as problem from orders group by 1 having count(*)>1",
)
def b7_unique(spark, d):
    return key_violations(read_table(spark, d, "orders"), ["o_orderkey"])


@query("b8_domain", with_views("select role, count(*) as n from v_part where role not in ('fit','scored') group by role"))
def b8(spark, d):
    return domain_violations(fx.v_part(spark, d), "role", ["fit", "scored"])


_ROLE_MAP = {"fit": ["Train"], "coefficient": ["Val"], "scored": ["Test"], "reserved": []}


@query(
    "b9_classify_roles",
    with_views("select record_id, case split1 when 'Train' then 'fit' when 'Val' then 'coefficient' when 'Test' then 'scored' end as role from v_widesplit"),
)
def b9(spark, d):
    return classify_roles(fx.v_widesplit(spark, d), "split1", _ROLE_MAP).select("record_id", "role")


@query(
    "b9_role_problems",
    with_views("select 'undeclared' as problem, count(*) as n from v_widesplit where split2='Val' having count(*)>0"),
)
def b9_problems(spark, d):
    classified = classify_roles(fx.v_widesplit(spark, d), "split2", {"fit": ["Train"], "scored": ["Test"]})
    return role_problems(classified)


@query(
    "b10_attribute_conflicts",
    """select sha256(text) as text_sha256, min(source) as low, max(source) as high, count(*) as n from documents
       group by text having min(source)<>max(source)""",
)
def b10(spark, d):
    docs = read_table(spark, d, "documents")
    return attribute_conflicts(docs, F.sha2("text", 256), "source", "text_sha256")


@query(
    "b11_format_violations",
    with_views("""select path, 'sha256:sha256' as problem from v_manifest where not regexp_matches(sha256,'^[0-9a-f]{64}$')
      union all select path, 'retrieval_date:iso_date' from v_manifest where try_strptime(retrieval_date,'%Y-%m-%d') is null
      union all select path, 'bytes:positive' from v_manifest where bytes<=0"""),
)
def b11(spark, d):
    rules = {"sha256": "sha256", "retrieval_date": "iso_date", "bytes": "positive", "path": "relative_path"}
    return format_violations(fx.v_manifest(spark, d), ["path"], rules)


@query(
    "b12_sequence",
    """select conv_id, count(*) as n, count(distinct turn) as n_distinct, min(turn) as low, max(turn) as high from conversations
       group by conv_id having not (count(*)=count(distinct turn) and min(turn)=0 and max(turn)=count(*)-1)""",
)
def b12(spark, d):
    return sequence_violations(read_table(spark, d, "conversations"), ["conv_id"], "turn", first=0)


@query(
    "b12_sequence_gaps",
    """select l_orderkey, count(*) as n, count(distinct l_linenumber) as n_distinct, min(l_linenumber) as low, max(l_linenumber) as high
       from lineitem group by l_orderkey
       having not (count(*)=count(distinct l_linenumber) and min(l_linenumber)=1 and max(l_linenumber)=count(*))""",
)
def b12_gaps(spark, d):
    return sequence_violations(read_table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", first=1)


@query(
    "b13_scan_patterns",
    " union all ".join(
        f"select doc_id, '{n}' as rule from documents where regexp_matches(text, '{p}')" for n, p in PATTERNS.items()
    ),
)
def b13(spark, d):
    return scan_patterns(read_table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", PATTERNS)


@query(
    "b14_result_violations",
    with_views("""with c as (select *, case when model=1 then ci99_low+1e0 else ci95_low end as low95, delta+case when model=2 then 1e-6 else 0e0 end as shifted from v_ci)
      select panel, model, 'ci95:order' as problem from c where low95>ci95_high
      union all select panel, model, 'ci95:outside_ci99' from c where low95<ci99_low or ci95_high>ci99_high
      union all select panel, model, 'difference' from c where abs(delta-0e0-shifted)>1e-12"""),
)
def b14(spark, d):
    ci = fx.v_ci(spark, d).withColumns(
        {
            "low95": F.when(F.col("model") == 1, F.col("ci99_low") + 1.0).otherwise(F.col("ci95_low")),
            "shifted": F.col("delta") + F.when(F.col("model") == 2, F.lit(1e-6)).otherwise(F.lit(0.0)),
            "zero": F.lit(0.0),
        }
    )
    return result_violations(ci, ["panel", "model"], low95="low95", difference=("delta", "zero", "shifted"))


@query(
    "c17_conformance",
    with_views("""with o as (select fold_index, count(*) filter (role='fit') as fit, count(*) filter (role='reserved') as reserved, count(*) filter (role='scored') as scored from v_part group by fold_index),
      e as (select case when fold_index=4 then 9 else fold_index end as fold_index, fit + case when fold_index=2 then 1 else 0 end as fit, scored from o)
      select coalesce(e.fold_index,o.fold_index) as fold_index,
        case when o.fold_index is null then 'missing' when e.fold_index is null then 'extra' else 'changed' end as status,
        e.fit as expected_fit, e.scored as expected_scored, o.fit as observed_fit, o.scored as observed_scored
      from e full join o on e.fold_index=o.fold_index
      where o.fold_index is null or e.fold_index is null or e.fit<>o.fit or e.scored<>o.scored"""),
)
def c17(spark, d):
    observed = role_counts(fx.v_part(spark, d), ["fit", "reserved", "scored"])
    expected = observed.select(
        F.when(F.col("fold_index") == 4, F.lit(9)).otherwise(F.col("fold_index")).alias("fold_index"),
        (F.col("fit") + F.when(F.col("fold_index") == 2, F.lit(1)).otherwise(F.lit(0))).alias("fit"),
        "scored",
    )
    return conformance(expected, observed, ["fold_index"], ["fit", "scored"])


@query(
    "k7_prediction_violations",
    with_views("""with t as (select case when ord%101=0 then cast(ord+1 as varchar) else record_id end as record_id,
        case when ord%103=0 then null else neural_prediction end as prediction from v_pred)
      select 'duplicate_key' as problem, count(*) as n from (select record_id from t group by record_id having count(*)>1)
      union all select 'not_finite', count(*) from t where prediction is null
      union all select 'row_count', count(*) from t"""),
)
def k7(spark, d):
    key = F.col("ord")
    rows = fx.v_pred(spark, d).select(
        F.when(key % 101 == 0, (key + 1).cast("string")).otherwise(F.col("record_id")).alias("record_id"),
        F.when(key % 103 != 0, F.col("neural_prediction")).alias("prediction"),
    )
    return prediction_violations(rows, expected_rows=1)


@query("k7_validate_predictions", with_views("select record_id, descriptor_prediction as prediction from v_pred"))
def k7_valid(spark, d):
    rows = fx.v_pred(spark, d).select("record_id", F.col("descriptor_prediction").alias("prediction"))
    return validate_predictions(rows, fx.v_label(spark, d).count())


@query(
    "b11_hash_domain",
    with_views("select H('u:'||cast(event_id as varchar))%3 as bucket, count(*) as n from events group by 1"),
)
def hash_domain(spark, d):
    events = read_table(spark, d, "events")
    bucket = hash32(F.concat(F.lit("u:"), F.col("event_id").cast("string"))) % 3
    return events.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

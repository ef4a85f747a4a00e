"""Queries on feature statistics, filters, scalers, vectors and proximity edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.hashing import hash32
from ..functions.numbers import clip, one_hot, safe_float
from ..functions.vectors import concat_blocks, distance, fit_length, l2_normalise, radial_basis
from ..operators.features import (
    FilterConfig,
    apply_block_scaler,
    apply_feature_filter,
    apply_pca_blocks,
    corr_pairs,
    fallback_vector,
    fill_failed,
    fit_block_scaler,
    fit_clip_zscore,
    fit_feature_filter,
    fit_pca_model,
    fit_scaler,
    fit_zscore,
    profile_columns,
    quantile_limits,
    vector_columns,
)
from ..operators.proximity import close_pairs, proximity_edges
from ..plans.units import prepare_unit
from ..session import read_table
from . import query
from .metrics import rounded
from .views import with_views

FILLED = ["n_lines", "qty", "ext", "rev", "avg_ext", "max_tax"]
SURVIVORS = ["n_lines", "qty", "ext", "rev", "avg_ext", "max_tax"]
CONFIG = FilterConfig(1e-12, 0, 0.95, "gt")


def _fit(df):
    return df.filter("fold_index <> 0")


def _features(spark, d):
    """Features with the fold of their record: fold 0 is scored, the others are fit rows."""
    folds = fx.v_pred(spark, d).select("record_id", "fold_index")
    return fx.v_feat(spark, d).join(folds, "record_id")


_FIT_CTE = "with x as (select f.*, p.fold_index from v_feat f join v_pred p using (record_id)), fit as (select * from x where fold_index<>0)"


def _profile_sql(column, position):
    return (
        f"select cast({position} as int) as position, '{column}' as column_name, count(*) as rows, count(*)-count({column}) as missing, "
        f"coalesce(min({column})=max({column}),true) and (count({column})=count(*) or count({column})=0) as constant, "
        f"round(var_pop({column}),4) as variance from v_feat"
    )


@query("d10_profile_columns", with_views(" union all ".join(_profile_sql(c, i) for i, c in enumerate(fx.FEATURES))))
def d10(spark, d):
    profile = profile_columns(fx.v_feat(spark, d), fx.FEATURES, ddof=0)
    return profile.withColumn("variance", F.round("variance", 4)).withColumnRenamed("column", "column_name")


_PAIRS = [(SURVIVORS[i], SURVIVORS[j]) for j in range(len(SURVIVORS)) for i in range(j)]


@query(
    "d11_corr_pairs",
    with_views(" union all ".join(f"select '{a}' as earlier, '{b}' as later, round(abs(corr({a},{b})),6) as correlation from v_feat" for a, b in _PAIRS)),
)
def d11(spark, d):
    pairs = corr_pairs(fx.v_feat(spark, d), SURVIVORS)
    return pairs.select("earlier", "later", F.round("correlation", 6).alias("correlation"))


@query("d11_corr_matrix", with_views(" union all ".join(f"select '{a}' as earlier, '{b}' as later, round(abs(corr({a},{b})),6) as correlation from v_feat" for a, b in _PAIRS)))
def d11_matrix(spark, d):
    """The matrix form of the same, used for wide tables: here with repeated columns to pass its limit."""
    features = fx.v_feat(spark, d)
    wide = SURVIVORS + [f"{c}_{k}" for k in range(3) for c in SURVIVORS]
    for k in range(3):
        features = features.withColumns({f"{c}_{k}": F.col(c) for c in SURVIVORS})
    pairs = corr_pairs(features, wide).filter(F.col("later").isin(SURVIVORS) & F.col("earlier").isin(SURVIVORS))
    return pairs.select("earlier", "later", F.round("correlation", 6).alias("correlation"))


@query(
    "d12_quantile_limits",
    with_views(_FIT_CTE + " " + " union all ".join(f"select '{c}' as column_name, round(quantile_cont({c},1e-2),6) as low, round(quantile_cont({c},99e-2),6) as high from fit" for c in FILLED)),
)
def d12(spark, d):
    limits = quantile_limits(_fit(_features(spark, d)), FILLED, 0.01)
    rows = [(c, round(low, 6), round(high, 6)) for c, (low, high) in limits.items()]
    return spark.createDataFrame(rows, "column_name string, low double, high double")


@query(
    "d13_fit_scaler",
    with_views(_FIT_CTE + " " + " union all ".join(f"select '{c}' as column_name, round(avg({c}),6) as mean, round(case when stddev_pop({c})=0 then 1e0 else stddev_pop({c}) end,6) as scale from fit" for c in [*FILLED, 'const_one'])),
)
def d13(spark, d):
    scaler = fit_scaler(_fit(_features(spark, d)), [*FILLED, "const_one"], ddof=0)
    rows = [(c, round(m, 6), round(s, 6)) for c, m, s in zip(scaler.columns, scaler.means, scaler.scales)]
    return spark.createDataFrame(rows, "column_name string, mean double, scale double")


# The statuses follow from the rules: gap has missing values, const_one is constant, tiny has almost no
# variance, and a column goes when an earlier survivor correlates with it.
FILTER_SQL = """
with c as (""" + " union all ".join(
    f"select {i} as position, '{c}' as column_name, count(*)-count({c}) as missing, min({c})=max({c}) as constant, var_pop({c}) as variance from v_feat"
    for i, c in enumerate(fx.FEATURES)
) + """), s as (select *, case when missing>0 then 'missing' when constant then 'constant' when variance<=1e-12 then 'low_variance' end as early from c),
r as (""" + " union all ".join(
    f"select '{fx.FEATURES[i]}' as earlier, '{fx.FEATURES[j]}' as later, abs(corr({fx.FEATURES[i]},{fx.FEATURES[j]})) as r from v_feat"
    for j in range(len(fx.FEATURES)) for i in range(j)
    if "const_one" not in (fx.FEATURES[i], fx.FEATURES[j])
) + """)
select cast(position as int) as position, column_name, coalesce(early, case when exists (select 1 from r join s e on e.column_name=r.earlier
   where r.later=s.column_name and e.early is null and r.r>95e-2) then 'correlated' else 'retained' end) as status from s"""


@query("j1_feature_filter", with_views(FILTER_SQL))
def j1(spark, d):
    fitted = fit_feature_filter(fx.v_feat(spark, d), fx.FEATURES, CONFIG)
    return fitted.report(spark).withColumnRenamed("column", "column_name")


@query(
    "j2_correlated_columns",
    with_views("select later from (" + " union all ".join(f"select '{b}' as later, abs(corr({a},{b})) as r from v_feat" for a, b in _PAIRS) + ") where r>=5e-1 group by later"),
)
def j2(spark, d):
    fitted = fit_feature_filter(fx.v_feat(spark, d), SURVIVORS, FilterConfig(1e-12, 1, 0.5, "ge"))
    dropped = fitted.report(spark).filter("status = 'correlated'")
    return dropped.select(F.col("column").alias("later"))


@query("j3_apply_filter", with_views("select record_id, n_lines, qty, ext, avg_ext, max_tax from v_feat"))
def j3(spark, d):
    features = fx.v_feat(spark, d)
    applied = apply_feature_filter(features, fit_feature_filter(features, fx.FEATURES, CONFIG))
    return applied.select("record_id", "n_lines", "qty", "ext", "avg_ext", "max_tax")


@query(
    "j4_prepare_unit",
    with_views("""select p.record_id, case when p.fold_index=0 then 'scored' when p.fold_index=1 then 'selection' else 'fit' end as role, f.n_lines, f.qty, f.ext, f.avg_ext, f.max_tax,
        case when p.fold_index=0 then null else round(l.target,6) end as target
      from v_pred p join v_feat f using (record_id) join v_label l using (record_id)"""),
)
def j4(spark, d):
    features = fx.v_feat(spark, d)
    roles = fx.v_pred(spark, d).join(features.select("record_id"), "record_id", "left_semi")
    role = F.when(F.col("fold_index") == 0, F.lit("scored")).when(F.col("fold_index") == 1, F.lit("selection")).otherwise(F.lit("fit"))
    unit = prepare_unit(features, roles.select("record_id", role.alias("role")), fx.v_label(spark, d), fx.FEATURES, CONFIG)
    return rounded(unit.rows, "target").select(
        "record_id", "role", "n_lines", "qty", "ext", "avg_ext", "max_tax", "target"
    )


def _scaled_sql(quantile, columns, ddof="pop", digits=5, names=None):
    names = names or columns
    limits = ", ".join(f"quantile_cont({c},{quantile}) as {c}_l, quantile_cont({c},1e0-{quantile}) as {c}_h" for c in columns)
    clipped = ", ".join(f"least(greatest(x.{c},q.{c}_l),q.{c}_h) as {c}" for c in columns)
    stats = ", ".join(f"avg({c}) as {c}_m, stddev_{ddof}({c}) as {c}_s" for c in columns)
    out = ", ".join(f"round((k.{c}-s.{c}_m)/s.{c}_s,{digits}) as {n}" for c, n in zip(columns, names))
    return (
        f"{_FIT_CTE}, q as (select {limits} from fit), k as (select x.record_id, x.fold_index, {clipped} from x cross join q), "
        f"s as (select {stats} from k where fold_index<>0) select k.record_id, {out} from k cross join s"
    )


@query("j5_block_scaler", with_views(_scaled_sql("1e-3", FILLED, names=[f"f{i}" for i in range(len(FILLED))])))
def j5(spark, d):
    rows = _features(spark, d)
    scalers = fit_block_scaler(_fit(rows), [FILLED[:3], FILLED[3:]], 0.001)
    scaled = apply_block_scaler(rows, scalers)
    return scaled.select("record_id", *[F.round(F.element_at("features", i + 1), 5).alias(f"f{i}") for i in range(len(FILLED))])


@query("j6_clip_zscore", with_views(_scaled_sql("1e-3", FILLED)))
def j6(spark, d):
    rows = _features(spark, d)
    scaled = fit_clip_zscore(_fit(rows), FILLED, 0.001).apply(rows)
    return rounded(scaled.select("record_id", *FILLED), *FILLED, decimals=5)


@query(
    "j7_zscore",
    with_views(_FIT_CTE + ", s as (select " + ", ".join(f"avg({c}) as {c}_m, stddev_samp({c}) as {c}_s" for c in FILLED) + " from fit) select x.record_id, " + ", ".join(f"round((x.{c}-s.{c}_m)/s.{c}_s,5) as {c}" for c in FILLED) + " from x cross join s"),
)
def j7(spark, d):
    rows = _features(spark, d)
    scaled = fit_zscore(_fit(rows), FILLED, ddof=1).apply(rows)
    return rounded(scaled.select("record_id", *FILLED), *FILLED, decimals=5)


@query(
    "i2_clip",
    with_views("select record_id, least(greatest(qty,2e1),8e1) as qty, least(greatest(gap,2e-2),6e-2) as gap from v_feat".replace("least(greatest(gap,2e-2),6e-2)", "case when gap is null then null else least(greatest(gap,2e-2),6e-2) end")),
)
def i2(spark, d):
    return fx.v_feat(spark, d).select("record_id", clip("qty", 20, 80).alias("qty"), clip("gap", 0.02, 0.06).alias("gap"))


_FAILED_SQL = """
with x as (select record_id, ord, H('k:'||record_id)%10=0 as failed, list_transform(embedding, lambda e: e::double) as v from v_emb),
p as (select unnest(v) as value, generate_subscripts(v,1) as i from x where not failed),
m as (select i, avg(value) as value from p group by i), mv as (select list(value order by i) as v from m)
select record_id, failed, round((case when failed then mv.v else x.v end)[1],6) as first_value,
       round(list_sum(case when failed then mv.v else x.v end),5) as total from x cross join mv"""


@query("j8_fill_failed", with_views(_FAILED_SQL))
def j8(spark, d):
    failed = hash32(F.concat(F.lit("k:"), F.col("record_id"))) % 10 == 0
    rows = fx.v_emb(spark, d).withColumn("failed", failed)
    broken = rows.withColumn("embedding", F.when(F.col("failed"), F.lit(None)).otherwise(F.col("embedding")))
    mean = fallback_vector(broken, ~F.col("failed"))
    filled = fill_failed(broken, mean)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return filled.select(
        "record_id", "failed", F.round(F.element_at("embedding", 1), 6).alias("first_value"), F.round(total, 5).alias("total")
    )


@query("j9_pca_block")
def j9(spark, d):
    rows, names = vector_columns(fx.v_emb(spark, d), "embedding", 64)
    fit = rows.filter("label <> 0")
    models = [fit_pca_model(fit, names[:32], 24), fit_pca_model(fit, names[32:], 24)]
    return apply_pca_blocks(rows, models, 24)


@query(
    "j9_pca_angles",
    with_views("""with x as (select record_id, label, unnest(embedding)::double as e, generate_subscripts(embedding,1) as i from v_emb),
      s as (select i, avg(e) as m, stddev_pop(e) as sd from x where label<>0 group by i),
      z as (select record_id, x.i, (e-m)/sd as z from x join s on s.i=x.i),
      n as (select record_id, i<=32 as front, sqrt(sum(z*z)) as length from z group by 1, 2),
      u as (select z.record_id, i, z/length as u from z join n on n.record_id=z.record_id and n.front=(z.i<=32)),
      r as (select i, u from u where record_id=(select min_by(record_id, ord) from v_emb))
      select u.record_id, round(sum(u.u*r.u)/2,5)+0e0 as similarity from u join r on r.i=u.i group by 1"""),
)
def j9_angles(spark, d):
    """All components only turn the scaled blocks, so angles between records are those of the scaled values themselves."""
    nodes = fx.v_emb(spark, d)
    rows, names = vector_columns(nodes, "embedding", 64)
    fit = rows.filter("label <> 0")
    turned = apply_pca_blocks(rows, [fit_pca_model(fit, names[:32], 32), fit_pca_model(fit, names[32:], 32)], 32)
    first = nodes.agg(F.min_by("record_id", "ord").alias("record_id"))
    reference = turned.join(first, "record_id").select("features").scalar()
    product = F.aggregate(F.zip_with("features", "reference", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    return turned.withColumn("reference", reference).select("record_id", (F.round(product, 5) + 0.0).alias("similarity"))


def _list_sql(expression):
    return with_views(
        f"with x as (select record_id, list_transform(embedding, lambda e: e::double) as v from v_emb), y as (select record_id, {expression} as w from x) "
        "select record_id, len(w) as dimension, round(w[1],6) as first_value, round(w[len(w)],6) as last_value, round(list_sum(w),5) as total from y"
    )


def _list_summary(df, expression):
    total = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)
    return df.select("record_id", expression.alias("w")).select(
        "record_id", F.size("w").cast("bigint").alias("dimension"), F.round(F.element_at("w", 1), 6).alias("first_value"),
        (F.round(F.element_at("w", -1), 6) + 0.0).alias("last_value"), F.round(total, 5).alias("total"),
    )


_NORM = "sqrt(list_sum(list_transform(v, lambda e: e*e)))"


@query("i3_l2_normalise", _list_sql(f"list_transform(v, lambda e: e/{_NORM})"))
def i3(spark, d):
    return _list_summary(fx.v_emb(spark, d), l2_normalise("embedding"))


@query("i4_pad", _list_sql("list_concat(v, list_transform(range(0,16), lambda i: 0e0))"))
def i4(spark, d):
    return _list_summary(fx.v_emb(spark, d), fit_length("embedding", 80))


@query("i4_cut", _list_sql("v[1:48]"))
def i4_cut(spark, d):
    return _list_summary(fx.v_emb(spark, d), fit_length("embedding", 48))


@query("i5_concat_blocks", _list_sql("list_transform(list_concat(v,v), lambda e: e/sqrt(2e0))"))
def i5(spark, d):
    from ..functions.vectors import INV_SQRT2

    return _list_summary(fx.v_emb(spark, d), concat_blocks(["embedding", "embedding"], INV_SQRT2))


CUTOFF = 1.26
_DIST = "sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda p: (p[1]-p[2])*(p[1]-p[2]))))"
_EMB_CTE = "with x as (select record_id, label, list_transform(embedding, lambda e: e::double) as v from v_emb)"
_PAIR_SQL = f"{_EMB_CTE}, pairs as (select a.label, a.record_id as source, b.record_id as target, {_DIST} as distance from x a join x b on a.label=b.label and a.record_id<>b.record_id)"


@query("i7_close_pairs", with_views(_PAIR_SQL + " select label, source, target, round(distance,6) as distance from pairs where distance<=126e-2"))
def i7(spark, d):
    pairs = close_pairs(fx.v_emb(spark, d), CUTOFF)
    return rounded(pairs, "distance")


_LISTED_SQL = ", o as (select label, record_id, row_number() over (partition by label order by ord) as r from v_emb), listed as (select a.label, a.record_id as source, b.record_id as target from o a join o b on a.label=b.label and b.r=a.r+1)"


@query(
    "c14_proximity_edges",
    with_views(_PAIR_SQL + _LISTED_SQL + """ select label, source, target, 'listed' as kind from listed union all
      select label, source, target, 'proximity' from pairs p where distance<=126e-2 and not exists (select 1 from listed l where l.label=p.label and l.source=p.source and l.target=p.target)"""),
)
def c14(spark, d):
    from ..operators.ranking import ordinal

    nodes = fx.v_emb(spark, d)
    placed = ordinal(nodes.select("record_id", "label", "ord"), ["label", "ord"], "position")
    following = placed.select((F.col("position") - 1).alias("position"), F.col("label").alias("_label"), F.col("record_id").alias("target"))
    listed = placed.join(following, "position").filter("label = _label").select("label", F.col("record_id").alias("source"), "target")
    return proximity_edges(nodes, listed, CUTOFF)


@query(
    "i6_radial_basis",
    with_views(_PAIR_SQL + """ select label, source, target, round(exp(-power(distance-0e0,2)/25e-2),6) as r0, round(exp(-power(distance-5e0/15,2)/25e-2),6) as r1,
        round(exp(-power(distance-2e1/15,2)/25e-2),6) as r4, 16 as n from pairs where distance<=126e-2"""),
)
def i6(spark, d):
    pairs = close_pairs(fx.v_emb(spark, d), CUTOFF).withColumn("r", radial_basis("distance"))
    picked = {f"r{i}": F.round(F.element_at("r", i + 1), 6) for i in (0, 1, 4)}
    return pairs.withColumns(picked).select("label", "source", "target", "r0", "r1", "r4", F.size("r").alias("n"))


@query(
    "i8_one_hot",
    """select event_id, cast(event_type='click' as int) as click, cast(event_type='error' as int) as error, cast(event_type='purchase' as int) as purchase,
       cast(event_type not in ('click','error','purchase') as int) as other from events""",
)
def i8(spark, d):
    slots = ["click", "error", "purchase", "other"]
    hot = read_table(spark, d, "events").select("event_id", one_hot("event_type", slots[:3]).alias("h"))
    return hot.select("event_id", *[F.element_at("h", i + 1).alias(n) for i, n in enumerate(slots)])


@query(
    "i9_safe_float",
    """select event_id, coalesce(case when event_type='error' then null else try_cast(regexp_extract(props, '"k": ([0-9]+)', 1) as double) end, -1e0) as k from events""",
)
def i9(spark, d):
    field = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    broken = F.when(F.col("event_type") == "error", F.concat(field, F.lit("?"))).otherwise(field)
    return read_table(spark, d, "events").select("event_id", safe_float(broken, -1.0).alias("k"))


@query(
    "i7_distance_to_mean",
    with_views(_EMB_CTE + """, p as (select unnest(v) as value, generate_subscripts(v,1) as i from x), m as (select i, avg(value) as value from p group by i),
      b as (select list(value order by i) as v from m) select a.record_id, round(""" + _DIST + ",6) as distance from x a cross join b"),
)
def i7_mean(spark, d):
    nodes = fx.v_emb(spark, d)
    mean = fallback_vector(nodes, F.lit(True))
    centre = F.array(*[F.lit(x) for x in mean])
    return nodes.select("record_id", F.round(distance("embedding", centre), 6).alias("distance"))

"""Contract checks. Each returns the violations as a DataFrame; empty means the contract holds.

Checks on rows are one narrow pass over the table (all rules of a row in one array, exploded only
where a rule fails). Checks on keys are one aggregation with map-side combine, so a key that holds a
large share of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractViolation, LabelAccessError
from ..functions.numbers import as_double, is_finite, is_missing, to_column

# White space removed from both ends of a text field.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Column names that hold labels.
TARGET_COLUMNS = frozenset({"label", "logS", "observed", "target", "y"})

# Which operation may use labels of which rows.
LABEL_POLICY = (
    ("model_development", "preprocessing"),
    ("model_development", "hyperparameter_selection"),
    ("model_development", "model_fitting"),
    ("model_development", "coefficient_fitting"),
    ("model_development", "scoring"),
    ("coefficient_development", "coefficient_fitting"),
    ("coefficient_development", "scoring"),
    ("scored", "scoring"),
)

ROLES = ("fit", "coefficient", "scored", "reserved")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with a few examples when a violations table has rows."""
    rows = violations.limit(5).collect()
    if rows:
        raise ContractViolation(f"{message}: {[row.asDict() for row in rows]}")


def row_violations(df: DataFrame, keys: Iterable[str], rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """One row per (row, failed rule): the key columns and the name of the rule."""
    failed = [F.when(F.coalesce(condition, F.lit(True)), F.lit(name)) for name, condition in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*failed))).alias("problem"))


def trimmed(value) -> Column:
    return F.btrim(to_column(value), F.lit(WHITESPACE))


def clean_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Trim the text columns on both sides."""
    return df.withColumns({c: trimmed(c) for c in columns})


def text_violations(df: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Text fields that are null, empty after trimming, or hold a NUL character."""
    rules = []
    for c in columns:
        rules.append((f"{c}:empty", F.coalesce(F.length(trimmed(c)), F.lit(0)) == 0))
        rules.append((f"{c}:nul", F.coalesce(F.instr(F.col(c), "\x00"), F.lit(0)) > 0))
    return row_violations(df, keys, rules)


def finite_violations(df: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Fields that are no number, missing or infinite."""
    rules = []
    for c in columns:
        rules.append((f"{c}:missing", is_missing(c)))
        rules.append((f"{c}:infinite", F.coalesce(F.abs(as_double(c)) == F.lit(float("inf")), F.lit(False))))
    return row_violations(df, keys, rules)


def require_finite(df: DataFrame, columns: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    """The table with the columns as doubles; raises when any value is not finite."""
    columns = list(columns)
    require_empty(finite_violations(df, list(keys), columns), "columns must hold finite numbers")
    return df.withColumns({c: as_double(c) for c in columns})


def split_usable(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the predicate, and the rejected rest (false or null)."""
    usable = F.coalesce(predicate, F.lit(False))
    return df.filter(usable), df.filter(~usable)


def ensure_label_free(table, targets: Iterable[str] = TARGET_COLUMNS, fold_case: bool = False) -> None:
    """Refuse a table, or a list of columns, that carries a label column."""
    columns = table.columns if isinstance(table, DataFrame) else list(table)
    names = {t.lower() for t in targets} if fold_case else set(targets)
    found = sorted(c for c in columns if (c.lower() if fold_case else c) in names)
    if found:
        raise ContractViolation(f"label columns are not allowed here: {found}")


def enforce_label_access(role: str, operation: str, policy=LABEL_POLICY) -> None:
    if (role, operation) not in set(policy):
        raise LabelAccessError(f"{operation} cannot use labels of {role} rows")


def audit_label_use(usage: DataFrame, policy=LABEL_POLICY, role: str = "role", operation: str = "operation") -> DataFrame:
    """Rows whose (role, operation) pair the policy does not allow; a null is not allowed."""
    allowed = reduce(lambda a, b: a | b, [(F.col(role) == r) & (F.col(operation) == o) for r, o in policy])
    return usage.filter(~F.coalesce(allowed, F.lit(False)))


def require_columns(df: DataFrame, columns: Iterable[str], exact: bool = True) -> DataFrame:
    """Project to the columns; raises when one is absent or, if exact, when there are others."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    extra = [c for c in df.columns if c not in columns]
    if missing or (exact and extra) or len(set(df.columns)) != len(df.columns):
        raise ContractViolation(f"columns differ from the contract: missing {missing}, undeclared {extra}")
    return df.select(*columns)


def key_violations(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys, compared as text, that are missing or occur more than once: keys, n, problem."""
    keys = list(keys)
    counted = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    problem = F.when(missing, F.lit("missing")).when(F.col("n") > 1, F.lit("duplicate"))
    return counted.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def domain_violations(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """Undeclared values of a column with their row counts; null counts as undeclared."""
    unknown = ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return df.filter(unknown).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def classify_roles(df: DataFrame, column: str, mapping: Mapping[str, Iterable], name: str = "role") -> DataFrame:
    """Map raw partition values to roles; a value of no role gives null.

    ``mapping`` is role -> values. A value declared for two roles is refused.
    """
    values = [str(v) for vs in mapping.values() for v in vs]
    if len(values) != len(set(values)):
        raise ContractViolation("a partition value is declared for more than one role")
    raw = F.col(column).cast("string")
    expression = F.lit(None).cast("string")
    for role, declared in mapping.items():
        declared = [str(v) for v in declared]
        if declared:
            expression = F.when(raw.isin(declared), F.lit(role)).otherwise(expression)
    return df.withColumn(name, expression)


def role_problems(classified: DataFrame, role: str = "role", required: Iterable[str] = ("fit", "scored")) -> DataFrame:
    """Undeclared rows and empty required roles of a classified table, from one aggregate."""
    required = list(required)
    counts = classified.agg(
        F.count_if(F.col(role).isNull()).alias("undeclared"),
        *[F.count_if(F.col(role) == r).alias(f"r{i}") for i, r in enumerate(required)],
    )
    problems = [F.when(F.col("undeclared") > 0, F.struct(F.lit("undeclared").alias("problem"), F.col("undeclared").alias("n")))]
    for i, r in enumerate(required):
        problems.append(F.when(F.col(f"r{i}") == 0, F.struct(F.lit(f"empty:{r}").alias("problem"), F.col(f"r{i}").alias("n"))))
    return counts.select(F.explode(F.array_compact(F.array(*problems))).alias("p")).select("p.*")


def attribute_conflicts(df: DataFrame, identity, attribute: str, name: str = "identity") -> DataFrame:
    """Identities with more than one value of an attribute; least and greatest value are shown.

    Two values differ exactly when the least and the greatest differ, so no distinct set is kept.
    """
    grouped = df.groupBy(to_column(identity).alias(name)).agg(
        F.min(attribute).alias("low"),
        F.max(attribute).alias("high"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(attribute).isNull()).alias("nulls"),
    )
    conflict = (F.col("low") != F.col("high")) | ((F.col("nulls") > 0) & (F.col("nulls") < F.col("n")))
    return grouped.filter(conflict).drop("nulls")


def format_rule(column: str, kind: str) -> Column:
    """Condition that is true where a field breaks a format: sha256, iso_date, positive, relative_path."""
    value = F.col(column)
    text = value.cast("string")
    if kind == "sha256":
        good = text.rlike("^[0-9a-f]{64}$")
    elif kind == "iso_date":
        good = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    elif kind == "positive":
        good = is_finite(column) & (as_double(column) > 0)
    elif kind == "relative_path":
        good = (F.length(text) > 0) & ~text.startswith("/") & ~F.concat(F.lit("/"), text, F.lit("/")).contains("/../")
    else:
        raise ContractViolation(f"unknown format rule: {kind}")
    return ~F.coalesce(good, F.lit(False))


def format_violations(df: DataFrame, keys: Iterable[str], rules: Mapping[str, str]) -> DataFrame:
    """Fields that break their format; ``rules`` is column -> kind."""
    return row_violations(df, keys, [(f"{c}:{kind}", format_rule(c, kind)) for c, kind in rules.items()])


def sequence_violations(df: DataFrame, group: Iterable[str], step, first: int = 1) -> DataFrame:
    """Groups whose steps are not first, first+1, ... without gap or repeat.

    Two aggregations with map-side combine instead of a sorted window: no group has to fit in a task.
    """
    group = list(group)
    steps = df.groupBy(*group, to_column(step).alias("_step")).agg(F.count(F.lit(1)).alias("_rows"))
    summary = steps.groupBy(*group).agg(
        F.sum("_rows").alias("n"),
        F.count("_step").alias("n_distinct"),
        F.min("_step").alias("low"),
        F.max("_step").alias("high"),
    )
    good = (
        (F.col("n") == F.col("n_distinct"))
        & (F.col("low") == first)
        & (F.col("high") == F.col("n") + (first - 1))
    )
    return summary.filter(~F.coalesce(good, F.lit(False)))


def scan_patterns(df: DataFrame, keys: Iterable[str], text: str, rules: Mapping[str, str]) -> DataFrame:
    """One row per (row, rule) whose regular expression is found in the whole text; a single scan."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("rule"))


def result_violations(
    df: DataFrame,
    keys: Iterable[str],
    low95: str = "ci95_low",
    high95: str = "ci95_high",
    low99: str | None = "ci99_low",
    high99: str | None = "ci99_high",
    difference: tuple[str, str, str] | None = None,
    tolerance: float = 1e-12,
) -> DataFrame:
    """Interval rows that are not finite, not ordered, not nested, or whose a - b differs from delta."""
    bounds = [c for c in (low95, high95, low99, high99) if c]
    rules = [(f"{c}:not_finite", ~is_finite(c)) for c in bounds]
    rules.append(("ci95:order", F.col(low95) > F.col(high95)))
    if low99 and high99:
        rules.append(("ci99:order", F.col(low99) > F.col(high99)))
        rules.append(("ci95:outside_ci99", (F.col(low95) < F.col(low99)) | (F.col(high95) > F.col(high99))))
    if difference:
        a, b, delta = difference
        rules.append(("difference", F.abs(F.col(a) - F.col(b) - F.col(delta)) > tolerance))
    return row_violations(df, keys, rules)


def conformance(expected: DataFrame, observed: DataFrame, key: Iterable[str], values: Iterable[str]) -> DataFrame:
    """Rows of a registry that are missing, extra or changed; one full outer join."""
    key, values = list(key), list(values)
    left = expected.select(*key, F.struct(*values).alias("expected"))
    right = observed.select(*key, F.struct(*values).alias("observed"))
    status = (
        F.when(F.col("observed").isNull(), F.lit("missing"))
        .when(F.col("expected").isNull(), F.lit("extra"))
        .when(~F.col("expected").eqNullSafe(F.col("observed")), F.lit("changed"))
    )
    joined = left.join(right, key, "full_outer").withColumn("status", status).filter(F.col("status").isNotNull())
    return joined.select(
        *key,
        "status",
        *[F.col(f"expected.{v}").alias(f"expected_{v}") for v in values],
        *[F.col(f"observed.{v}").alias(f"observed_{v}") for v in values],
    )


def prediction_violations(
    df: DataFrame, expected_rows: int | None = None, key: str = "record_id", prediction: str = "prediction"
) -> DataFrame:
    """A prediction table needs one finite value per key and the expected number of rows.

    Columns: problem, n. One aggregation by key, then one global one.
    """
    per_key = df.groupBy(F.col(key).cast("string").alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(~is_finite(prediction)).alias("_bad")
    )
    totals = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count_if(F.col("_key").isNull()).alias("missing_key"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_key"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("not_finite"),
    )
    problems = [
        F.when(F.col(c) > 0, F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")))
        for c in ("missing_key", "duplicate_key", "not_finite")
    ]
    if expected_rows is not None:
        wrong = F.col("rows") != F.lit(int(expected_rows))
        problems.append(F.when(wrong, F.struct(F.lit("row_count").alias("problem"), F.col("rows").alias("n"))))
    return totals.select(F.explode(F.array_compact(F.array(*problems))).alias("p")).select("p.*")


def validate_predictions(df: DataFrame, expected_rows: int, key: str = "record_id", prediction: str = "prediction") -> DataFrame:
    """Out-of-fold table: label free, one finite prediction per row, expected count."""
    ensure_label_free(df)
    require_empty(prediction_violations(df, expected_rows, key, prediction), "prediction table breaks its contract")
    return df.select(key, prediction)

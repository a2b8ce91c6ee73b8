"""Declarative rules as Catalyst predicates; no text of a rule is ever evaluated as SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import key, present

OPERATORS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}


def comparison_violation(df: DataFrame, left: str, operator: str, right_column: str | None = None, right_value=None, nulls_pass: bool = True) -> Column:
    """Whether a row breaks ``left operator right``.  Missing operands pass or break it by ``nulls_pass``; NaN is missing."""
    a, ok = key(df, left), present(df, left)
    if right_column is not None:
        b, ok = key(df, right_column), ok & present(df, right_column)
    else:
        b = F.lit(right_value)
    broken = ~F.coalesce(OPERATORS[operator](a, b), F.lit(False))
    return broken & ok if nulls_pass else broken


def comparison_count(df: DataFrame, **rule) -> DataFrame:
    """One row ``violation_count``."""
    return df.agg(F.count_if(comparison_violation(df, **rule)).alias("violation_count"))


def foreign_key_violations(df: DataFrame, columns: Sequence[str], reference: DataFrame, reference_columns: Sequence[str], nulls_pass: bool = True) -> DataFrame:
    """Rows whose key is not in ``reference``: one anti join.  Reference rows with a missing part match nothing; source
    rows with one pass or break the rule by ``nulls_pass``."""
    ref = reference.select(*[key(reference, c).alias(f"__r{i}") for i, c in enumerate(reference_columns)])
    ref = ref.dropna().distinct()
    same = F.lit(True)
    whole = F.lit(True)
    for i, c in enumerate(columns):
        same = same & (key(df, c) == F.col(f"__r{i}"))
        whole = whole & present(df, c)
    return (df.where(whole) if nulls_pass else df).join(ref, same, "left_anti")


def foreign_key_count(df: DataFrame, columns: Sequence[str], reference: DataFrame, reference_columns: Sequence[str], nulls_pass: bool = True) -> DataFrame:
    """One row ``violation_count``.  Each key is counted before it is looked up, within tasks first, so that neither a hot key nor
    the number of rows weighs on the join."""
    keys = [f"k{i}" for i in range(len(columns))]
    counted = df.select(*[key(df, c).alias(k) for c, k in zip(columns, keys, strict=True)]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    broken = foreign_key_violations(counted, keys, reference, reference_columns, nulls_pass)
    return broken.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violation_count"))


def schema_differences(actual: Mapping[str, str], expected: Mapping[str, str], *, allow_additions: bool = False, allow_removals: bool = False, allow_type_changes: bool = False) -> dict:
    """Additions, removals and type changes of a schema that a policy does not allow."""
    additions = [] if allow_additions else sorted(set(actual) - set(expected))
    removals = [] if allow_removals else sorted(set(expected) - set(actual))
    changes = []
    if not allow_type_changes:
        changes = [{"column": c, "expected": expected[c], "actual": actual[c]} for c in sorted(set(actual) & set(expected)) if actual[c].casefold() != expected[c].casefold()]
    return {"violation_count": len(additions) + len(removals) + len(changes), "additions": additions, "removals": removals, "type_changes": changes}


def schema_policy(df: DataFrame, expected: Mapping[str, str], **allowed: bool) -> DataFrame:
    """Rows ``(kind, column, expected, actual)`` of a schema policy's findings."""
    found = schema_differences({f.name: f.dataType.simpleString() for f in df.schema}, expected, **allowed)
    rows = [("addition", c, None, None) for c in found["additions"]] + [("removal", c, None, None) for c in found["removals"]]
    rows += [("type_change", x["column"], x["expected"], x["actual"]) for x in found["type_changes"]]
    return df.sparkSession.createDataFrame(rows, "kind string, column string, expected string, actual string")

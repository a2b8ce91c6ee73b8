"""Comparison levels of candidate pairs: 0 missing, 1 different, higher is closer."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.columns import is_float, quote
from lodestone.functions.strings import jaro_winkler_udf


@dataclass(frozen=True)
class ExactMatch:
    column: str
    kind = "exact"
    thresholds: tuple[float, ...] = ()

    @property
    def top(self) -> int:
        return 2


@dataclass(frozen=True)
class NumericDiff:
    """Levels by absolute difference: each threshold is inclusive, smaller ones are higher levels."""

    column: str
    thresholds: tuple[float, ...] = (0.0,)
    kind = "numeric"

    def __post_init__(self):
        if not self.thresholds or any(not math.isfinite(t) or t < 0 for t in self.thresholds) or len(set(self.thresholds)) != len(self.thresholds):
            raise ValueError("numeric thresholds must be distinct, finite and not negative")

    @property
    def top(self) -> int:
        return 1 + len(self.thresholds)


@dataclass(frozen=True)
class FuzzyString:
    """Levels by Jaro-Winkler similarity: each threshold is inclusive, larger ones are higher levels."""

    column: str
    thresholds: tuple[float, ...] = (0.85, 0.95)
    kind = "fuzzy"

    def __post_init__(self):
        if not self.thresholds or any(not 0 < t <= 1 for t in self.thresholds) or len(set(self.thresholds)) != len(self.thresholds):
            raise ValueError("fuzzy thresholds must be distinct and in (0, 1]")

    @property
    def top(self) -> int:
        return 1 + len(self.thresholds)


def _present(c: Column, dtype: T.DataType) -> Column:
    return c.isNotNull() & ~F.isnan(c) if is_float(dtype) else c.isNotNull()


def _difference(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(ta, whole) and isinstance(tb, whole):  # two longs may differ by more than a long holds
        return F.abs(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"))
    if isinstance(ta, T.DecimalType) and isinstance(tb, T.DecimalType):
        # exact where the signs agree (no overflow is possible), else as doubles
        exact = F.abs(F.try_subtract(a, b)).cast("double")
        return F.when(F.signum(a) * F.signum(b) >= 0, exact).otherwise(F.abs(a.cast("double") - b.cast("double")))
    return F.abs(a.cast("double") - b.cast("double"))


def level(pairs: DataFrame, spec) -> Column:
    """The level column of one comparison, from columns ``<c>_l`` and ``<c>_r``."""
    types = {f.name: f.dataType for f in pairs.schema}
    nl, nr = f"{spec.column}_l", f"{spec.column}_r"
    a, b = F.col(quote(nl)), F.col(quote(nr))
    both = _present(a, types[nl]) & _present(b, types[nr])
    if spec.kind == "exact":
        return F.when(~both, 0).when(a == b, 2).otherwise(1).alias(f"level__{spec.column}")
    d = _difference(a, b, types[nl], types[nr]) if spec.kind == "numeric" else F.col("__sim")
    return _steps(both, d, spec)


def _steps(both: Column, d: Column, spec) -> Column:
    out = F.lit(1)
    for rank, t in enumerate(sorted(spec.thresholds, reverse=spec.kind == "numeric"), 2):
        out = F.when(d <= F.lit(float(t)) if spec.kind == "numeric" else d >= F.lit(float(t)), rank).otherwise(out)
    return F.when(~both, 0).otherwise(out).alias(f"level__{spec.column}")


def with_levels(pairs: DataFrame, specs: Sequence) -> DataFrame:
    """``pairs`` with a column ``level__<c>`` for each comparison.  Only fuzzy comparisons leave the JVM."""
    out = pairs
    for spec in specs:
        if f"__sim_{spec.column}" in out.columns:  # compared where the pairs were made
            out = out.withColumnRenamed(f"__sim_{spec.column}", "__sim").withColumn(f"level__{spec.column}", _steps(F.col("__sim").isNotNull(), F.col("__sim"), spec)).drop("__sim")
        elif spec.kind == "fuzzy":
            a, b = F.col(quote(f"{spec.column}_l")).cast("string"), F.col(quote(f"{spec.column}_r")).cast("string")
            out = out.withColumn("__sim", jaro_winkler_udf(a, b))
            out = out.withColumn(f"level__{spec.column}", level(out, spec)).drop("__sim")
        else:
            out = out.withColumn(f"level__{spec.column}", level(out, spec))
    return out


def patterns(levelled: DataFrame, specs: Sequence) -> DataFrame:
    """Rows ``(level__..., n)``: how many pairs have each combination of levels (at most their product)."""
    return levelled.groupBy(*[F.col(quote(f"level__{s.column}")) for s in specs]).agg(F.count(F.lit(1)).alias("n"))

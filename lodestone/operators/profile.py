"""Profiling operators.  Each returns a DataFrame and reads only the columns it needs; whatever can be
answered by one aggregate is."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.columns import col, is_nested, key, present, strip, type_of
from lodestone.operators.quantile import exact_quantiles
from lodestone.plans.staging import stage

#: Columns whose distinct values are counted by one multi-distinct aggregate, and up to which that is done at all.
MULTI_DISTINCT, FEW_DISTINCT = 8, 2
APPROXIMATE_ACCURACY = 1000
#: Hashes of a column that a task holds back to drop their repeats.
HELD_HASHES = 1 << 13
#: Types whose values have at most eight bytes.
FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Repeated digests (16 bytes each) that may be broadcast.
BROADCAST_DIGESTS = 1_000_000


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def unpivot(wide: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """One row of aggregates as many rows: each of ``rows`` is a list of (name, column)."""
    structs = [F.struct(*[c.alias(n) for n, c in row]) for row in rows]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing_count(df: DataFrame, name: str) -> Column:
    return F.count_if(~present(df, name))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column, null_count, row_count)``: NULL and NaN of each column, in one pass."""
    names = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[missing_count(df, c).alias(f"m{i}") for i, c in enumerate(names)])
    return unpivot(wide, [(("column", F.lit(c)), ("null_count", F.col(f"m{i}")), ("row_count", F.col("n"))) for i, c in enumerate(names)])


def _counted(df: DataFrame, names: Sequence[str], count) -> dict[str, int]:
    found: dict[str, int] = {}
    for at in range(0, len(names), MULTI_DISTINCT):
        some = names[at : at + MULTI_DISTINCT]
        found |= dict(zip(some, df.agg(*[count(key(df, c)).alias(f"d{i}") for i, c in enumerate(some)]).first(), strict=True))
    return found


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """While this holds, expressions over many columns are not fused into one generated method of more than 8,000 bytes: the JVM compiles none that
    long and would interpret it for every row."""
    name, limit = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(limit, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _digested(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Distinct values of many columns in one scan: pairs of column number and value digest are made distinct, within tasks first.  Values of at most
    eight bytes have one hash, which is a bijection of them; others have a digest, and a third hash tells where two values share it: such a
    column is counted by its values."""
    values = [key(df, c) for c in names]
    small = [isinstance(type_of(df, c), FIXED) for c in names]
    hashes = [[F.xxhash64(v)] if s else [*value_digest(v), F.xxhash64(F.lit(3), v)] for v, s in zip(values, small, strict=True)]
    flat = df.select(*[F.when(v.isNotNull(), h).alias(f"{n}{i}") for i, (v, hs) in enumerate(zip(values, hashes, strict=True)) for n, h in zip("hgt", hs, strict=False)])
    pairs = flat.mapInArrow(_distinct_within(small), "c int, h long, g long, t long")
    distinct = pairs.groupBy("c", "h", "g").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    counts = distinct.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("least") != F.col("most")).alias("shared"))
    with compiled(df.sparkSession):
        rows = counts.collect()  # one row a column
    found = dict.fromkeys(names, 0) | {names[r.c]: r.n for r in rows}
    return found | _counted(df, [names[r.c] for r in rows if r.shared], F.count_distinct)


def _distinct_within(small: Sequence[bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each column the hashes that occur in a task, repeated as seldom as ``HELD_HASHES`` allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}

        def rows(i: int, found: pa.Table) -> Iterator[pa.RecordBatch]:
            zero = pa.repeat(pa.scalar(0, pa.int64()), len(found))
            columns = [pa.repeat(pa.scalar(i, pa.int32()), len(found)), *[found[n] if n in found.column_names else zero for n in "hgt"]]
            yield from pa.table(columns, names=["c", "h", "g", "t"]).combine_chunks().to_batches()

        for batch in batches:
            at = 0
            for i, one in enumerate(small):
                width = 1 if one else 3
                some = pa.table(batch.columns[at : at + width], names=["h", "g", "t"][:width])
                at += width
                some = pa.concat_tables([held.pop(i), some]) if i in held else some
                some = pa.table([pc.unique(some["h"]).drop_null()], names=["h"]) if one else some.filter(pc.is_valid(some["h"])).group_by(["h", "g", "t"], use_threads=False).aggregate([])
                if len(some) > HELD_HASHES:
                    yield from rows(i, some)
                else:
                    held[i] = some
        for i, some in held.items():
            yield from rows(i, some)

    return run


def value_digest(v: Column) -> list[Column]:
    """128 bits of a value."""
    return [F.xxhash64(F.lit(i), v) for i in (1, 2)]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows ``(column, distinct_count)`` of present values.  Exact: a few columns by one aggregate, many by digests in one scan (nested ones, which
    may have no hash, by value).  ``approximate``: by sketches of bounded size, about 5 % off, in one scan."""
    names = list(columns or df.columns)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(key(df, c)).alias(f"d{i}") for i, c in enumerate(names)])
        return unpivot(wide, [(("column", F.lit(c)), ("distinct_count", F.col(f"d{i}"))) for i, c in enumerate(names)])
    flat = [c for c in names if not is_nested(type_of(df, c))]
    flat = flat if len(flat) > FEW_DISTINCT else []
    found = (_digested(df, flat) if flat else {}) | _counted(df, [c for c in names if c not in set(flat)], F.count_distinct)
    return df.sparkSession.createDataFrame([(c, found[c]) for c in names], "column string, distinct_count long")


def top_values(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Rows ``(value, count)``: the ``n`` most frequent present values as text, ties by text."""
    counted = df.where(present(df, name)).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("v").cast("string").alias("value"), "count").orderBy(F.desc("count"), "value").limit(n)


def quantile_values(df: DataFrame, columns: Sequence[str], qs: Sequence[float], approximate: bool = False) -> dict[str, list[float | None]]:
    """For each column the quantiles of its present values (None if there are none): by rank selection, or by sketches of bounded size."""
    if not approximate:
        return exact_quantiles(df, columns, qs)
    if not columns:
        return {}
    array = F.array(*[F.lit(float(q)) for q in qs])
    row = df.agg(*[F.percentile_approx(key(df, c).cast("double"), array, F.lit(APPROXIMATE_ACCURACY)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(qs) for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], approximate: bool = False) -> DataFrame:
    """Rows ``(column, quantile, value)``: linear interpolation unless ``approximate``; NaN for an empty column."""
    found = quantile_values(df, columns, qs, approximate)
    rows = [(c, float(q), float("nan") if v is None else float(v)) for c in columns for q, v in zip(qs, found[c], strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, quantile double, value double")


def quantile_provenance(approximate: bool) -> dict:
    return {"method": "approximate", "relative_error": 1 / APPROXIMATE_ACCURACY} if approximate else {"method": "exact"}


def outside(df: DataFrame, name: str, low, high) -> Column:
    """Whether a present value lies outside the inclusive bounds."""
    c = col(name)
    return present(df, name) & ((c < F.lit(low)) | (c > F.lit(high)))


def counts_outside(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Rows ``(column, violation_count)`` for all bounds, in one pass."""
    names = list(bounds)
    wide = df.agg(*[F.count_if(outside(df, c, *bounds[c])).alias(f"o{i}") for i, c in enumerate(names)])
    return unpivot(wide, [(("column", F.lit(c)), ("violation_count", F.col(f"o{i}"))) for i, c in enumerate(names)])


def rows_outside(df: DataFrame, name: str, low, high, n: int | None = None) -> DataFrame:
    """The violating rows, all or any ``n``."""
    found = df.where(outside(df, name, low, high))
    return found if n is None else found.limit(n)


def fences(df: DataFrame, columns: Sequence[str], k: float = 1.5, approximate: bool = False) -> DataFrame:
    """Rows ``(column, lower_bound, upper_bound)`` of the interquartile rule; null for a column without values."""
    found = quantile_values(df, columns, [0.25, 0.75], approximate)
    rows = [(c, None, None) if q1 is None else (c, float(q1 - k * (q3 - q1)), float(q3 + k * (q3 - q1))) for c, (q1, q3) in ((c, found[c]) for c in columns)]
    return df.sparkSession.createDataFrame(rows, "column string, lower_bound double, upper_bound double")


def outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5, approximate: bool = False) -> DataFrame:
    """Rows ``(column, lower_bound, upper_bound, outlier_count)``; columns without values or finite bounds are left
    out.  Bounds are a driver's handful of numbers, counts one more pass."""
    found = [r for r in fences(df, columns, k, approximate).collect() if r.lower_bound is not None and math.isfinite(r.lower_bound) and math.isfinite(r.upper_bound)]
    if not found:
        return df.sparkSession.createDataFrame([], "column string, lower_bound double, upper_bound double, outlier_count long")
    wide = df.agg(*[F.count_if(outside(df, r["column"], r.lower_bound, r.upper_bound)).alias(f"o{i}") for i, r in enumerate(found)])
    return unpivot(wide, [(("column", F.lit(r["column"])), ("lower_bound", F.lit(r.lower_bound)), ("upper_bound", F.lit(r.upper_bound)), ("outlier_count", F.col(f"o{i}"))) for i, r in enumerate(found)])


def _keys(df: DataFrame, subset: Sequence[str] | None) -> list[str]:
    return list(subset) if subset else df.columns


def _is_wide(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether keys take more room than a digest, or no fixed room."""
    return len(names) > 2 or not all(isinstance(type_of(df, c), FIXED) for c in names)


def digest(keys: Sequence[Column]) -> list[Column]:
    """128 bits of a row's keys, of which NULLs are part."""
    parts = [p for k in keys for p in (k, k.isNull())]
    return [F.xxhash64(F.lit(i), *parts) for i in (1, 2)]


def _suspects(df: DataFrame, names: Sequence[str]) -> DataFrame | None:
    """The rows whose digest occurs more than once (None: there are no such rows).  Only digests and counts are shuffled to find
    them; then, unless more digests are repeated than may be broadcast, no row moves."""
    h = digest([key(df, c) for c in names])
    twice = df.select(h[0].alias("h"), h[1].alias("i")).groupBy("h", "i").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = stage(twice.select(F.col("h").alias("__h"), F.col("i").alias("__i")), "digests")
    some = twice.limit(BROADCAST_DIGESTS + 1).count()
    if not some:
        return None
    return df.join(F.broadcast(twice) if some <= BROADCAST_DIGESTS else twice, (h[0] == F.col("__h")) & (h[1] == F.col("__i")), "left_semi")


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row ``duplicate_count``: members of groups of equal keys with more than one row; NULL and NaN are one key.  Wide keys are
    searched by digest first; rows of repeated digests are then compared in full."""
    names = _keys(df, subset)
    rows = df.select(*[col(c) for c in dict.fromkeys(names)])
    if _is_wide(df, names):
        rows = _suspects(rows, names)
        if rows is None:
            return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_count"))
    grouped = rows.groupBy(*[key(rows, c).alias(f"k{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_count"))


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """The rows of groups with more than one member, all or any ``n``.  Repeated keys are found by a pre-aggregated
    count (of wide ones: among rows of repeated digests) and joined back, so that a huge group is never gathered in one task."""
    names = _keys(df, subset)
    rows = _suspects(df, names) if _is_wide(df, names) else df
    if rows is None:
        return df.limit(0)
    dup = rows.groupBy(*[key(df, c).alias(f"__k{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & key(df, c).eqNullSafe(dup[f"__k{i}"])
    found = rows.join(dup, same, "left_semi")
    return found if n is None else found.limit(n)


def instant_micros(df: DataFrame, name: str, timezone: str) -> tuple[Column, Column]:
    """A temporal or text column as UTC microseconds, and whether a present value is no instant."""
    c, dtype = col(name), type_of(df, name)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c), F.lit(False)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp_ntz").cast("string").cast("timestamp"), timezone)), F.lit(False)
    if not isinstance(dtype, T.StringType):
        raise TypeError(f"{name!r} has no instants")
    text = strip(c)
    zoned = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    # an offset without its colon is given one; whatever is no timestamp becomes null
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    aware = F.unix_micros(colon.try_cast("timestamp"))
    naive = F.unix_micros(F.to_utc_timestamp(text.try_cast("timestamp_ntz").cast("string").cast("timestamp"), timezone))
    micros = F.when(zoned, aware).otherwise(naive)
    return micros, c.isNotNull() & micros.isNull()


def max_instant(df: DataFrame, name: str, timezone: str = "UTC") -> DataFrame:
    """One row ``(max_instant_micros, invalid_count)``."""
    micros, invalid = instant_micros(df, name, timezone)
    return df.agg(F.max(micros).alias("max_instant_micros"), F.count_if(invalid).alias("invalid_count"))


def max_datetime(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.max(col(name)).alias("max_datetime"))


def dtype_inventory(df: DataFrame) -> DataFrame:
    """Rows ``(dtype, columns)``: the roll-up of native types."""
    counts: dict[str, int] = {}
    for f in df.schema:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, columns long")

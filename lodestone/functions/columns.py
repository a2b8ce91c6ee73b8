"""Columns by name, portable type families, and what counts as a missing value.

NULL and floating NaN are missing, everywhere.  Spark orders NaN above all numbers, finds it equal
to itself and groups it apart from NULL, so every operator goes through ``present`` and ``key``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    """A column name as an identifier; dots and back quotes are ordinary characters."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str, alias: str | None = None) -> Column:
    return F.col(quote(name) if alias is None else f"{alias}.{quote(name)}")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema if f.name == name)


def present_expr(c: Column, dtype: T.DataType) -> Column:
    """Whether a value is neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c) if is_float(dtype) else c.isNotNull()


def present(df: DataFrame, name: str) -> Column:
    return present_expr(col(name), type_of(df, name))


def key(df: DataFrame, name: str) -> Column:
    """The value, with NaN as NULL: one key for both."""
    dtype = type_of(df, name)
    return F.when(present_expr(col(name), dtype), col(name)) if is_float(dtype) else col(name)


def filled(df: DataFrame, name: str) -> Column:
    """Whether a value is present and, if a string, not blank (linkage and merging)."""
    c, dtype = col(name), type_of(df, name)
    ok = present_expr(c, dtype)
    return ok & (strip(c) != "") if isinstance(dtype, T.StringType) else ok


def strip(c: Column) -> Column:
    """Without any white space at both ends (Spark's trim takes only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def family(dtype: T.DataType) -> str:
    """The portable family of a type."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if is_float(dtype):
        return "float"
    names = (
        (T.DecimalType, "decimal"), (T.BooleanType, "boolean"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.DateType, "date"),
        (T.DayTimeIntervalType, "duration"), (T.YearMonthIntervalType, "duration"), (T.BinaryType, "binary"), (T.StringType, "string"), (T.CharType, "string"), (T.VarcharType, "string"),
    )
    for kind, name in names:
        if isinstance(dtype, kind):
            return name
    if dtype.simpleString().startswith("time("):
        return "time"
    return "nested" if is_nested(dtype) else dtype.simpleString()


#: Accepted spellings of the portable families (fixed values).
FAMILY_ALIASES = {
    "int": "integer", "integer": "integer", "long": "integer", "bigint": "integer", "float": "float", "double": "float", "real": "float", "decimal": "decimal",
    "number": "numeric", "numeric": "numeric", "bool": "boolean", "boolean": "boolean", "timestamp": "datetime", "datetime": "datetime", "date": "date", "time": "time",
    "timedelta": "duration", "duration": "duration", "bytes": "binary", "binary": "binary", "str": "string", "string": "string", "text": "string", "category": "categorical", "categorical": "categorical",
}


def matches_family(dtype: T.DataType, expected: str) -> bool:
    """Whether a type is of an expected family or has exactly that native name."""
    want, have = expected.strip().casefold(), family(dtype)
    if dtype.simpleString().casefold() == want:
        return True
    want = FAMILY_ALIASES.get(want, want)
    return have in ("integer", "float", "decimal") if want == "numeric" else have == want


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) or dtype.simpleString() == "variant"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if family(f.dataType) in ("integer", "float", "decimal")]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if family(f.dataType) in ("datetime", "date")]


def dtypes(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def validate_names(names: list[str]) -> None:
    """Names must be text without NUL or lone surrogates, not blank, without outer white space and unique under case folding."""
    seen: set[str] = set()
    for name in names:
        if not isinstance(name, str):
            raise TypeError(f"column names must be strings, not {type(name).__name__}")
        if "\0" in name or re.search("[\ud800-\udfff]", name):
            raise ValueError("column names must be valid UTF-8 without NUL")
        if not name.strip() or name != name.strip():
            raise ValueError(f"column names must not be blank or have outer white space: {name!r}")
        if name.casefold() in seen:
            raise ValueError(f"column names must be unique without regard to case: {name!r}")
        seen.add(name.casefold())


def normalize_nested(df: DataFrame, allow: bool = False) -> tuple[DataFrame, list[str]]:
    """Nested columns as JSON strings (null fields and map keys in order kept), and their names; refused unless allowed."""
    nested = [f for f in df.schema if is_nested(f.dataType)]
    if nested and not allow:
        raise TypeError(f"nested columns are not supported: {[f.name for f in nested]}")
    names = {f.name: f.dataType for f in nested}

    def text(name: str) -> Column:
        c = col(name)
        if isinstance(names[name], T.MapType):
            c = F.map_from_entries(F.array_sort(F.map_entries(c)))
        return F.to_json(c, {"ignoreNullFields": "false"}).alias(name)

    if not names:
        return df, []
    return df.select(*[text(n) if n in names else col(n) for n in df.columns]), sorted(names)

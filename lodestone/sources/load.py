"""Inputs: DataFrames, pandas and Arrow tables, Parquet, CSV and JSON lines, from any path Spark can read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.columns import normalize_nested, validate_names
from lodestone.sources.text_validation import csv_columns, jsonl_schema

_REMOTE = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]+://")


@dataclass
class Source:
    frame: DataFrame
    name: str | None = None
    nested: list[str] = field(default_factory=list)


def redact(path: str) -> str:
    """A path for reports: without user information, query and fragment."""
    if not _REMOTE.match(path):
        return path
    u = urlsplit(path)
    return urlunsplit((u.scheme, u.netloc.rpartition("@")[2], u.path, "", ""))


def guard_url(path: str) -> None:
    """Refuse addresses that carry credentials or tokens."""
    if _REMOTE.match(path):
        u = urlsplit(path)
        if "@" in u.netloc or u.query or u.fragment:
            raise ValueError("addresses must not hold user information, a query or a fragment")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, commas, inferred types, quotes doubled inside quotes; malformed rows fail, and only the empty field is null.

    Files stay splittable unless a quoted field holds a line end."""
    _, spans = csv_columns(spark, path)
    options = {"header": True, "inferSchema": True, "mode": "FAILFAST", "nullValue": "", "emptyValue": "", "escape": '"', "enforceSchema": False, "multiLine": spans}
    return spark.read.options(**options).csv(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, under the one schema that all lines agree on."""
    return spark.read.schema(jsonl_schema(spark, path)).option("mode", "FAILFAST").json(path)


READERS = {".parquet": read_parquet, ".pq": read_parquet, ".csv": read_csv, ".jsonl": read_jsonl, ".ndjson": read_jsonl}


def suffix_of(spark: SparkSession, path: str) -> str:
    """The suffix of a file, or of the files in a directory."""
    found = re.search(r"(\.[A-Za-z0-9]+)(?:\*|\})?/?$", path)
    if found and found[1].lower() in READERS:
        return found[1].lower()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {m[1].lower() for s in (fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "*")) or []) if (m := re.search(r"(\.[A-Za-z0-9]+)$", s.getPath().getName()))}
    names &= set(READERS)
    if len(names) != 1:
        raise ValueError(f"cannot tell the format of {redact(path)!r}")
    return names.pop()


def load(data, spark: SparkSession | None = None, *, allow_nested: bool = False) -> Source:
    """A source from a DataFrame of this session, a pandas or Arrow table, or a path (file, directory or pattern)."""
    name = None
    if isinstance(data, DataFrame):
        if spark is not None and data.sparkSession is not spark and data.sparkSession._jsparkSession != spark._jsparkSession:
            raise ValueError("the DataFrame belongs to another session")
        frame = data
    elif isinstance(data, (str,)) or hasattr(data, "__fspath__"):
        path = str(data)
        guard_url(path)
        spark = spark or SparkSession.getActiveSession()
        suffix = suffix_of(spark, path)
        frame, name = READERS[suffix](spark, path), redact(path)
    else:
        spark = spark or SparkSession.getActiveSession()
        validate_names(list(getattr(data, "columns", [])) if not hasattr(data, "column_names") else data.column_names)
        frame = spark.createDataFrame(data)
    validate_names(frame.columns)
    frame, nested = normalize_nested(frame, allow_nested)
    return Source(frame, name, nested)
